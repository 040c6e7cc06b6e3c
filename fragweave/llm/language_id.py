"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, runs of anything else become one space, and n-grams of one to three
characters are hashed into bins. Document frequencies cover all training documents. The weights are
trained with follow-the-regularised-leader (FTRL-proximal) and elastic-net penalties on a bounded
sample of labelled documents; a temperature fitted on a part kept out of it calibrates the scores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragweave.llm.common import fold_of, shipped
from fragweave.llm.textkernel import mix

BINS = 1 << 14
UNKNOWN = "und"
#: Bounds of the fit: documents per language and in all (every language keeps some), and bytes of the table of bins x languages.
PER_LANGUAGE, ROWS, TABLE_BYTES = 700, 70_000, 1 << 28
PIECE = 1 << 19


class Model(NamedTuple):
    languages: tuple[str, ...]
    table: np.ndarray  # BINS x languages: idf times weight
    bias: np.ndarray
    temperature: float


_classes: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For each 16-bit code point its lower-case letter, or a space; built once per worker."""
    if not _classes:
        table = np.full(1 << 16, 32, np.uint32)
        for code in range(1 << 16):
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                table[code] = ord(low) if len(low) == 1 else code
        _classes.append(table)
    return _classes[0]


def letters_of(text: str) -> np.ndarray:
    """Lower-case letters and single spaces, a space at either end; empty if there is no letter."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = letter_table()
    low = table[np.minimum(code, 0xFFFF)]
    high = np.flatnonzero(code > 0xFFFF)
    if len(high):
        low[high] = [ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in code[high]]
    low = np.concatenate(([np.uint32(32)], low, [np.uint32(32)]))
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    low = low[keep]
    return low if len(low) > 1 else low[:0]


def grams_of(letters: np.ndarray) -> np.ndarray:
    """Bins of all n-grams of one to three characters."""
    x = letters.astype(np.uint64)
    two = x[:-1] * np.uint64(0x1F0A5) + x[1:] + np.uint64(1 << 40)
    three = two[:-1] * np.uint64(0x2F0B7) + x[2:] + np.uint64(1 << 41)
    return (mix(np.concatenate((x, two, three))) >> np.uint64(50)).astype(np.int64)


def counts_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bins that occur and their share of all n-grams; long texts are counted piece by piece."""
    letters = letters_of(text)
    total = np.zeros(BINS, np.int64)
    for lo in range(0, max(len(letters) - 2, 0), PIECE):
        total += np.bincount(grams_of(letters[lo:lo + PIECE + 2]), minlength=BINS)
    at = np.flatnonzero(total)
    return at, total[at] / max(1, total.sum())


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, n = np.zeros(BINS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            at, _ = counts_of(text.as_py() or "")
            seen[at] += 1
            n += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*seen[at], n], pa.int64())], names=["bin", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [counts_of(t.as_py() or "") for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([a.tolist() for a, _ in got], pa.list_(pa.int32())), pa.array([w.tolist() for _, w in got], pa.list_(pa.float32())), *batch.columns[1:]],
            names=["at", "share", "lang", "pick"])


def training_docs(docs: DataFrame, fold: int = 4, out: int = 2) -> DataFrame:
    """Documents outside the held-out fold that have a text, a language and an id."""
    return docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                                                       & (fold_of(F.col("doc_id"), fold) != out))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0,
         l1: float = 0.02, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic net: weights stay zero until their gradient sums pass l1."""
    z, n = np.zeros((BINS + 1, n_classes)), np.zeros((BINS + 1, n_classes))

    def weights(at):
        za, na = z[at], n[at]
        return np.where(np.abs(za) <= l1, 0.0, -(za - np.sign(za) * l1) / ((beta + np.sqrt(na)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weights(at)
            logit = x @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = x[:, None] * p[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    w = weights(slice(None))
    return w[:BINS], w[BINS]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))

    lo, hi, r = -4.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(train: DataFrame, per_language: int = PER_LANGUAGE, table_bytes: int = TABLE_BYTES) -> Model:
    """Learn every language of the rows (doc_id, text, lang).

    Document frequencies count every row. The regression sees about ``per_language`` rows of each
    language, fewer where ``ROWS`` are shared by many, picked by the hash of doc_id. More languages
    than a table of ``table_bytes`` holds are an error; none is left out.
    """
    spark = train.sparkSession
    most = table_bytes // (8 * BINS)
    sizes = train.groupBy("lang").count().limit(most + 1).collect()
    if not sizes:
        return Model((), np.zeros((BINS, 0)), np.zeros(0), 1.0)
    if len(sizes) > most:
        raise ValueError(f"more than {most} languages: the table of {BINS} bins x languages would pass {table_bytes} bytes")
    per_language = max(1, min(per_language, ROWS // len(sizes)))
    names = tuple(sorted(r["lang"] for r in sizes))
    found = train.select("text").mapInArrow(_frequencies, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()  # one row a bin
    n_docs = int(found.loc[found["bin"] == -1, "n"].sum())
    found = found[found["bin"] >= 0]
    df = np.zeros(BINS)
    df[found["bin"].to_numpy()] = found["n"].to_numpy()
    idf = np.log((1 + n_docs) / (1 + df)) + 1

    share = spark.createDataFrame(pd.DataFrame({"lang": [r["lang"] for r in sizes], "share": [min(1.0, per_language / r["count"]) for r in sizes]}), "lang string, share double")
    pick = (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) / float(1 << 30)).alias("pick")
    sample = train.select("text", "lang", pick).join(F.broadcast(share), "lang").where("pick < share")  # one row a language
    rows = sample.select("text", "lang", (F.col("pick") / F.col("share")).alias("pick")).mapInArrow(
        _features, "at array<int>, share array<float>, lang string, pick double").toPandas()
    rows = rows.sort_values(["pick", "lang"], kind="stable").reset_index(drop=True)
    y = rows["lang"].map({l: i for i, l in enumerate(names)}).to_numpy()
    x = []
    for at, s in zip(rows["at"], rows["share"], strict=True):
        v = np.asarray(s, float) * idf[np.asarray(at, np.int64)] if len(at) else np.zeros(0)
        x.append((np.append(np.asarray(at, np.int64), BINS), np.append(v * 20, 1.0)))
    held = rows["pick"].to_numpy() >= 0.8
    held &= np.bincount(y[~held], minlength=len(names))[y] > 0  # a language with held rows only is learned from them
    own = np.flatnonzero(~held)
    w, bias = ftrl([x[i] for i in own], y[own], len(names))
    left = np.flatnonzero(held)
    logits = np.array([x[i][1][:-1] @ w[x[i][0][:-1]] + bias for i in left]).reshape(len(left), len(names))
    return Model(names, w * idf[:, None] * 20, bias, fit_temperature(logits, y[left]))


def predict(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Add lang_pred and score (0 to 1) to the columns ``keep`` of every row, from the whole text.

    A text that is null or has no letter, or a model that learned no language, gives ``und`` and 0.
    Equal probabilities go to the language first in order.
    """
    source = docs.select(*keep, docs["text"].alias("_text"))
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    n_keep, names = len(keep), [*keep, "lang_pred", "score"]
    shared = shipped(docs.sparkSession, model)  # BINS x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared()
        table = m.table.astype(np.float32)
        for batch in batches:
            lang, score = [], []
            for text in batch.column(n_keep):
                letters = letters_of(text.as_py() or "")
                if not len(letters) or not m.languages:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                total, n = np.zeros(len(m.languages)), 0
                for lo in range(0, max(len(letters) - 2, 0), PIECE):
                    count = np.bincount(grams_of(letters[lo:lo + PIECE + 2]), minlength=BINS).astype(np.float32)
                    total += count @ table
                    n += count.sum()
                s = (total / max(1, n) + m.bias) / m.temperature
                p = np.exp(s - s.max())
                best = int(p.argmax())
                lang.append(m.languages[best])
                score.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)

    return source.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", lang_pred string, score double")
