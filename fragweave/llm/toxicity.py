"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to Latin letters and turns all else but
letters into spaces, so the automaton sees words with a space on both sides. Lexicon entries are
whole words (" idiot ") or word beginnings (" idio"), each weighted by its smoothed log odds among
labelled documents. Matches inside an exception phrase do not count. The sum of weights is
normalised by length, and a logistic curve fitted on the labelled documents turns it into a score.
The curve weighs the normalised sum and the plain one, so the labels decide how much length counts:
one entry in a very long text is not diluted away where labels call such texts toxic. Neither weight
is negative, so more matches never lower a score.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragweave.llm.common import fold_of, shipped

# Letters of other scripts and digits that stand in for Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "ѵ": "v", "х": "x", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
#: Phrases whose words are not meant as insults.
EXCEPTIONS = ("trash can", "trash bag", "clown fish", "pond scum", "soap scum", "stupid question")

#: Bounds of the fit: labelled documents used, lexicon entries kept, support an entry needs.
FIT_ROWS, LEXICON, SUPPORT = 20_000, 3_000, 5
PREFIXES = (4, 5, 6)


class _Folding(dict):
    """Translation table that works out each character once."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        low = unicodedata.normalize("NFKC", c).lower()
        if c in INVISIBLE:
            out = None
        elif c in DIGITS:
            out = DIGITS[c]
        elif low and all(x.isalpha() or unicodedata.combining(x) for x in low):
            out = "".join(HOMOGLYPHS.get(x, x) for x in low)
        else:
            out = " "
        self[code] = out
        return out


def folded(text: str | None, table: _Folding) -> str:
    """Folded text with one space at either end; signs that stand alone become spaces."""
    return f" {(text or '').translate(table)} "


class Lexicon(NamedTuple):
    """Entries with weights, exception phrases, and the logistic curve of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    intercept: float = -4.0
    slope: float = 4.0
    plain_slope: float = 0.0


class Matcher:
    """The automaton of a lexicon and what it finds in a text."""

    def __init__(self, lexicon: Lexicon):
        self.table, self.lexicon = _Folding(), lexicon
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in lexicon.exceptions:
            self.automaton.add_word(phrase := folded(phrase, self.table), (len(phrase), None))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def strength(self, text: str | None) -> tuple[float, float]:
        """Summed weights, one per word: over the logarithm of the length in words, and plain."""
        if not text or not self.any:
            return 0.0, 0.0
        text = folded(text, self.table)
        hits: dict[int, float] = {}
        spans = []
        for end, (size, weight) in self.automaton.iter(text):
            begin = end - size + 1
            if weight is None:
                spans.append((begin, end))
            elif weight > hits.get(begin, 0.0):
                hits[begin] = weight
        if not hits:
            return 0.0, 0.0
        for begin, end in spans:
            for at in [at for at in hits if begin <= at < end]:
                del hits[at]
        total = sum(hits.values())
        return total / math.log2(2 + len(text.split())), total

    def score(self, strength: np.ndarray) -> np.ndarray:
        """Scores of rows (normalised sum, plain sum)."""
        line = self.lexicon.intercept + strength @ np.array([self.lexicon.slope, self.lexicon.plain_slope])
        return 1 / (1 + np.exp(-np.clip(line, -30, 30)))


def entries_of(text: str | None, table: _Folding) -> set[str]:
    """What a document offers to the lexicon: its words and their beginnings."""
    words = set(folded(text, table).split())
    return {f" {w} " for w in words if len(w) > 2} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _Folding()
    for batch in batches:
        bad, good = Counter(), Counter()
        for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            (bad if label else good).update(entries_of(text.as_py(), table))
        terms = list(bad.keys() | good.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([bad[t] for t in terms], pa.int64()), pa.array([good[t] for t in terms], pa.int64())],
            names=["entry", "bad", "good"])


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Intercept and slopes of a logistic regression by Newton's method, lightly shrunk; no slope is negative."""
    active = list(range(x.shape[1]))
    while True:
        found = np.zeros(1 + x.shape[1])
        found[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        at = [0, *(1 + k for k in active)]
        design = np.column_stack([np.ones(len(x)), x[:, active]])
        shrunk = np.array([0.0] + [ridge] * len(active))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ found[at], -30, 30)))
            grad = design.T @ (y - p) - shrunk * found[at]
            hess = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(at))
            step = np.linalg.solve(hess, grad)
            step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
            found[at] += step
            if np.abs(step).max() < 1e-8:
                break
        lowest = min(active, key=lambda k: found[1 + k], default=None)
        if lowest is None or found[1 + lowest] >= 0:
            return found
        active.remove(lowest)


def fit(labelled: DataFrame, exceptions: Sequence[str] = EXCEPTIONS, size: int = LEXICON, support: int = SUPPORT) -> Lexicon:
    """Learn entries, weights and curve from rows (text, label); the caller bounds their number.

    Without toxic rows the lexicon is empty and every score is low.
    """
    counted = labelled.select("text", "label").mapInArrow(_count_entries, "entry string, bad bigint, good bigint").groupBy("entry").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    n = labelled.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("all")).first()
    n_bad, n_good = int(n["bad"]), int(n["all"] - n["bad"])
    if not n_bad:
        return Lexicon({}, tuple(exceptions))
    weight = F.log((F.col("bad") + 0.1) / (n_bad + 0.2)) - F.log((F.col("good") + 0.1) / (n_good + 0.2))
    # an entry must be far likelier in toxic documents, and mostly occur there
    kept = counted.where((F.col("bad") >= max(support, n_bad // 100)) & (F.col("bad") >= 9 * F.col("good"))).withColumn("weight", weight).where("weight > 2")
    rows = kept.orderBy(F.desc("weight"), F.desc("bad"), "entry").limit(size).collect()  # at most size rows
    weights = {r["entry"]: r["weight"] for r in rows}
    # a longer entry adds nothing to a beginning that weighs as much
    weights = {e: w for e, w in weights.items() if not any(weights.get(f" {e.strip()[:k]}", 0) >= w for k in PREFIXES if k < len(e.strip()) + e.endswith(" "))}
    lexicon = Lexicon(weights, tuple(exceptions))

    def strengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(lexicon)
        for batch in batches:
            pairs = np.array([own.strength(t.as_py()) for t in batch.column(0)], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), batch.column(1)], names=["x", "plain", "y"])

    points = labelled.select("text", "label").mapInArrow(strengths, "x double, plain double, y int").toPandas()  # three numbers a labelled row
    a, b, c = map(float, fit_curve(points[["x", "plain"]].to_numpy(float), points["y"].to_numpy(float)))
    return lexicon._replace(intercept=a, slope=b, plain_slope=c)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, fold: int = 3, out: int = 1, rows: int = FIT_ROWS) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents outside the held-out fold.

    They are those whose id has the smallest hash, so the choice does not depend on order. Labels
    other than 0 and 1, null ids, and ids labelled in two ways are left out.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), fold) != out))
    own = own.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).alias("_most")).where("label = _most")
    picked = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "label")
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "label")  # at most rows small rows


def score_documents(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from ``threshold``) to the columns ``keep`` of every row.

    Null and empty texts get the score of a text without a match.
    """
    source = docs.select(*keep, docs["text"].alias("_text"))
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    names = [*keep, "score", "predicted"]
    n_keep = len(keep)
    shared = shipped(docs.sparkSession, lexicon)  # at most LEXICON entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared())
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                score = matcher.score(np.array([matcher.strength(t.as_py()) for t in part.column(n_keep)], float).reshape(-1, 2))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:n_keep], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=names)

    return source.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", score double, predicted int")
