"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words (runs of letters, of digits or of other signs) are hashed into bins, and every bin has a fixed
sparse ternary index vector. A bin's word vector sums the index vectors of the words around all its
occurrences in all documents. A document is the mean and the spread of the vectors of its words. A
network with one hidden layer, trained in numpy on a bounded sample of labelled documents, scores
it; a temperature fitted on rows kept out of the training calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragweave.llm.common import shipped
from fragweave.llm.textkernel import chunks, mix, runs, span_hashes

BITS, DIMS, NONZERO, WINDOW = 14, 32, 4, 2
BINS = 1 << BITS
#: Bound of the fit: labelled documents used.
FIT_ROWS = 8_000
FEATURES = 2 * DIMS + 2

KIND = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 other
KIND[[32, 9, 10, 11, 12, 13]] = 0
KIND[65:91] = KIND[97:123] = KIND[128:] = 1
KIND[48:58] = 2


class Network(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return (np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2) / self.temperature


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the non-zero entries of every bin's index vector."""
    h = mix(np.arange(BINS * NONZERO, dtype=np.uint64) + np.uint64(99)).reshape(BINS, NONZERO)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the words of a chunk and, for each row, where its words begin."""
    kind = KIND[data]
    if not len(kind):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    new = np.ones(len(kind), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[offsets < len(kind)]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(kind))
    word = kind[start] > 0
    start, end = start[word], end[word]
    return (span_hashes(data, start, end) >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(start, offsets)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of context index vectors per bin, over all documents of the task."""
    place, sign = index_vectors()
    total, count = np.zeros(BINS * DIMS), np.zeros(BINS, np.int64)
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            bins, bounds = tokens(data, offsets)
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
            count += np.bincount(bins, minlength=BINS)
            for gap in range(1, WINDOW + 1):
                same = doc[gap:] == doc[:-gap]
                left, right = bins[:-gap][same], bins[gap:][same]
                for a, b in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        total += np.bincount(a * DIMS + place[b, k], weights=sign[b, k], minlength=BINS * DIMS)
    used = np.flatnonzero(count)
    sums = np.rint(total).astype(np.int64).reshape(BINS, DIMS)[used]
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array(count[used]), *(pa.array(np.ascontiguousarray(sums[:, d])) for d in range(DIMS))],
        names=["bin", "n", *(f"c{d}" for d in range(DIMS))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BINS x DIMS unit vectors from all documents; a bin that never occurs has its index vector."""
    cols = [f"c{d}" for d in range(DIMS)]
    summed = docs.select("text").where("text is not null").mapInArrow(_contexts, "bin int, n bigint, " + ", ".join(f"{c} bigint" for c in cols))
    found = summed.groupBy("bin").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in cols)).toPandas()  # one row a bin
    place, sign = index_vectors()
    own = np.zeros((BINS, DIMS))
    np.add.at(own, (np.arange(BINS)[:, None], place), sign)
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    vectors = own.copy()
    if len(found):
        at, n = found["bin"].to_numpy(), found["n"].to_numpy(float)[:, None]
        sums = found[cols].to_numpy(float)
        context = sums / n - sums.sum(0) / n.sum()  # what is said around this word beyond what is said around all words
        context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
        both = context + own[at]
        vectors[at] = both / np.maximum(np.linalg.norm(both, axis=1, keepdims=True), 1e-9)
    return vectors.astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of every row, the share of words with the vector of the word before, and the logarithm of its words."""
    out = np.zeros((len(column), FEATURES), np.float32)
    for lo, hi, data, offsets in chunks(column):
        bins, bounds = tokens(data, offsets)
        for row, a, b in zip(range(lo, hi), bounds[:-1], bounds[1:], strict=True):
            if b > a:
                at, times = np.unique(bins[a:b], return_counts=True)
                v, share = vectors[at], (times / (b - a)).astype(np.float32)
                mean = share @ v
                out[row, :DIMS] = mean
                out[row, DIMS:2 * DIMS] = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
                out[row, -2] = np.count_nonzero(bins[a + 1:b] == bins[a:b - 1]) / (b - a)
                out[row, -1] = np.log1p(b - a)
    return out


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 300, rate: float = 0.02, decay: float = 1e-4) -> Network:
    """Full-batch Adam on the log loss; the last fifth of the rows sets the temperature."""
    rng = np.random.default_rng(5)
    x = x.astype(float)
    centre, scale = x.mean(0), x.std(0) + 1e-3
    cut = max(1, len(x) * 4 // 5)
    own, target = (x[:cut] - centre) / scale, y[:cut].astype(float)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, epochs + 1):
        h = np.tanh(own @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - target) / len(own)
        back = np.outer(d, p[2]) * (1 - h * h)
        grads = [own.T @ back + decay * p[0], back.sum(0), h.T @ d + decay * p[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            p[i] -= rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    net = Network(centre, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    held, truth = (x[cut:], y[cut:]) if cut < len(x) else (x, y)
    z = net.logit(held)
    loss = lambda t: float(np.mean(np.logaddexp(0, -np.where(truth > 0, z, -z) / t)))
    return net._replace(temperature=float(min(np.exp(np.linspace(-1.5, 3, 181)), key=loss)))


def fit(labelled: DataFrame, vectors: np.ndarray) -> Network:
    """Train on rows (text, label), whose number the caller bounds.

    If they are none, or of one label, the network gives that label's smoothed share everywhere.
    """
    shared = labelled.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(0), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32())), batch.column(1)], names=["x", "y"])

    rows = labelled.select("text", "label").mapInArrow(features, "x array<float>, y int").toPandas()  # FEATURES numbers a labelled row
    y = rows["y"].to_numpy(int)
    if len(set(y)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    x = np.stack(rows["x"].to_numpy())
    order = np.lexsort((*x.T[::-1], y))  # the order rows arrive in must not matter
    order = order[np.random.default_rng(3).permutation(len(order))]
    return train_network(x[order], y[order])


def score_documents(docs: DataFrame, vectors: np.ndarray, net: Network, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Add score (probability of label 1) and predicted (1 from one half) to the columns ``keep``.

    Every row is scored by its whole text; null and empty texts have no words and the features zero.
    """
    source = docs.select(*keep, docs["text"].alias("_text"))
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    n_keep, names = len(keep), [*keep, "score", "predicted"]
    shared = shipped(docs.sparkSession, (vectors, net))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vec, own = shared()
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(own.logit(pooled(batch.column(n_keep), vec).astype(float)), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n_keep], pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=names)

    return source.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", score double, predicted int")
