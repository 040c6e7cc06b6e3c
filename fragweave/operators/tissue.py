"""Mixture of reference tissues in a sample.

Spark turns the window matrices into the Gram matrix and the right-hand side; what is left on the
driver is a quadratic program in as many unknowns as there are tissues.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragweave.functions.numeric import linear_quantile
from fragweave.session import durable

MIN_DEPTH = 10
CUT = 0.1
NEGLIGIBLE = 0.001


def window_levels(counts: DataFrame, key: list[str], sample: str, methylated: str, coverage: str, width: int = 1000) -> DataFrame:
    """Methylation level per window and sample; windows with too little coverage become null."""
    level = F.when(F.col(coverage) * width >= MIN_DEPTH, F.try_divide(F.col(methylated), F.col(coverage)))
    return counts.select(*key, sample, level.alias("level"))


def window_variability(levels: DataFrame, key: list[str], quantile: float = 0.99) -> DataFrame:
    """Deviation of every window across samples, and ``variable``: whether it exceeds the quantile of all of them.

    The cut is exact and found by counting passes, not by collecting deviations; the deviations are
    written once so that a pass does not repeat the aggregation.
    """
    sd = levels.groupBy(*key).agg(F.stddev_samp("level").alias("sd"), F.count("level").alias("n_level"), F.count(F.lit(1)).alias("n_sample"))
    sd = durable(sd, "deviations")
    cut = linear_quantile(sd, "sd", quantile)
    return sd.withColumn("variable", F.coalesce(F.col("sd") > cut, F.lit(False)))


def most_variable(levels: DataFrame, key: list[str], quantile: float = 0.99) -> DataFrame:
    """Windows whose deviation across samples exceeds the quantile of all window deviations."""
    return window_variability(levels, key, quantile).where("variable").drop("variable")


def binary(level):
    """1 from 0.1 on, else 0."""
    return F.when(level >= CUT, 1.0).otherwise(0.0)


def complete_windows(levels: DataFrame, key: list[str]) -> DataFrame:
    """Keys of windows with a level in every sample."""
    t = levels.groupBy(*key).agg(F.count("level").alias("_k"), F.count(F.lit(1)).alias("_n"))
    return t.where(F.col("_k") == F.col("_n")).select(*key)


def wide_matrix(levels: DataFrame, key: list[str], sample: str, samples: list, name: str) -> DataFrame:
    """One row per complete window with an array column of levels in the order of ``samples``."""
    entry = F.map_from_entries(F.collect_list(F.struct(F.col(sample).alias("k"), F.col("level").alias("v"))))
    t = levels.where(F.col(sample).isin(samples)).groupBy(*key).agg(entry.alias("_m"))
    row = F.array(*[F.try_element_at("_m", F.lit(s)) for s in samples])
    t = t.select(*key, row.alias(name))
    return t.where(~F.exists(name, lambda v: v.isNull() | F.isnan(v)))


def cross_products(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Entries (i, j, value) of X' Y for two array columns of fixed width.

    Each task multiplies its own batches, so the shuffle carries one small matrix per task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows == 0:
                continue
            x, y = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1) for c in (0, 1))
            part = x.T @ y
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "value"])

    parts = rows.select(F.col(left).alias("l"), F.col(right).alias("r")).mapInArrow(work, "i int, j int, value double")
    return parts.groupBy("i", "j").agg(F.sum("value").alias("value"))


def _dense(entries: DataFrame, rows: int, cols: int) -> np.ndarray:
    out = np.zeros((rows, cols))
    for i, j, v in entries.select("i", "j", "value").collect():  # rows x cols entries
        out[i, j] = v
    return out


def simplex_least_squares(gram: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """argmin 1/2 b' G b - d' b with b >= 0 and sum b = 1, by an active-set method."""
    p = len(rhs)
    scale = float(np.abs(gram).max()) or 1.0
    g, d = gram / scale, rhs / scale
    start = int(np.argmin(0.5 * np.diag(g) - d))
    b = np.zeros(p)
    b[start] = 1.0
    free = np.zeros(p, bool)
    free[start] = True
    for _ in range(50 * p + 50):
        idx = np.flatnonzero(free)
        k = len(idx)
        kkt = np.zeros((k + 1, k + 1))
        kkt[:k, :k], kkt[:k, k], kkt[k, :k] = g[np.ix_(idx, idx)], 1.0, 1.0
        sol = np.linalg.lstsq(kkt, np.append(d[idx], 1.0), rcond=None)[0]
        step = sol[:k] - b[idx]
        falling = step < 0
        ratio = np.full(k, np.inf)
        ratio[falling] = -b[idx][falling] / step[falling]
        reach = ratio.min() if k else np.inf
        if reach < 1.0:
            b[idx] += reach * step
            out = idx[int(np.argmin(ratio))]
            b[out], free[out] = 0.0, False
            continue
        b[idx] = sol[:k]
        grad = g @ b - d
        level = float(grad[idx].mean())
        slack = np.where(free, np.inf, grad - level)
        worst = int(np.argmin(slack))
        if slack[worst] >= -1e-10:
            break
        free[worst] = True
    b = np.clip(b, 0.0, None)
    return b / b.sum()


def tissue_fractions(reference: DataFrame, cfdna: DataFrame, key: list[str], tissues: list, samples: list) -> DataFrame:
    """Fractions of every tissue in every sample.

    ``reference``: key, array ``x`` per window (one entry per tissue); ``cfdna``: key, array ``y``
    (one entry per sample). Windows in both are used; fractions below 0.001 become 0.
    """
    both = reference.join(cfdna, key)
    gram = _dense(cross_products(both, "x", "x"), len(tissues), len(tissues))
    rhs = _dense(cross_products(both, "x", "y"), len(tissues), len(samples))
    rows = []
    for s, name in enumerate(samples):
        b = simplex_least_squares(gram, rhs[:, s])
        rows += [(name, t, float(v if v >= NEGLIGIBLE else 0.0)) for t, v in zip(tissues, b)]
    kinds = {int: "int", str: "string"}
    schema = f"sample {kinds[type(samples[0])]}, tissue {kinds[type(tissues[0])]}, fraction double"
    return reference.sparkSession.createDataFrame(rows, schema)
