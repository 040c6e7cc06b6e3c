"""Statistics as Spark columns: correlation from sums, its p-value, percentiles, exact ranks."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pearson_from_sums(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson r from additive sums; null with fewer than two points or no variance."""
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((n >= 2) & (vx > 0) & (vy > 0), F.try_divide(n * sxy - sx * sy, F.sqrt(vx) * F.sqrt(vy)))


def _beta_fraction(a: np.ndarray | float, b: np.ndarray | float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, all elements at once."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    out[np.isinf(t) & (df > 0)] = 0.0
    if not ok.any():
        return out
    tt, nu = t[ok] ** 2, df[ok]
    x = nu / (nu + tt)
    a, b = nu / 2.0, 0.5
    lg = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(lg(a + b) - lg(a) - math.lgamma(b) + a * np.log(x) + b * np.log1p(-x))
    direct = x < (a + 1.0) / (a + b + 2.0)
    res = np.empty_like(x)
    if direct.any():
        res[direct] = front[direct] * _beta_fraction(a[direct], b, x[direct]) / a[direct]
    rest = ~direct
    if rest.any():
        # Where the fraction converges slowly, use I_x(a, b) = 1 - I_{1-x}(b, a).
        y, aa = 1.0 - x[rest], a[rest]
        res[rest] = 1.0 - front[rest] * _beta_fraction(b, aa, y) / b
    out[ok] = np.clip(res, 0.0, 1.0)
    return out


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of Pearson r over n points; null where r is null or n < 3."""

    @F.pandas_udf("double")
    def p_value(rs: pd.Series, ns: pd.Series) -> pd.Series:
        rv, nv = rs.to_numpy(float, na_value=np.nan), ns.to_numpy(float, na_value=np.nan)
        df = nv - 2.0
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.abs(rv) * np.sqrt(df / (1.0 - rv * rv))
        t = np.where(np.abs(rv) >= 1.0, np.inf, t)
        out = student_two_sided(t, df)
        return pd.Series(out).astype("Float64").where(~np.isnan(out)).astype(object).where(~np.isnan(out), None)

    return p_value(r, n)


def values_at_ranks(df: DataFrame, value: str, ranks: Sequence[int], group: str | None = None,
                    group_ranks: dict | None = None) -> dict:
    """Exact order statistics without sorting or collecting the data.

    Each pass counts rows in buckets of a shrinking value range and keeps the bucket that holds
    the rank, so a pass is one aggregation with a small result whatever the number of rows.
    Ranks are 1-based. Without ``group`` the answer is {rank: value}; with it, ``group_ranks``
    gives the ranks of each (bounded) group and the answer is {(group, rank): value}.
    """
    if group is None:
        df, group, group_ranks = df.withColumn("_g", F.lit(0)), "_g", {0: list(ranks)}
        plain = True
    else:
        plain = False
    spark = df.sparkSession
    data = df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    wanted = spark.createDataFrame([(g,) for g in group_ranks], data.select("_g").schema)
    ends = data.join(F.broadcast(wanted), "_g", "left_semi").groupBy("_g").agg(F.min("_v"), F.max("_v")).collect()
    open_ = {(g, r): (lo, hi, 0) for g, lo, hi in ends for r in group_ranks[g]}
    done: dict = {}
    while open_:
        for key, (lo, hi, _) in list(open_.items()):
            if lo == hi:
                done[key] = lo
                del open_[key]
        if not open_:
            break
        buckets = max(16, min(1024, 200_000 // len(open_)))
        table = spark.createDataFrame([(i, g, lo, hi) for i, ((g, _), (lo, hi, _)) in enumerate(open_.items())],
                                      "_i int, _g " + data.schema["_g"].dataType.simpleString() + ", _lo double, _hi double")
        v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
        # Halving before subtracting keeps the width finite for any pair of doubles.
        share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")
        hist = (
            data.join(F.broadcast(table), "_g").where((v >= lo) & (v <= hi))
            .groupBy("_i", bucket.alias("_b")).agg(F.count(F.lit(1)), F.min("_v"), F.max("_v")).collect()
        )
        by_slot: dict = {}
        for i, b, n, mn, mx in hist:
            by_slot.setdefault(i, []).append((b, n, mn, mx))
        for i, (key, (_, _, below)) in enumerate(list(open_.items())):
            for _, n, mn, mx in sorted(by_slot[i]):
                if below + n >= key[1]:
                    open_[key] = (mn, mx, below)
                    break
                below += n
            else:
                raise ValueError(f"rank {key[1]} exceeds the number of values")
    return {r: v for (_, r), v in done.items()} if plain else done


def linear_quantile(df: DataFrame, value: str, q: float) -> float | None:
    """Exact quantile of a whole column, linear between the ranks around 1 + q (n - 1)."""
    n = df.where(F.col(value).isNotNull()).count()
    if n == 0:
        return None
    pos = q * (n - 1)
    low = math.floor(pos)
    ranks = sorted({low + 1, min(low + 2, n)})
    at = values_at_ranks(df, value, ranks)
    a, b = at[ranks[0]], at[ranks[-1]]
    return a + (pos - low) * (b - a)
