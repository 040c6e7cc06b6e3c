"""Range joins over genomic coordinates.

Coordinates are closed integers ``[lo, hi]`` inside a contig; two intervals overlap when they
share at least one position. A bare inequality join would become a nested loop, so both sides
are cut into fixed bins and joined on (contig, bin); the inequality stays as a residual.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragweave.operators import skew
from fragweave.session import durable

BIN = 256
WIDE_BINS = 64
BROADCAST_ROWS = 500_000
SHARED = 4


class Span(NamedTuple):
    """Names of the contig, first and last position columns of an interval table."""

    chrom: str
    lo: str
    hi: str


def bin_range(lo: Column, hi: Column, size: int) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def _levels(df: DataFrame, span: Span, bin_size: int) -> list[int]:
    """Bin sizes needed so that no interval of ``df`` covers more than about WIDE_BINS bins."""
    longest = df.agg(F.max(F.col(span.hi) - F.col(span.lo))).first()[0] or 0
    sizes = [bin_size]
    while longest // sizes[-1] > WIDE_BINS:
        sizes.append(sizes[-1] * WIDE_BINS)
    return sizes


def _own_size(span: Span, sizes: list[int]) -> Column:
    """Smallest bin size at which this interval covers few bins."""
    length = F.col(span.hi) - F.col(span.lo)
    out = F.lit(sizes[-1])
    for size in reversed(sizes[:-1]):
        out = F.when(length <= size * WIDE_BINS, F.lit(size)).otherwise(out)
    return out


def _tagged_bins(lo: Column, hi: Column, size: int) -> Column:
    return F.transform(bin_range(lo, hi, size), lambda b: F.struct(F.lit(size).alias("size"), b.alias("bin")))


def overlap_pairs(left: DataFrame, right: DataFrame, lspan: Span, rspan: Span, *, bin_size: int = BIN,
                  equal: dict[str, str] | None = None, hot_rows: int = skew.HOT_ROWS,
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every overlapping (left, right) pair exactly once.

    Apart from the contig, column names of the two sides must differ. ``equal`` adds
    left-column = right-column equalities (for example strand) to the join key. Long right
    intervals are filed under coarser bins, and left rows probe only the bin sizes in use.

    Where left rows share their intervals (``SHARED`` rows an interval on average), each distinct
    interval is matched once and its rows take the matches by an equality join, which tries no pair in vain and is
    cut into tasks by the pairs it makes.
    """
    equal = equal or {}
    keys = list(dict.fromkeys([*lspan, *equal]))  # points have one column for both ends
    spans = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    n_spans, n_rows = spans.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if (n_rows or 0) < SHARED * n_spans:
        return _overlap(left, right, lspan, rspan, bin_size, equal, hot_rows, broadcast_rows)
    spans = durable(spans, "spans")
    found = _overlap(spans.drop("_n"), right, lspan, rspan, bin_size, equal, hot_rows, broadcast_rows)
    known = left.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return skew.attach_all(known, spans, found, keys, hot_rows, broadcast_rows)


def _overlap(left: DataFrame, right: DataFrame, lspan: Span, rspan: Span, bin_size: int, equal: dict[str, str], hot_rows: int,
             broadcast_rows: int) -> DataFrame:
    """The pairs by bins."""
    sizes = _levels(right, rspan, bin_size)
    lo, hi = F.col(lspan.lo), F.col(lspan.hi)
    probes = [_tagged_bins(lo, hi, s) for s in sizes]
    probe = probes[0] if len(probes) == 1 else F.flatten(F.array(*probes))
    lhs = left.withColumn("_p", F.explode(probe)).withColumns({"_size": F.col("_p.size"), "_bin": F.col("_p.bin")}).drop("_p")
    own = _own_size(rspan, sizes)
    rhs = right.withColumn("_size", own)
    rhs = rhs.withColumn(
        "_bin",
        F.explode(F.sequence(F.floor(F.col(rspan.lo) / F.col("_size")), F.floor(F.col(rspan.hi) / F.col("_size")))),
    )
    renamed = {r: l for l, r in equal.items() if l != r}
    if rspan.chrom != lspan.chrom:
        renamed[rspan.chrom] = lspan.chrom
    for old, new in renamed.items():
        rhs = rhs.withColumnRenamed(old, new)
    keys = [lspan.chrom, "_size", "_bin", *equal]
    if skew.is_small(rhs, broadcast_rows):
        # The left rows are not shuffled, so no bin can be too hot.
        joined = lhs.join(F.broadcast(rhs), keys)
    else:
        lhs, rhs = skew.spread(lhs, rhs, keys, skew.hot_keys(lhs, keys, hot_rows))
        joined = lhs.join(rhs.hint("merge"), [*keys, skew.SALT]).drop(skew.SALT)
    first = F.greatest(F.floor(lo / F.col("_size")), F.floor(F.col(rspan.lo) / F.col("_size")))
    return joined.where((lo <= F.col(rspan.hi)) & (F.col(rspan.lo) <= hi) & (F.col("_bin") == first)).drop(
        "_size", "_bin"
    )


def _cover(regions: DataFrame, rspan: Span, bin_size: int, pad: int = 0) -> DataFrame:
    """Regions clipped to bins, one row per (bin, first position): at most ``bin_size`` rows a bin.

    With ``pad`` a region is also filed under earlier bins that a probe of length ``pad`` starting
    there could reach it from; such copies are not clipped at the left.
    """
    lo, hi = F.col(rspan.lo), F.col(rspan.hi)
    binned = regions.select(
        F.col(rspan.chrom).alias("_c"), lo.alias("_rlo"), hi.alias("_rhi"),
        F.explode(bin_range(lo - pad, hi, bin_size)).alias("_bin"),
    )
    start, end = F.col("_bin") * bin_size, F.col("_bin") * bin_size + bin_size - 1 + pad
    return (
        binned.withColumns({"_rlo": F.greatest("_rlo", start), "_rhi": F.least("_rhi", end)})
        .groupBy("_c", "_bin", "_rlo")
        .agg(F.max("_rhi").alias("_rhi"))
    )


def _hit_sites(sites: DataFrame, regions: DataFrame, span: Span, rspan: Span, bin_size: int) -> DataFrame:
    cover = skew.sized(_cover(regions, rspan, bin_size), BROADCAST_ROWS)
    probe = sites.withColumn("_bin", F.explode(bin_range(F.col(span.lo), F.col(span.hi), bin_size)))
    meets = (
        (probe[span.chrom] == cover["_c"]) & (probe["_bin"] == cover["_bin"])
        & (probe[span.lo] <= cover["_rhi"]) & (cover["_rlo"] <= probe[span.hi])
    )
    return probe.join(cover, meets, "left_semi").select(*span).distinct()


def _existence(rows: DataFrame, regions: DataFrame, span: Span, rspan: Span, how: str, *, bin_size: int,
               row_length: int | None, hot_rows: int, broadcast_rows: int) -> DataFrame:
    if row_length is not None:
        cover = _cover(regions, rspan, bin_size, pad=row_length)
        if skew.is_small(cover, broadcast_rows):
            # Rows stay where they are: each is filed under the bin of its first position.
            lo, hi = F.col(span.lo), F.col(span.hi)
            home = F.when(hi - lo <= row_length, F.floor(lo / bin_size)).otherwise(
                F.raise_error(F.lit(f"interval longer than the declared row_length {row_length}")).cast("bigint")
            )
            probe = rows.withColumn("_home", home)
            meets = (
                (probe[span.chrom] == cover["_c"]) & (probe["_home"] == cover["_bin"])
                & (probe[span.lo] <= cover["_rhi"]) & (cover["_rlo"] <= probe[span.hi])
            )
            return probe.join(F.broadcast(cover), meets, how).drop("_home")
    sites = rows.groupBy(*span).agg(F.count(F.lit(1)).alias("_n"))
    hits = _hit_sites(sites.select(*span), regions, span, rspan, bin_size)
    hot = skew.hot_keys(sites, list(span), hot_rows, weight="_n")
    return skew.attach(rows, hits, list(span), how, hot_rows, hot)


def overlap_semi(rows: DataFrame, regions: DataFrame, span: Span, rspan: Span, *, bin_size: int = BIN,
                 row_length: int | None = None, hot_rows: int = skew.HOT_ROWS,
                 broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows that overlap at least one region; contigs without regions lose all their rows.

    ``row_length`` (largest ``hi - lo`` of a row) allows the plan that does not shuffle the rows,
    taken when the regions are few enough to broadcast.
    """
    return _existence(rows, regions, span, rspan, "left_semi", bin_size=bin_size, row_length=row_length,
                      hot_rows=hot_rows, broadcast_rows=broadcast_rows)


def overlap_anti(rows: DataFrame, regions: DataFrame, span: Span, rspan: Span, *, bin_size: int = BIN,
                 row_length: int | None = None, hot_rows: int = skew.HOT_ROWS,
                 broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows that overlap no region; contigs without regions keep all their rows."""
    return _existence(rows, regions, span, rspan, "left_anti", bin_size=bin_size, row_length=row_length,
                      hot_rows=hot_rows, broadcast_rows=broadcast_rows)


def overlap_flags(rows: DataFrame, tracks: dict[str, DataFrame], span: Span, rspan: Span, *, bin_size: int = BIN,
                  hot_rows: int = skew.HOT_ROWS, unique: bool = False) -> DataFrame:
    """One 0/1 column per named track, computed once per distinct site and attached to the rows (``unique``: each row is a site)."""
    sites = rows.groupBy(*span).agg(F.count(F.lit(1)).alias("_n"))
    flagged = sites.select(*span)
    for name, regions in tracks.items():
        hits = _hit_sites(sites.select(*span), regions, span, rspan, bin_size).withColumn(name, F.lit(1))
        flagged = flagged.join(hits, list(span), "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    hot = None if unique else skew.hot_keys(sites, list(span), hot_rows, weight="_n")
    return skew.attach(rows, flagged, list(span), "left", hot_rows, hot)
