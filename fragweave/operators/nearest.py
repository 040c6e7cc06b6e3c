"""Nearest-neighbour joins along a contig.

Sorting a whole contig in one task does not scale, so points are sorted inside fixed bins only.
What lies before or after a bin comes from a table with one row per occupied bin, which holds the
first and last feature of the bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragweave.operators import skew
from fragweave.operators.intervals import Span

BIN = 1 << 16
NO_FEATURE = 2147483647


def interval_distance(a_lo: Column, a_hi: Column, a_strand: Column, b_lo: Column, b_hi: Column) -> Column:
    """Signed distance from feature ``a`` to interval ``b``.

    Zero when an end of ``b`` lies inside ``a``; otherwise the endpoint difference of least size
    (the first one on ties), negated for ``-`` features and without sign for unstranded ones.
    """
    touches = b_lo.between(a_lo, a_hi) | b_hi.between(a_lo, a_hi)
    return F.when(touches, F.lit(0)).otherwise(_signed(a_lo, a_hi, a_strand, b_lo, b_hi)).cast("int")


def _signed(a_lo, a_hi, a_strand, b_lo, b_hi) -> Column:
    gaps = [b_lo - a_lo, b_lo - a_hi, b_hi - a_lo, b_hi - a_hi]
    size = F.least(*[F.abs(g) for g in gaps])
    gap = F.coalesce(*[F.when(F.abs(g) == size, g) for g in gaps])
    return F.when(a_strand == "-", -gap).when(a_strand == "+", gap).otherwise(size)


def stranded_interval_distance(a_contig: Column, a_lo: Column, a_hi: Column, a_strand: Column, b_contig: Column,
                               b_lo: Column, b_hi: Column) -> Column:
    """Distance of two located intervals: abutting is 0, different contigs the sentinel."""
    abuts = (a_lo == b_hi + 1) | (b_lo == a_hi + 1)
    gap = _signed(a_lo, a_hi, F.when(a_strand == "-", "-").otherwise("+"), b_lo, b_hi)
    return (
        F.when(F.upper(a_contig) != F.upper(b_contig), F.lit(NO_FEATURE))
        .when(abuts, F.lit(0)).otherwise(gap).cast("int")
    )


def neighbours(sites: DataFrame, features: DataFrame, span: Span, fspan: Span, payload: list[str] | None = None, *,
               before: int = 0, after: int = 0, bin_size: int = BIN) -> DataFrame:
    """Add structs ``up`` and ``down``: the last feature at or before each site shifted down by
    ``before`` and the first feature at or after the site shifted up by ``after``, in (lo, hi) order.

    ``sites`` must be distinct on ``span``. Structs hold ``lo``, ``hi`` and the payload columns.
    """
    payload = payload or []
    feat = features.groupBy(F.col(fspan.chrom).alias("_c"), F.col(fspan.lo).cast("long").alias("_lo"),
                            F.col(fspan.hi).cast("long").alias("_hi"))
    feat = feat.agg(*[F.min(c).alias(c) for c in payload]) if payload else feat.agg(F.lit(1).alias("_one"))
    item = F.struct(F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), *payload)
    feat = feat.select("_c", "_lo", "_hi", item.alias("_f"))
    binned = feat.withColumn("_bin", F.floor(F.col("_lo") / bin_size))

    shifts = {"up": -before, "down": after}
    probes = [("both", 0)] if before == after == 0 else list(shifts.items())
    site = F.struct(*[F.col(c) for c in sites.columns])
    points = None
    for side, shift in probes:
        part = sites.select(
            F.col(span.chrom).alias("_c"), (F.col(span.lo) + shift).cast("long").alias("_lo"),
            (F.col(span.hi) + shift).cast("long").alias("_hi"), F.lit(side).alias("_side"), site.alias("_s"),
        )
        points = part if points is None else points.unionByName(part)
    points = points.withColumn("_bin", F.floor(F.col("_lo") / bin_size))

    edge = binned.groupBy("_c", "_bin").agg(F.min("_f").alias("_first"), F.max("_f").alias("_last"))
    bins = edge.unionByName(
        points.select("_c", "_bin").distinct(), allowMissingColumns=True
    ).groupBy("_c", "_bin").agg(F.max("_first").alias("_first"), F.max("_last").alias("_last"))
    along = Window.partitionBy("_c").orderBy("_bin")
    bins = bins.select(
        "_c", "_bin",
        F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev"),
        F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_next"),
    )

    both = binned.unionByName(points, allowMissingColumns=True).withColumn("_is_site", F.col("_f").isNull().cast("int"))
    part = Window.partitionBy("_c", "_bin")
    back = part.orderBy("_lo", "_hi", "_is_site").rowsBetween(Window.unboundedPreceding, 0)
    fwd = part.orderBy(F.desc("_lo"), F.desc("_hi"), "_is_site").rowsBetween(Window.unboundedPreceding, 0)
    near = both.select(
        "_c", "_bin", "_side", "_s",
        F.last("_f", ignorenulls=True).over(back).alias("_up"),
        F.last("_f", ignorenulls=True).over(fwd).alias("_down"),
    ).where(F.col("_s").isNotNull())
    near = near.join(bins, ["_c", "_bin"]).select(
        "_side", "_s", F.coalesce("_up", "_prev").alias("up"), F.coalesce("_down", "_next").alias("down")
    )
    if len(probes) == 1:
        return near.select("_s.*", "up", "down")
    keys = [F.col(f"_s.{c}").alias(c) for c in sites.columns]
    return near.groupBy(*keys).agg(
        F.max(F.when(F.col("_side") == "up", F.col("up"))).alias("up"),
        F.max(F.when(F.col("_side") == "down", F.col("down"))).alias("down"),
    )


def _closest(up: Column, down: Column) -> Column:
    """The distance of least size; the downstream one on ties or when there is no upstream one."""
    return F.when(down.isNull() | (F.abs(up) < F.abs(down)), up).otherwise(down)


def nearest_feature(rows: DataFrame, features: DataFrame, span: Span, fspan: Span, strand: str, name: str, *,
                    bin_size: int = BIN, hot_rows: int = skew.HOT_ROWS, unique: bool = False) -> DataFrame:
    """Signed distance of every row to its nearest feature, computed once per distinct site (``unique``: each row is one)."""
    sites = rows.groupBy(*span).agg(F.count(F.lit(1)).alias("_n"))
    near = neighbours(sites.select(*span), features, span, fspan, [strand], bin_size=bin_size)
    dist = {
        side: interval_distance(F.col(f"{side}.lo"), F.col(f"{side}.hi"), F.col(f"{side}.{strand}"),
                                F.col(span.lo), F.col(span.hi))
        for side in ("up", "down")
    }
    up = F.when(F.col("up").isNotNull(), dist["up"])
    down = F.when(F.col("down").isNotNull(), dist["down"])
    near = near.select(*span, F.coalesce(_closest(up, down), F.lit(NO_FEATURE)).alias(name))
    hot = None if unique else skew.hot_keys(sites, list(span), hot_rows, weight="_n")
    return skew.attach(rows, near, list(span), "left", hot_rows, hot)


def nearest_other_site(sites: DataFrame, all_sites: DataFrame, span: Span, base: str, strand: str, name: str, *,
                       bin_size: int = BIN) -> DataFrame:
    """Distance to the nearest other CpG, skipping the partner base of the same CpG.

    A ``C`` looks back one and ahead two positions, a ``G`` back two and ahead one; sites with
    another reference base are dropped. ``sites`` must be distinct on ``span``.
    """
    reach = {"C": (1, 2), "G": (2, 1)}
    out = None
    for letter, (before, after) in reach.items():
        near = neighbours(sites.where(F.upper(base) == letter), all_sites, span, span, [strand],
                          before=before, after=after, bin_size=bin_size)
        dist = {
            side: F.when(F.col(side).isNotNull(), interval_distance(
                F.col(f"{side}.lo"), F.col(f"{side}.hi"), F.col(f"{side}.{strand}"), F.col(span.lo), F.col(span.hi)))
            for side in ("up", "down")
        }
        part = near.select(*sites.columns, _closest(dist["up"], dist["down"]).alias(name))
        out = part if out is None else out.unionByName(part)
    return out


def nearest_by_rank(sites: DataFrame, span: Span, base: str, name: str, *, bin_size: int = BIN) -> DataFrame:
    """Rank variant: a ``C`` takes the previous site and the one after next, a ``G`` mirrors that.

    Neighbours across a bin border come from a table with two sites per bin end.
    """
    pos = F.struct(F.col(span.lo).cast("long").alias("lo"), F.col(span.hi).cast("long").alias("hi"))
    binned = sites.select(F.col(span.chrom).alias("_c"), F.floor(F.col(span.lo) / bin_size).alias("_bin"),
                          pos.alias("_p"), F.col(base).alias("_b"), F.struct(*sites.columns).alias("_s"))
    inside = Window.partitionBy("_c", "_bin").orderBy("_p")
    edges = (
        binned.select("_c", "_bin", "_p", F.row_number().over(inside).alias("_i"),
                      F.row_number().over(Window.partitionBy("_c", "_bin").orderBy(F.desc("_p"))).alias("_j"))
        .where((F.col("_i") <= 2) | (F.col("_j") <= 2))
    )
    along = Window.partitionBy("_c").orderBy("_p")
    reach = {f"_m{k}": F.lag("_p", k).over(along) for k in (1, 2)} | {f"_q{k}": F.lead("_p", k).over(along) for k in (1, 2)}
    edges = edges.select("_c", "_bin", "_p", *[v.alias(k) for k, v in reach.items()])
    local = {f"_l{k}": F.lag("_p", k).over(inside) for k in (1, 2)} | {f"_r{k}": F.lead("_p", k).over(inside) for k in (1, 2)}
    near = binned.select("*", *[v.alias(k) for k, v in local.items()]).join(edges, ["_c", "_bin", "_p"], "left")
    prev = {k: F.coalesce(F.col(f"_l{k}"), F.col(f"_m{k}")) for k in (1, 2)}
    nxt = {k: F.coalesce(F.col(f"_r{k}"), F.col(f"_q{k}")) for k in (1, 2)}

    def gap(other: Column) -> Column:
        return F.when(other.isNotNull(), F.abs(_signed(other["lo"], other["hi"], F.lit("+"), F.col("_p.lo"), F.col("_p.hi"))))

    base_up = F.upper("_b")
    dist = F.when(base_up == "C", F.least(gap(prev[1]), gap(nxt[2]))).when(base_up == "G", F.least(gap(prev[2]), gap(nxt[1])))
    return near.select("_s.*", dist.cast("int").alias(name))
