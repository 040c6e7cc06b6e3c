"""Values of signal tracks summed over a window around each site.

Joining a site with every track position in its window multiplies rows by the window width. The
sums come instead from running totals inside bins: each site asks for two points per bin it
touches, so the work is linear in sites plus track rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragweave.operators import skew
from fragweave.operators.intervals import Span, bin_range


def _running(events: DataFrame, asks: DataFrame, measures: list[str]) -> DataFrame:
    """Running totals of the event measures at each asked position of a bin, the position included."""
    both = events.withColumn("_ask", F.lit(0)).unionByName(asks.withColumn("_ask", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy("_c", "_bin").orderBy("_pos", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    run = both.select(*asks.columns, "_ask", *[F.coalesce(F.sum(m).over(upto), F.lit(0)).alias(m) for m in measures])
    return run.where(F.col("_ask") == 1).drop("_ask")


def _asks(windows: DataFrame, keys: list[str], bin_size: int) -> DataFrame:
    """Two asked positions per window and bin: its last position (+) and, in its first bin, the one before it (-)."""
    per_bin = windows.select(*keys, "_c", "_qlo", "_qhi", F.explode(bin_range(F.col("_qlo"), F.col("_qhi"), bin_size)).alias("_bin"))
    first = F.col("_bin") == F.floor(F.col("_qlo") / bin_size)
    last = F.least(F.col("_qhi"), F.col("_bin") * bin_size + bin_size - 1)
    asks = F.array(
        F.struct(last.cast("long").alias("_pos"), F.lit(1).alias("_sign")),
        F.struct(F.when(first, F.col("_qlo") - 1).otherwise(F.col("_bin") * bin_size - 1).cast("long").alias("_pos"),
                 F.lit(-1).alias("_sign")),
    )
    return per_bin.select(*keys, "_c", "_bin", first.alias("_first"), F.explode(asks).alias("_a")).select(
        *keys, "_c", "_bin", "_first", "_a._pos", "_a._sign"
    )


def window_record_stats(sites: DataFrame, track: DataFrame, span: Span, tspan: Span, value: str, ext: int, *,
                        bin_size: int | None = None, copies: bool = True) -> DataFrame:
    """Number ``n`` and sum ``total`` of the track records that overlap ``[lo - ext, hi + ext]``.

    ``sites`` must be distinct on ``span``. Records with a missing value are left out; each record
    counts once however long it is. The window starts at position 1 at the least. Where few records
    share both ends (``copies=False``) only their ends are combined, of which a bin has no more than positions.
    """
    size = bin_size or max(4096, 4 * ext)
    windows = sites.select(
        *span, F.col(span.chrom).alias("_c"), F.greatest(F.lit(1), F.col(span.lo) - ext).cast("long").alias("_qlo"),
        (F.col(span.hi) + ext).cast("long").alias("_qhi"))
    asks = _asks(windows, list(span), size)
    v = F.col(value).cast("double")
    rec = track.where(v.isNotNull() & ~F.isnan(v)).select(
        F.col(tspan.chrom).alias("_c"), F.col(tspan.lo).cast("long").alias("_lo"), F.col(tspan.hi).cast("long").alias("_hi"),
        v.alias("_v"))
    if copies:
        rec = rec.groupBy("_c", "_lo", "_hi").agg(F.sum("_v").alias("_v"), F.count(F.lit(1)).alias("_k"))
    else:
        rec = rec.withColumn("_k", F.lit(1).cast("long"))
    rec = rec.withColumn("_bin", F.explode(bin_range(F.col("_lo"), F.col("_hi"), size)))
    starts_here = F.floor(F.col("_lo") / size) == F.col("_bin")
    begin = F.greatest(F.col("_lo"), F.col("_bin") * size)
    end = F.least(F.col("_hi"), F.col("_bin") * size + size - 1)
    zero_v, zero_k = F.lit(0.0), F.lit(0).cast("long")
    # Opened: all records of the bin; started: those that begin in it; closed: those over before the asked point.
    marks = F.array(
        F.struct(begin.alias("_pos"), F.col("_v").alias("open_v"), F.col("_k").alias("open_k"),
                 F.when(starts_here, F.col("_v")).otherwise(zero_v).alias("start_v"),
                 F.when(starts_here, F.col("_k")).otherwise(zero_k).alias("start_k"),
                 zero_v.alias("close_v"), zero_k.alias("close_k")),
        F.struct(end.alias("_pos"), zero_v.alias("open_v"), zero_k.alias("open_k"), zero_v.alias("start_v"),
                 zero_k.alias("start_k"), F.col("_v").alias("close_v"), F.col("_k").alias("close_k")),
    )
    measures = ["open_v", "open_k", "start_v", "start_k", "close_v", "close_k"]
    events = (
        rec.select("_c", "_bin", F.explode(marks).alias("_m")).select("_c", "_bin", "_m.*")
        .groupBy("_c", "_bin", "_pos").agg(*[F.sum(m).alias(m) for m in measures])
    )
    run = _running(events, asks, measures)
    plus = F.col("_sign") == 1

    def part(kind: str):
        return F.when(plus & F.col("_first"), F.col(f"open_{kind}")).when(plus, F.col(f"start_{kind}")).when(
            F.col("_first"), -F.col(f"close_{kind}")).otherwise(F.lit(0))

    return run.groupBy(*span).agg(F.sum(part("k")).cast("long").alias("n"), F.sum(part("v")).alias("total"))


def window_base_stats(sites: DataFrame, track: DataFrame, span: Span, tspan: Span, value: str, ext: int, *,
                      bin_size: int | None = None) -> DataFrame:
    """Per-base statistics of an interval track over ``[lo - ext, hi + ext]``.

    Every covered base counts once with the value of its interval, as in a bigWig summary:
    ``n`` covered bases and ``total`` sum over them.
    """
    size = bin_size or max(4096, 4 * ext)
    windows = sites.select(
        *span, F.col(span.chrom).alias("_c"), F.greatest(F.lit(1), F.col(span.lo) - ext).cast("long").alias("_qlo"),
        (F.col(span.hi) + ext).cast("long").alias("_qhi"))
    asks = _asks(windows, list(span), size)
    v = F.col(value).cast("double")
    rec = track.where(v.isNotNull() & ~F.isnan(v)).select(
        F.col(tspan.chrom).alias("_c"), F.col(tspan.lo).cast("long").alias("_lo"), F.col(tspan.hi).cast("long").alias("_hi"),
        v.alias("_v"))
    rec = rec.withColumn("_bin", F.explode(bin_range(F.col("_lo"), F.col("_hi"), size)))
    base = F.col("_bin") * size
    begin, end = F.greatest(F.col("_lo"), base), F.least(F.col("_hi"), base + size - 1)
    # A covered stretch is a change of slope at its two ends; totals are slope * position - offset.
    marks = F.array(*[
        F.struct(pos.alias("_pos"), (sign * F.col("_v")).alias("sv"), F.lit(sign).cast("long").alias("sk"),
                 (sign * F.col("_v") * (pos - base)).alias("ov"), (sign * (pos - base)).cast("long").alias("ok"))
        for pos, sign in ((begin, 1), (end + 1, -1))
    ])
    measures = ["sv", "sk", "ov", "ok"]
    events = (
        rec.select("_c", "_bin", F.explode(marks).alias("_m")).select("_c", "_bin", "_m.*")
        .groupBy("_c", "_bin", "_pos").agg(*[F.sum(m).alias(m) for m in measures])
    )
    run = _running(events, asks, measures)
    x = F.col("_pos") - F.col("_bin") * size + 1
    return run.groupBy(*span).agg(
        F.sum(F.col("_sign") * (x * F.col("sk") - F.col("ok"))).cast("long").alias("n"),
        F.sum(F.col("_sign") * (x * F.col("sv") - F.col("ov"))).alias("total"),
    )


def window_mean(stats: DataFrame, name: str, ext: int, *, over_width: bool = False) -> DataFrame:
    """Turn ``n`` and ``total`` into one column: the mean, or the sum over the window width
    (``over_width``); missing when nothing overlaps."""
    mean = F.col("total") / (2 * ext + 1) if over_width else F.try_divide(F.col("total"), F.col("n"))
    return stats.withColumn(name, F.when(F.col("n") > 0, mean)).drop("n", "total")


def attach_track_values(rows: DataFrame, tracks: dict[str, tuple[DataFrame, int]], span: Span, tspan: Span, value: str, *,
                        per_base: bool = False, hot_rows: int = skew.HOT_ROWS, unique: bool = False) -> DataFrame:
    """One column per named track. A negative extension asks for the sum over the window width.

    ``unique`` says that no two rows share a site, so that none has to be looked for that many share.
    """
    sites = rows.groupBy(*span).agg(F.count(F.lit(1)).alias("_n"))
    values = sites.select(*span)
    stats_of = window_base_stats if per_base else window_record_stats
    for name, (track, ext) in tracks.items():
        stats = stats_of(sites.select(*span), track, span, tspan, value, abs(ext))
        values = values.join(window_mean(stats, name, abs(ext), over_width=ext < 0), list(span), "left")
    hot = None if unique else skew.hot_keys(sites, list(span), hot_rows, weight="_n")
    return skew.attach(rows, values, list(span), "left", hot_rows, hot)
