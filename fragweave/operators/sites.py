"""Reads and fragments brought to sites, and what is reported per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragweave.functions import reads as R
from fragweave.operators import skew
from fragweave.operators.intervals import BIN, Span, overlap_pairs
from fragweave.operators.tracks import window_record_stats
from fragweave.session import durable

DECILES = list(range(10, 101, 10))


def best_mate(rows: DataFrame, site: list[str], name: str, base: str, qual: str, second: str, order: list[str]) -> DataFrame:
    """One read per site and name. Mates that agree keep the first in ``order``; mates that differ
    keep the better base quality, on ties the first end of the pair.

    Two aggregations that combine before they shuffle, so many copies of one read are no burden.
    """
    rest = [c for c in rows.columns if c not in (*site, name, *order)]
    line = F.struct(*order, *rest)
    rank = F.struct((-F.col(qual)).alias("q"), F.col(second).alias("s"), line.alias("line"))
    picked = rows.groupBy(*site, name).agg(
        F.min(F.upper(base)).alias("_b0"), F.max(F.upper(base)).alias("_b1"), F.min(line).alias("_first"), F.min(rank).alias("_best")
    )
    chosen = F.when(F.col("_b0") == F.col("_b1"), F.col("_first")).otherwise(F.col("_best.line"))
    return picked.select(*site, name, chosen.alias("_row")).select(*site, name, "_row.*")


def normalised_coverage(rows: DataFrame, site: list[str], total_reads: int, *, max_coverage: int | None = None,
                        strict: bool = True) -> DataFrame:
    """Reads per site and per million reads. Sites at or above ``max_coverage`` are dropped
    (``strict=False``: only those above it)."""
    t = rows.groupBy(*site).agg(F.count(F.lit(1)).alias("n_reads"))
    if max_coverage is not None:
        t = t.where(F.col("n_reads") < max_coverage if strict else F.col("n_reads") <= max_coverage)
    return t.withColumn("norm_cov", F.col("n_reads") / (total_reads / 1e6))


def total_reads(reads: DataFrame, keep: Column | None = None) -> int:
    """Number of reads (one scalar)."""
    return (reads if keep is None else reads.where(keep)).count()


def reads_at_sites(sites: DataFrame, reads: DataFrame, sspan: Span, rspan: Span, *, bin_size: int = BIN,
                   hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Every read that covers a site. Reads are the big side, so they are the probe that is salted."""
    return overlap_pairs(reads, sites, rspan, sspan, bin_size=bin_size, hot_rows=hot_rows)


def fragment_matrix_from_bed(sites: DataFrame, frags: DataFrame, *, min_mapq: int = 30, max_len: int = 500,
                             max_coverage: int = 250, total_fragments: int | None = None) -> DataFrame:
    """Feature rows from a fragment table instead of alignments.

    ``sites``: chr, start_, end_, strand, prior (distinct). ``frags``: f_chr, f_start, f_end,
    f_name, f_mapq, f_strand. Coverage counts fragments of both strands; only those of the site's
    strand yield rows. Calls are taken as methylated with quality 40.

    Coverage comes from running counts, before any fragment meets a site, so that no pair is made at
    a site that is left out and pairs are at most ``max_coverage`` a site.
    """
    good = frags.where((F.col("f_mapq") >= min_mapq) & (F.col("f_end") - F.col("f_start") <= max_len))
    n = total_reads(good) if total_fragments is None else total_fragments
    closed = good.withColumns({"_flo": F.col("f_start") + 1, "_fhi": F.col("f_end")})
    probe = sites.withColumns({"_slo": F.col("start_") + 1, "_shi": F.col("end_")})
    spots, ends = Span("chr", "_slo", "_shi"), Span("f_chr", "_flo", "_fhi")
    depth = window_record_stats(probe.select(*spots).distinct(), closed.withColumn("_one", F.lit(1)), spots, ends, "_one", 0, copies=False)
    depth = depth.where(F.col("n").between(1, max_coverage)).select(*spots, (F.col("n") / (n / 1e6)).alias("norm_cov"))
    pairs = overlap_pairs(closed, durable(probe.join(depth, list(spots)), "covered-sites"), ends, spots)
    rows = pairs.where(F.col("f_strand") == F.col("strand"))
    left, right = F.col("end_") - F.col("f_start") + 1, F.col("f_end") - F.col("end_") + 1
    return rows.select(
        F.col("f_chr").alias("chr"), "start_", "end_", F.col("f_name").alias("read_name"),
        (F.col("f_end") - F.col("f_start") + 1).cast("int").alias("frag_len"), F.col("f_strand").alias("strand"),
        F.lit("m").alias("methy_stat"), "norm_cov", F.lit(40).alias("base_q"),
        F.when(F.col("f_strand") == "-", right).otherwise(left).cast("int").alias("offset_"),
        F.least(left, right).cast("int").alias("dist_end"), "prior",
    )


def feature_rows(hits: DataFrame, total: int, *, min_base_q: int = 5, max_coverage: int = 250, max_frag_len: int = 1000,
                 max_dist_end: int | None = None) -> DataFrame:
    """Feature matrix from reads at sites.

    ``hits`` holds one row per read and site: chr, start_, end_, ref, read_name, base, qual,
    neg, second, pos, mate_pos, insert_size, read_len, read_offset. Coverage counts reads before
    mates are merged; rows without a call, of low quality or outside the length bounds are dropped.
    """
    site = ["chr", "start_", "end_"]
    depth = normalised_coverage(hits, site, total, max_coverage=max_coverage)
    rows = best_mate(hits, [*site, "ref"], "read_name", "base", "qual", "second",
                     ["pos", "mate_pos", "insert_size", "read_len", "read_offset", "neg"])
    molecule = R.source_negative(F.col("neg"), F.col("second"))
    frag_len = F.abs("insert_size")
    rows = rows.select(
        *site, "read_name", frag_len.cast("int").alias("frag_len"), F.when(molecule, "-").otherwise("+").alias("strand"),
        R.methyl_call(molecule, F.col("ref"), F.col("base")).alias("methy_stat"), F.col("qual").alias("base_q"),
        R.fragment_offset(F.col("pos"), F.col("mate_pos"), F.col("insert_size"), F.col("read_len"), F.col("read_offset"))
        .cast("int").alias("offset_"),
        R.distance_to_end(F.col("pos"), F.col("mate_pos"), F.col("read_len"), F.col("read_offset")).cast("int").alias("dist_end"),
    ).where((F.col("base_q") > min_base_q) & F.col("methy_stat").isNotNull() & (F.col("frag_len") > 0)
            & (F.col("frag_len") <= max_frag_len))
    if max_dist_end is not None:
        rows = rows.where(F.col("dist_end") <= max_dist_end)
    hot = skew.hot_keys(depth, site, weight="n_reads")
    return skew.attach(rows, depth.select(*site, "norm_cov"), site, "inner", hot=hot)


def site_bedgraph(sites: DataFrame, calls: DataFrame, sspan: Span, cspan: Span, state: str) -> DataFrame:
    """Methylated fraction and depth per site from per-read m/u records, by running counts; sites without any are dropped."""
    named = calls.where(F.lower(state).isin("m", "u")).withColumn("_is_m", (F.lower(state) == "m").cast("double"))
    t = window_record_stats(sites.select(*sspan).distinct(), named, sspan, cspan, "_is_m", 0).where(F.col("n") > 0)
    return t.select(F.col(sspan.chrom).alias("chr"), (F.col(sspan.lo) - 1).alias("start_"), F.col(sspan.hi).alias("end_"),
                    (F.col("total") / F.col("n")).alias("fraction"), F.col("n").alias("depth"))


def site_distribution(reads: DataFrame, site: list[str], metrics: dict[str, Column], *, percentiles: list[int] | None = None) -> DataFrame:
    """Mean, deviation and percentiles of several per-read metrics per site.

    Percentiles are exact at position p (n + 1). Equal values are counted before the shuffle and
    only (value, count) pairs reach a site's group, so the group is as large as the value domain.
    """
    ps = percentiles or DECILES
    long = reads.select(*site, F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"), col.cast("double").alias("v")) for name, col in metrics.items()])))
    group = [*site, "metric"]
    counts = long.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("c"))
    # Ranks covered by each value are (upto - c, upto]; a percentile picks the values at two ranks.
    upto = Window.partitionBy(*group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(Window.partitionBy(*group))})
    return ranked.groupBy(*group).agg(
        F.first("n").alias("n"), F.sum(F.col("v") * F.col("c")).alias("s1"), F.sum(F.col("v") * F.col("v") * F.col("c")).alias("s2"),
        F.min("v").alias("lo"), F.max("v").alias("hi"), *_rank_values(ps),
    ).select(*group, "n", (F.col("s1") / F.col("n")).alias("mean"), _deviation().alias("sd"), *_percentiles(ps))


def _deviation() -> Column:
    n, s1, s2 = F.col("n"), F.col("s1"), F.col("s2")
    return F.when(n > 1, F.sqrt(F.greatest(F.try_divide(s2 - s1 * s1 / n, n - 1), F.lit(0.0))))


def _position(p: int) -> Column:
    return F.lit(p / 100.0) * (F.col("n") + 1)


def _rank_values(ps: list[int]) -> list[Column]:
    out = []
    for p in ps:
        for side, k in (("a", F.floor(_position(p))), ("b", F.floor(_position(p)) + 1)):
            out.append(F.max(F.when((F.col("upto") - F.col("c") < k) & (F.col("upto") >= k), F.col("v"))).alias(f"{side}{p}"))
    return out


def _percentiles(ps: list[int]) -> list[Column]:
    out = []
    for p in ps:
        pos = _position(p)
        mid = F.col(f"a{p}") + (pos - F.floor(pos)) * (F.col(f"b{p}") - F.col(f"a{p}"))
        out.append(F.when(pos < 1, F.col("lo")).when(pos >= F.col("n"), F.col("hi")).otherwise(mid).alias(f"p{p}"))
    return out


def site_methylation(reads: DataFrame, site: list[str], call: Column, negative: Column) -> DataFrame:
    """Methylation percentage, reads used and share of minus-strand reads; sites without calls are dropped."""
    m, u = F.count_if(call == "m"), F.count_if(call == "u")
    t = reads.groupBy(*site).agg(m.alias("n_m"), u.alias("n_u"), F.count_if(negative).alias("_neg"), F.count(F.lit(1)).alias("n_reads"))
    used = F.col("n_m") + F.col("n_u")
    return t.where(used > 0).select(
        *site, "n_m", "n_u", used.alias("n_used"), (100.0 * F.col("n_m") / used).alias("methy_perc"),
        (100.0 * F.col("_neg") / F.col("n_reads")).alias("minus_perc"),
    )


def pair_concordance(reads: DataFrame, site: list[str], *, strand: str, offset: str, dist: str, state: str, name: str,
                     min_dist: int, min_reads: int = 3) -> DataFrame:
    """How often two fragments of one site and strand agree when shifted by ``min_dist`` at both ends.

    The pairs are never formed. Reads are counted per (site, strand, offset, dist, state); a pair
    differs by exactly ``min_dist`` in both numbers, so the counts meet through an equi-join on
    shifted keys and pair counts are products. Pairs of equal name are counted the same way, with
    the name in the key, and taken off.
    """
    if min_dist <= 0:
        raise ValueError("min_dist must be positive: equal fragments are not compared")
    deep = reads.groupBy(*site).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_reads)
    hot = skew.hot_keys(deep, site, weight="_n")
    kept = skew.attach(reads, deep.select(*site), site, "left_semi", hot=hot)

    def pairs(extra: list[str]) -> DataFrame:
        key = [*site, strand, *extra]
        t = kept.groupBy(*key, offset, dist).agg(
            F.count_if(F.col(state) == "m").alias("m"), F.count_if(F.col(state) == "u").alias("u"), F.count(F.lit(1)).alias("k"))
        # The partner with the larger offset; its dist is larger or smaller by the same amount.
        up = t.select(*key, (F.col(offset) - min_dist).alias(offset),
                      F.explode(F.array(F.col(dist) - min_dist, F.col(dist) + min_dist)).alias(dist),
                      F.col("m").alias("m2"), F.col("u").alias("u2"), F.col("k").alias("k2"))
        return t.join(up, [*key, offset, dist]).agg(
            F.coalesce(F.sum(F.col("k") * F.col("k2")), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.col("m") * F.col("m2")), F.lit(0)).alias("mm"),
            F.coalesce(F.sum(F.col("u") * F.col("u2")), F.lit(0)).alias("uu"))

    sums = pairs([]).unionByName(pairs([name]).select(*[(-F.col(c)).alias(c) for c in ("total", "mm", "uu")]))
    t = sums.agg(*[F.sum(c).alias(c) for c in ("total", "mm", "uu")])
    concord = F.col("mm") + F.col("uu")
    return t.select(F.col("total").alias("n_pairs"), concord.alias("n_concordant"), F.col("mm").alias("n_methylated"),
                    F.col("uu").alias("n_unmethylated"), F.try_divide(100.0 * concord, F.col("total")).alias("concordance_perc"))
