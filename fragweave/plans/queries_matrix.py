"""Queries over the feature matrix, intervals, tracks, windows and sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragweave.operators import fragments as FR
from fragweave.operators import intervals as I
from fragweave.operators import matrix as M
from fragweave.operators import nearest as N
from fragweave.operators import sites as SI
from fragweave.operators import tracks as T
from fragweave.operators import windows as W
from fragweave.operators.intervals import Span
from fragweave.plans import bindings as B

SITE = Span("chr", "start_", "end_")
REGION = Span("r_chr", "r_lo", "r_hi")
POINT = Span("s_chr", "s_pos", "s_pos")
ROW = ["chr", "start_", "end_", "read_name", "offset_", "frag_len"]


def valid(spark: SparkSession, sf: str) -> DataFrame:
    return M.valid_rows(B.matrix(spark, sf))


def scored(spark: SparkSession, sf: str, outlier: float = -1.0) -> DataFrame:
    rows = valid(spark, sf)
    return M.standardise(rows, M.moments(rows), outlier=outlier)


def sequences_of(spark: SparkSession, sf: str, min_points: int = 1) -> DataFrame:
    return M.fragments(M.first_per_offset(scored(spark, sf)), ["z_len", "z_cov", "z_dist"], min_points=min_points)


def locus_methylation(spark, sf):
    return M.locus_methylation(valid(spark, sf))


def matrix_moments(spark, sf):
    t = valid(spark, sf).agg(F.count(F.lit(1)).alias("n"), *M.moment_columns())
    return t.select("n", *[F.round(c, 6).alias(c) for c in t.columns[1:]])


def zscore_outlier_filter(spark, sf):
    t = scored(spark, sf, outlier=1.5)
    return t.select(*ROW, *[F.round(c, 6).alias(c) for c in ("z_len", "z_cov", "z_dist")])


def prior_clip(spark, sf):
    return scored(spark, sf).select("read_name", "offset_", "prior", F.round("p", 8).alias("p"))


def first_per_offset(spark, sf):
    return M.first_per_offset(valid(spark, sf)).select(*ROW, "strand", "methy_stat", "norm_cov", "base_q", "dist_end", "prior")


def fragment_gaps(spark, sf):
    t = M.fragments(M.first_per_offset(scored(spark, sf)), ["z_len"], keep_rejected=True)
    return t.select("read_name", F.inline(F.arrays_zip("offset", F.col("dist").alias("gap"))))


def fragment_reject(spark, sf):
    t = M.fragments(M.first_per_offset(scored(spark, sf)), ["z_len"], min_points=2, max_points=6, keep_rejected=True)
    return t.select("read_name", F.col("n").cast("int").alias("n"), "last_offset", "accepted")


def initial_state_table(spark, sf):
    return M.initial_state_table(sequences_of(spark, sf))


def transition_table(spark, sf):
    return M.transition_table(sequences_of(spark, sf))


def region_semi(spark, sf):
    return I.overlap_semi(B.matrix(spark, sf), B.regions(spark, sf), SITE, REGION, row_length=1).select(*ROW)


def _spots(spark, sf):
    """Short regions, so that some sites stay outside all of them."""
    return B.regions(spark, sf).withColumn("r_hi", F.expr("cast(r_lo + r_size div 10 as int)"))


def region_anti(spark, sf):
    return I.overlap_anti(B.matrix(spark, sf), _spots(spark, sf), SITE, REGION, row_length=1).select(*ROW)


def region_anti_shuffled(spark, sf):
    """The same answer by the plan for region sets too large to broadcast."""
    return I.overlap_anti(B.matrix(spark, sf), _spots(spark, sf), SITE, REGION).select(*ROW)


def interval_inner_join(spark, sf):
    t = I.overlap_pairs(B.matrix(spark, sf), B.regions(spark, sf), SITE, REGION)
    return t.select("chr", "start_", "end_", "read_name", "offset_", "r_id", "r_lo", "r_hi")


def overlap_flag(spark, sf):
    r = B.regions(spark, sf)
    tracks = {f"in_{n}": r.where(F.col("r_strand") == s) for n, s in (("plus", "+"), ("minus", "-"), ("none", "."))}
    return I.overlap_flags(B.matrix(spark, sf), tracks, SITE, REGION).select(*ROW, *tracks)


def track_mean(spark, sf):
    sig = B.signal(spark, sf)
    t = T.attach_track_values(B.matrix(spark, sf), {"mean_100": (sig, 100), "mean0_500": (sig, -500)}, SITE, POINT, "s_value")
    return t.select(*ROW, F.round("mean_100", 5).alias("mean_100"), F.round("mean0_500", 5).alias("mean0_500"))


def track_record_mean(spark, sf):
    t = T.attach_track_values(B.matrix(spark, sf), {"v": (B.regions(spark, sf), 50)}, SITE, REGION, "r_value")
    return t.select(*ROW, F.round(F.col("v") + 1e-8, 5).alias("v"))


def track_base_mean(spark, sf):
    t = T.attach_track_values(B.matrix(spark, sf), {"v": (B.regions(spark, sf), 50), "v0": (B.regions(spark, sf), -50)},
                              SITE, REGION, "r_value", per_base=True)
    # Prices are whole cents, so means often end in an exact 5; the small term settles those ties.
    return t.select(*ROW, *[F.round(F.col(c) + 1e-8, 5).alias(c) for c in ("v", "v0")])


def nearest_feature(spark, sf):
    return N.nearest_feature(B.matrix(spark, sf), _spots(spark, sf), SITE, REGION, "r_strand", "distance").select(*ROW, "distance")


def _sites(spark, sf):
    """Distinct part positions with a reference base and a strand."""
    t = B.table(spark, sf, "part").selectExpr(
        "concat('chr', cast(p_partkey % 22 + 1 as string)) as chr", "cast((p_partkey * 37) % 20000 as int) as start_",
        "cast((p_partkey * 37) % 20000 + 1 as int) as end_")
    return t.distinct().selectExpr("*", "substring('CGA', start_ % 3 + 1, 1) as base", "case start_ % 2 when 0 then '+' else '.' end as strand")


def nearest_other_site(spark, sf):
    s = _sites(spark, sf)
    return N.nearest_other_site(s, s, SITE, "base", "strand", "nearest").select("chr", "start_", "base", "nearest")


def annotated_sites(spark, sf):
    """Every annotation of the feature matrix for every site: neighbours, flags, distances, record and base means."""
    from fragweave.plans.workflows import annotate_sites

    s = _sites(spark, sf)
    rename = {"r_chr": "chr", "r_lo": "lo", "r_hi": "hi", "r_strand": "strand", "r_value": "value"}
    r = B.regions(spark, sf).withColumnsRenamed(rename)
    spots = _spots(spark, sf).withColumnsRenamed(rename)
    sig = B.signal(spark, sf).selectExpr("s_chr as chr", "s_pos as lo", "s_pos as hi", "s_value as value")
    t = annotate_sites(s, all_sites=s, overlap_tracks={"in_plus": r.where("strand = '+'"), "in_minus": r.where("strand = '-'")}, distance_tracks={"distance": spots},
                       value_tracks={"mean_100": (sig, 100), "mean0_500": (sig, -500)}, base_tracks={"v": (r, 50)}, prior=(sig, POINT._replace(chrom="chr", lo="lo", hi="hi"), "value", 20))
    return t.select(*SITE, "nearest_cpg", "in_plus", "in_minus", "distance", *[F.round(c, 4).alias(c) for c in ("prior", "mean_100", "mean0_500", "v")])


def nearest_by_rank(spark, sf):
    return N.nearest_by_rank(_sites(spark, sf), SITE, "base", "nearest").select("chr", "start_", "base", "nearest")


def interval_distance(spark, sf):
    m = B.alignments(spark, sf).selectExpr("read_name", "line", "partkey as r_id", "chr", "pos as start_", "pos + read_len as end_")
    t = m.join(B.regions(spark, sf), "r_id")
    plain = N.interval_distance(F.col("r_lo"), F.col("r_hi"), F.col("r_strand"), F.col("start_"), F.col("end_"))
    located = N.stranded_interval_distance(F.col("r_chr"), F.col("r_lo"), F.col("r_hi"), F.col("r_strand"), F.col("chr"), F.col("start_"), F.col("end_"))
    return t.select("read_name", "line", "start_", "r_lo", "r_hi", "r_strand", plain.alias("distance"), located.alias("located_distance"))


def window_corr_dist(spark, sf):
    t = W.correlation_with_distance(B.matrix(spark, sf), B.sizes(spark), SITE, "methy_stat", "dist_end",
                                    ["read_name", "offset_", "dist_end", "frag_len", "methy_stat"], window=1000, step=500)
    return t.select("chr", "w_start", "w_end", "name", "score", F.round("cor", 6).alias("cor"), F.round("pvalue", 6).alias("pvalue"), "n")


def _level_rows(spark, sf):
    return B.matrix(spark, sf).selectExpr("*", "prior / 100 as fraction", "base_q + 1 as n_reads")


def window_corr_cov(spark, sf):
    t = W.correlation_with_coverage(_level_rows(spark, sf), B.sizes(spark), SITE, "fraction", "n_reads", "norm_cov",
                                    ["read_name", "offset_", "dist_end", "frag_len", "n_reads", "fraction", "norm_cov"], window=1000, step=1000)
    return t.select("name", F.round("cor", 6).alias("cor"), F.round("pvalue", 6).alias("pvalue"), "n")


def _region_windows(spark, sf):
    return B.regions(spark, sf).selectExpr("r_chr as chr", "r_lo as w_lo", "r_hi as w_hi").distinct()


def window_fraglen_stats(spark, sf):
    f = B.matrix(spark, sf).withColumnsRenamed({"chr": "f_chr", "start_": "f_lo", "end_": "f_hi"})
    t = W.fragment_length_stats(_region_windows(spark, sf), f, Span("chr", "w_lo", "w_hi"), Span("f_chr", "f_lo", "f_hi"), "read_name", "frag_len")
    return t.select("chr", "w_lo", "w_hi", "num_frag", F.round("len_mean", 5).alias("len_mean"), F.round("len_sd", 5).alias("len_sd"), "len_median")


def window_value_stats(spark, sf):
    t = W.value_stats(_region_windows(spark, sf), B.signal(spark, sf), Span("chr", "w_lo", "w_hi"), POINT, "s_value")
    return t.select("chr", "w_lo", "w_hi", "n", *[F.round(c, 5).alias(c) for c in ("value_mean", "value_sd", "value_median")])


def norm_coverage(spark, sf):
    v = valid(spark, sf)
    return SI.normalised_coverage(v, list(SITE), SI.total_reads(v), max_coverage=8)


def _alignments_at_sites(spark, sf):
    """Alignments that pass the flags, with their site."""
    return B.alignments(spark, sf).selectExpr(
        "*", "cast(partkey % 50 as int) as start_", "cast(partkey % 50 + 1 as int) as end_", "(flag & 16) != 0 as neg", "(flag & 128) != 0 as second")


def mate_dedup(spark, sf):
    t = _alignments_at_sites(spark, sf).select("chr", "start_", "read_name", "base", "qual", "second", "line", "partkey")
    return SI.best_mate(t.withColumn("read_name", F.col("read_name") % 40), ["chr", "start_"], "read_name", "base", "qual", "second", ["line", "partkey"]).select(
        "chr", "start_", "read_name", "base", "qual", "second", "line", "partkey")


def feature_rows(spark, sf):
    t = _alignments_at_sites(spark, sf)
    hits = t.select("chr", "start_", "end_", "ref", "read_name", "base", "qual", "neg", "second", "pos", "mate_pos", "insert_size", "read_len", "read_offset")
    out = SI.feature_rows(hits, SI.total_reads(t), max_coverage=75)
    return out.select(*[F.round(c, 6).alias(c) if c == "norm_cov" else F.col(c) for c in out.columns])


def reads_at_sites(spark, sf):
    reads = B.alignments(spark, sf).selectExpr("read_name", "line", "partkey", "chr as a_chr", "pos", "pos + read_len - 1 as pos_end", "qual")
    s = _sites(spark, sf).selectExpr("chr as c_chr", "start_ + 1 as c_lo", "end_ as c_hi", "base as c_base")
    t = SI.reads_at_sites(s, reads, Span("c_chr", "c_lo", "c_hi"), Span("a_chr", "pos", "pos_end"))
    return t.select("a_chr", "read_name", "line", "partkey", "pos", "c_lo", "c_base")


def bed_fragment_matrix(spark, sf):
    frags = B.matrix(spark, sf).selectExpr("chr as f_chr", "start_ + dist_end as f_start", "start_ + dist_end + frag_len as f_end",
                                           "concat(read_name, '/', offset_) as f_name", "base_q * 10 as f_mapq", "strand as f_strand")
    s = _sites(spark, sf).selectExpr("chr", "start_", "end_", "case when strand = '.' then '-' else strand end as strand", "cast(start_ % 101 as double) as prior")
    t = SI.fragment_matrix_from_bed(s, frags, max_coverage=40)
    return t.select(*[F.round(c, 6).alias(c) if c == "norm_cov" else F.col(c) for c in t.columns])


def site_bedgraph(spark, sf):
    calls = B.matrix(spark, sf).selectExpr("chr as k_chr", "start_ + 1 as k_lo", "end_ + 99 as k_hi", "methy_stat as state")
    s = _sites(spark, sf).selectExpr("chr", "start_ + 1 as c_lo", "end_ as c_hi")
    return SI.site_bedgraph(s, calls, Span("chr", "c_lo", "c_hi"), Span("k_chr", "k_lo", "k_hi"), "state")


def site_distribution(spark, sf):
    v = valid(spark, sf).withColumn("start_", (F.col("start_") / 1000).cast("int"))
    t = SI.site_distribution(v, ["chr", "start_"], {
        "frag_len": F.col("frag_len"), "offset": F.col("offset_"), "offset_ratio": F.col("offset_") / F.col("frag_len"), "base_q": F.col("base_q")})
    return t.select("chr", "start_", "metric", "n", *[F.round(c, 5).alias(c) for c in t.columns[4:]])


def site_methylation(spark, sf):
    v = valid(spark, sf)
    return SI.site_methylation(v, ["chr", "start_", "end_"], F.col("methy_stat"), F.col("strand") == "-")


def pair_concordance(spark, sf):
    v = valid(spark, sf).withColumn("dist_end", (F.col("dist_end") % 3) * 90)
    return SI.pair_concordance(v, ["chr", "start_", "end_"], strand="strand", offset="offset_", dist="dist_end", state="methy_stat",
                               name="read_name", min_dist=90).select(
        *[F.col(c).cast("long").alias(c) for c in ("n_pairs", "n_concordant", "n_methylated", "n_unmethylated")], "concordance_perc")


def fragment_summary(spark, sf):
    return FR.keep_summaries(_summary(spark, sf))


def _summary(spark, sf):
    m = B.matrix(spark, sf)
    state, q = F.col("methy_stat"), F.col("base_q")
    return FR.fragment_summary(m, "read_name", "frag_len", ["offset_", "frag_len"], {
        "m_cg": F.when(state == "m", q).otherwise(0), "u_cg": F.when(state == "u", q).otherwise(0),
        "m_ch": F.when((state == "m") & (q > 7), 1).otherwise(0), "u_ch": F.when((state == "u") | (q < 6), F.col("offset_") / 9).otherwise(0).cast("int")})


def methylation_by_length(spark, sf):
    t = FR.methylation_by_length(fragment_summary(spark, sf))
    return t.select("frag_len", *[F.round(c, 5).alias(c) for c in ("methy_mean", "methy_sd", "methy_median")], "n")


def length_by_methylation(spark, sf):
    t = FR.length_by_methylation(fragment_summary(spark, sf))
    return t.select("methy_tenth", *[F.round(c, 5).alias(c) for c in ("len_mean", "len_sd", "len_median")], "n")


def cpg_density(spark, sf):
    return FR.cpg_density(B.matrix(spark, sf)).select(*ROW, "n_cpg", "cpg_density")


def position_corr(spark, sf):
    one = M.first_per_offset(valid(spark, sf))
    calls = one.selectExpr("read_name", "offset_ div 90 - 1 as pos", "case when methy_stat = 'm' then 1.0D else 0.0D end as value")
    t = FR.positional_correlation(calls, ["read_name"], "pos", "value")
    return t.select(F.col("pos").cast("int").alias("pos"), "n", F.round("r", 6).alias("r"))


def ref_methylation_by_track(spark, sf):
    one = M.first_per_offset(valid(spark, sf))
    calls = one.selectExpr("read_name", "chr", "start_ + offset_ as pos", "case when methy_stat = 'm' then 1 else 0 end as state")
    track = B.signal(spark, sf).selectExpr("s_type as track", "s_chr as chr", "cast(s_pos % 20000 as int) as pos", "s_value").groupBy("track", "chr", "pos").agg(
        F.round(F.avg("s_value") * 2, 3).alias("methylated"), F.round(F.max("s_value") * 3 + 1, 3).alias("coverage"))
    t = FR.reference_methylation(calls, track, min_cpg=2)
    return t.withColumn("methy_obs", F.round("methy_obs", 8))


def fragments_near_sites(spark, sf):
    a = B.alignments(spark, sf).selectExpr("concat(read_name, '/', line, '/', partkey) as id", "chr", "pos", "pos + 3 as pos_end", "mate_pos", "mate_pos + 3 as mate_end")
    s = _sites(spark, sf).selectExpr("chr as c_chr", "start_ + 1 as c_lo", "end_ as c_hi")
    return FR.fragments_near_sites(a, s, "id", [Span("chr", "pos", "pos_end"), Span("chr", "mate_pos", "mate_end")], Span("c_chr", "c_lo", "c_hi"))


def _tensor(spark, sf, make):
    wins = B.regions(spark, sf).selectExpr("r_chr as chr", "r_lo as start_", "r_lo + r_size as end_")
    chunk = wins.selectExpr("chr", "explode(sequence(start_ + 1, end_)) as pos").distinct()
    bases = chunk.selectExpr("chr", "pos", "substring('ACGTN', pos * 7 % 5 + 1, 1) as base")
    frags = B.matrix(spark, sf).selectExpr("chr", "start_ + dist_end as f_start", "start_ + dist_end + frag_len as f_end", "strand as f_strand")
    cpg = B.matrix(spark, sf).groupBy("chr", F.col("end_").alias("pos")).agg(F.max("prior").alias("methy"))
    t = make(wins, bases, frags, cpg)
    return t.withColumn("vectors", F.array_join(F.transform(F.flatten("vectors"), lambda v: F.format_string("%.2f", v)), ","))


def position_tensor(spark, sf):
    t = _tensor(spark, sf, lambda *a: W.position_tensor(*a, max_cov=12, max_frag_len=400))
    return t.select("chr", "pos", "base", "methy", "n_plus", "n_minus", "vectors")


def window_tensor(spark, sf):
    """Positions of all windows, overlapping ones apart, in blocks by row number."""
    return _tensor(spark, sf, lambda wins, *a: W.window_tensor(W.number_windows(wins, stretch=4096), *a, max_cov=12, max_frag_len=400))


def bedgraph_project(spark, sf):
    from fragweave.sources.sinks import bedgraphs

    pred = locus_methylation(spark, sf).selectExpr(
        "case when chr = 'chr22' then 'chrM' else chr end as chr", "start_", "end_", "methy_perc as methy_perc_predict",
        "n_m as methy_count_predict", "n as total_count_predict")
    parts = [t.select(F.lit(k).alias("track"), "chr", "start_", "end_", F.col("value").cast("double").alias("value")) for k, t in bedgraphs(pred).items()]
    from fragweave.operators.merge import union_parts

    return union_parts(parts)
