"""End-to-end jobs: alignments to feature matrix, matrix to model, model to predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragweave.functions import reads as R
from fragweave.operators import fragments as FR
from fragweave.operators import hmm as H
from fragweave.operators import intervals as I
from fragweave.operators import matrix as M
from fragweave.operators import nearest as N
from fragweave.operators import sites as SI
from fragweave.operators import tracks as T
from fragweave.operators.intervals import Span
from fragweave.session import durable
from fragweave.sources.text import genome_lookup

SITE = Span("chr", "start_", "end_")


def read_hits(reads: DataFrame, sites: DataFrame, genome: DataFrame, *, min_mapq: int = 30, skip_second: bool = False,
              max_ch_rate: float | None = None, chunk: int = 1 << 16) -> DataFrame:
    """One row per site and read over it, with the read's base there and the reference base.

    ``reads`` as from ``read_sam`` or ``read_bam``; ``sites``: chr, start_, end_ (half open, one base).
    ``max_ch_rate`` drops reads of incomplete conversion, judged against the MD tag's reference.
    """
    f = F.col("flag")
    good = reads.where(R.passes_flags(f, F.col("mapq"), min_mapq, skip_second=skip_second) & (F.lower("chr") != "chrm"))
    if max_ch_rate is not None:
        molecule = R.source_negative(R.has(f, R.REVERSE), R.has(f, R.SECOND))
        clipped = R.clip(F.col("bases"), *(F.coalesce(F.regexp_extract("cigar", p, 1).try_cast("int"), F.lit(0)) for p in ("^([0-9]+)S", "([0-9]+)S$")))
        ref = R.reference_from_md(F.col("bases"), F.col("cigar"), F.col("md"))
        ok = R.conversion_filter(F.substring(ref, F.lit(1), F.length(clipped)), clipped, molecule, max_ch_rate=max_ch_rate) == 0
        good = good.where(F.col("md").isNotNull() & ok)
    spot = sites.select(F.col("chr").alias("s_chr"), "start_", "end_", (F.col("start_") + 1).alias("_slo"), F.col("end_").alias("_shi"))
    hits = I.overlap_pairs(good, spot, Span("chr", "pos", "end_pos"), Span("s_chr", "_slo", "_shi"))
    hits = hits.withColumn("read_offset", R.read_position(F.col("cigar"), F.col("pos"), F.col("end_"))).where(F.col("read_offset").isNotNull())
    hits = hits.select(
        "chr", "start_", "end_", "read_name", F.substring("bases", F.col("read_offset") + 1, F.lit(1)).alias("base"),
        F.get("quals", F.col("read_offset")).alias("qual"), R.has(f, R.REVERSE).alias("neg"), R.has(f, R.SECOND).alias("second"), "pos", "mate_pos",
        "insert_size", F.length("bases").alias("read_len"), "read_offset")
    letters = genome_lookup(sites.select("chr", "start_", "end_").distinct(), genome, "chr", F.col("start_"), 1, "ref", chunk=chunk)
    from fragweave.operators import skew

    return skew.attach(hits, letters, list(SITE), "inner")


Track = tuple[DataFrame, int]


def annotate_sites(sites: DataFrame, *, genome: DataFrame | None = None, prior: tuple[DataFrame, Span, str, int] | None = None,
                   all_sites: DataFrame | None = None, overlap_tracks: dict[str, DataFrame] | None = None,
                   distance_tracks: dict[str, DataFrame] | None = None, value_tracks: dict[str, Track] | None = None,
                   base_tracks: dict[str, Track] | None = None, track_span: Span = Span("chr", "lo", "hi"), value: str = "value", strand: str = "strand",
                   ref_kmers: int = 0, kmer_ext: int = 100, selected: list[str] | None = None, context: int = 0, chunk: int = 1 << 16) -> DataFrame:
    """All annotations of every distinct site, one row a site; sites are few, so this is done before any read is met.

    * ``prior``: value track (table, span, value column, extension) for the prior column.
    * ``all_sites`` (chr, start_, end_, strand): distance to the nearest other CpG as ``nearest_cpg``. It needs the
      sites' column ``base``, and leaves out sites whose base is neither C nor G.
    * tracks by name: 0/1 overlap, signed distance, mean of the records (``value_tracks``, as in tabix tables) or
      of the covered bases (``base_tracks``, as in bigWig) in a window around the site.
    * ``ref_kmers``: percentages of the k-mers of 2 up to so many bases in the reference around the site, or of the
      ``selected`` ones only.
    * ``context``: so many reference bases on both sides of the CpG, for either strand (context_plus, context_minus).

    Columns of ``sites`` beyond chr, start_, end_ and base are left behind.
    """
    rows = durable(sites.select(*SITE, *(["base"] if all_sites is not None else [])).distinct(), "sites")
    out = spots = rows.select(*SITE)

    def add(found: DataFrame, how: str = "left") -> None:
        nonlocal out
        out = out.join(found, list(SITE), how)

    # every annotation starts from the written sites, so that plans do not nest
    if all_sites is not None:
        near = N.nearest_other_site(rows.withColumn("_strand", F.lit(".")), all_sites.select(*SITE, F.col(strand).alias("_strand")).distinct(), SITE, "base", "_strand", "nearest_cpg")
        add(near.drop("_strand", "base"), "inner")
    if prior is not None:
        table, span, column, ext = prior
        add(T.attach_track_values(spots, {"prior": (table, ext)}, SITE, span, column, unique=True))
    if overlap_tracks:
        add(I.overlap_flags(spots, overlap_tracks, SITE, track_span, unique=True))
    for name, features in (distance_tracks or {}).items():
        add(N.nearest_feature(spots, features, SITE, track_span, strand, name, unique=True))
    for tracks, per_base in ((value_tracks, False), (base_tracks, True)):
        if tracks:
            add(T.attach_track_values(spots, tracks, SITE, track_span, value, per_base=per_base, unique=True))
    if ref_kmers:
        flanks = genome_lookup(spots, genome, "chr", F.col("end_") - 1 - kmer_ext, 2 * kmer_ext + 1, "_flank", chunk=chunk)
        for k in range(2, ref_kmers + 1):
            found = FR.kmer_frequencies(flanks, list(SITE), "_flank", k)
            add(found if selected is None else found.select(*SITE, *[c for c in found.columns if c in selected]))
    if context:
        for name, sign in (("context_plus", "+"), ("context_minus", "-")):
            add(FR.strand_context(spots.withColumn("_sign", F.lit(sign)), genome, context, name, strand="_sign", chunk=chunk).drop("_sign"))
    return out


def fragment_sequences(reads: DataFrame, genome: DataFrame, *, max_len: int = 1000, chunk: int = 1 << 16) -> DataFrame:
    """Reference bases under every fragment (chr, read_name, minus, seq), from the first to the last position of its mates.

    Fragments longer than ``max_len`` get no sequence.
    """
    f = F.col("flag")
    sides = reads.groupBy("chr", "read_name").agg(F.bool_or(R.source_negative(R.has(f, R.REVERSE), R.has(f, R.SECOND))).alias("minus"))
    size = F.col("hi") - F.col("lo") + 1
    extent = FR.fragment_extents(reads, ["chr", "read_name"]).where(size <= max_len).join(sides, ["chr", "read_name"])
    return genome_lookup(extent, genome, "chr", F.col("lo") - 1, size, "seq", chunk=chunk, longest=max_len).select("chr", "read_name", "minus", "seq")


def extract_matrix(reads: DataFrame, sites: DataFrame, genome: DataFrame, *, min_mapq: int = 30, min_base_q: int = 5, max_coverage: int = 250,
                   max_ch_rate: float | None = None, total: int | None = None, chunk: int = 1 << 16, frag_kmers: int = 0, strand_specific: bool = True,
                   selected: list[str] | None = None, max_frag_len: int = 1000, all_sites: DataFrame | None = None, context: int = 0, **annotations) -> DataFrame:
    """Feature matrix with optional annotations: those of ``annotate_sites`` (worked out once a site, joined
    once), the site's ``context`` on the row's strand, and with ``frag_kmers`` the k-mers of each row's fragment
    (a map ``frag_kmers``, or a column for each of the ``selected`` ones), read on its own strand if ``strand_specific``.

    With ``all_sites``, sites whose reference base is neither C nor G have no rows.
    """
    from fragweave.operators import skew

    passes = R.passes_flags(F.col("flag"), F.col("mapq"), min_mapq)
    n = SI.total_reads(reads, passes) if total is None else total
    hits = read_hits(reads, sites, genome, min_mapq=min_mapq, max_ch_rate=max_ch_rate, chunk=chunk)
    rows = SI.feature_rows(hits, n, min_base_q=min_base_q, max_coverage=max_coverage, max_frag_len=max_frag_len)
    if annotations or all_sites is not None or context:
        spots = sites.select(*SITE).distinct()
        if all_sites is not None:
            spots = genome_lookup(spots, genome, "chr", F.col("start_"), 1, "base", chunk=chunk)
        notes = annotate_sites(spots, genome=genome, all_sites=all_sites, selected=selected, context=context, chunk=chunk, **annotations)
        rows = skew.attach(rows, notes, list(SITE), "inner" if all_sites is not None else "left")
    if context:
        rows = rows.withColumn("context", F.when(F.col("strand") == "-", F.col("context_minus")).otherwise(F.col("context_plus"))).drop("context_plus", "context_minus")
    if frag_kmers:
        seqs = fragment_sequences(reads.where(passes), genome, max_len=max_frag_len, chunk=chunk)
        maps = FR.fragment_kmer_maps(seqs, ["chr", "read_name"], "seq", 2, frag_kmers, reverse="minus" if strand_specific else None, selected=selected)
        rows = skew.attach(rows, maps, ["chr", "read_name"], "left")
    return rows


def training_fragments(matrix: DataFrame, *, regions: DataFrame | None = None, exclude: DataFrame | None = None, region_span: Span = SITE,
                       outlier: float = -1.0, low_coverage: bool = False, min_len: int = 30, max_len: int = 500, max_cpg_dist: int = 500,
                       bin_bp: int = 1, min_points: int = 1, max_points: int = 1000) -> DataFrame:
    """Observation sequences from a feature matrix."""
    rows = M.valid_rows(matrix, min_len=min_len, max_len=max_len)
    if regions is not None:
        rows = I.overlap_semi(rows, regions, SITE, region_span, row_length=1)
    if exclude is not None:
        rows = I.overlap_anti(rows, exclude, SITE, region_span, row_length=1)
    rows = M.standardise(rows, M.moments(rows), outlier=outlier, low_coverage=low_coverage)
    features = H.FEATURES_LOW_COVERAGE if low_coverage else H.FEATURES
    return M.fragments(M.first_per_offset(rows), features, max_cpg_dist=max_cpg_dist, bin_bp=bin_bp, min_points=min_points, max_points=max_points)


def train_model(fragments: DataFrame, *, init: str = "random", low_coverage: bool = False, max_cpg_dist: int = 500, bin_bp: int = 1,
                comps: list[int] | None = None, bayes_factor: float = 0.9, seed: int = 2017, **kw) -> H.Training:
    """Train from fragments of two or more points; ``init``: random, observed or gmm."""
    from dataclasses import replace

    features = H.FEATURES_LOW_COVERAGE if low_coverage else H.FEATURES
    data = durable(fragments.where(F.col("n") >= 2), "train")
    args = dict(bins=max_cpg_dist // bin_bp + 1, comps=comps)
    start = H.init_gmm(data, features, **args) if init == "gmm" else (
        H.init_observed if init == "observed" else H.init_random)(data, features, seed=seed, **args)
    return H.train(data, replace(start, bayes_factor=bayes_factor), features, keep=False, **kw)


def predict(fragments: DataFrame, model: H.Model, *, low_coverage: bool = False, threshold: float = 0.0) -> DataFrame:
    """Predicted and observed methylation per locus."""
    features = H.FEATURES_LOW_COVERAGE if low_coverage else H.FEATURES
    return H.predictions(H.decoded_points(H.decode(fragments, model, features, threshold)), model)
