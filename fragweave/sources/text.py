"""Readers of the text formats, as plain Spark scans.

Every reader returns a lazily scanned DataFrame with an explicit schema. Lines starting with ``#``
are comments; gzip is recognised by suffix. Rows that are too short are skipped, not repaired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str, at_least: int, *, skip_prefixes: tuple[str, ...] = ("#",)) -> DataFrame:
    """Tab-separated lines as an array column ``f``; trailing empty fields do not count."""
    lines = spark.read.text(path)
    for prefix in skip_prefixes:
        lines = lines.where(~F.col("value").startswith(prefix))
    f = F.split(F.regexp_replace("value", "\t+$", ""), "\t")
    return lines.select(f.alias("f")).where(F.size("f") >= at_least)


def _at(i: int) -> Column:
    return F.get("f", F.lit(i))


def _strand(c: Column) -> Column:
    return F.when(c.isin("+", "-"), c).otherwise(F.lit("."))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED intervals: chr, start_, end_, name, score, strand (``.`` where missing)."""
    return _fields(spark, path, 3, skip_prefixes=("#", "track", "browser")).select(
        _at(0).alias("chr"), _at(1).cast("int").alias("start_"), _at(2).cast("int").alias("end_"), _at(3).alias("name"),
        _at(4).try_cast("double").alias("score"), _strand(_at(5)).alias("strand"))


def read_bed_methyl(spark: SparkSession, path: str) -> DataFrame:
    """BED6+2 methylation table: BED6 plus methy and depth; rows with fewer than 8 fields are skipped."""
    return _fields(spark, path, 8, skip_prefixes=("#", "track")).select(
        _at(0).alias("chr"), _at(1).cast("int").alias("start_"), _at(2).cast("int").alias("end_"), _at(3).alias("name"),
        _at(4).try_cast("double").alias("score"), _strand(_at(5)).alias("strand"), _at(6).cast("double").alias("methy"),
        _at(7).try_cast("double").alias("depth"))


def read_bed_coverage(spark: SparkSession, path: str) -> DataFrame:
    """Methylation and coverage per interval: fraction in field 5, reads in field 6, coverage in field 7."""
    return _fields(spark, path, 7).select(
        _at(0).alias("chr"), _at(1).cast("int").alias("start_"), _at(2).cast("int").alias("end_"), _at(3).alias("name"),
        _at(4).cast("double").alias("fraction"), _at(5).cast("int").alias("n_reads"), _at(6).cast("double").alias("coverage"))


def read_feature_matrix(spark: SparkSession, path: str, *, tracks: list[str] | None = None, prior: str | None = None) -> DataFrame:
    """Feature matrix; the header row is known by ``start`` in its second field.

    Column 11 is the prior unless ``prior`` names one of the further ``tracks`` columns (in file
    order from column 11 on). NaN becomes null.
    """
    number = lambda i: F.when(~F.isnan(_at(i).try_cast("double")), _at(i).try_cast("double"))
    rows = _fields(spark, path, 11).where(F.lower(_at(1)) != "start")
    tracks = tracks or ["prior"]
    cols = [number(11 + k).alias(t) for k, t in enumerate(tracks)]
    out = rows.select(
        _at(0).alias("chr"), _at(1).cast("int").alias("start_"), _at(2).cast("int").alias("end_"), _at(3).alias("read_name"),
        _at(4).cast("int").alias("frag_len"), _at(5).alias("strand"), _at(6).alias("methy_stat"), _at(7).cast("double").alias("norm_cov"),
        _at(8).cast("double").cast("int").alias("base_q"), _at(9).cast("int").alias("offset_"), _at(10).cast("int").alias("dist_end"), *cols)
    return out.withColumnRenamed(prior, "prior") if prior else out


def read_bedgraph(spark: SparkSession, path: str, track: str) -> DataFrame:
    """bedGraph intervals as closed 1-based spans: track, chr, lo, hi, value."""
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)"))
    f = rows.select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= 4)
    return f.select(F.lit(track).alias("track"), _at(0).alias("chr"), (_at(1).cast("long") + 1).alias("lo"), _at(2).cast("long").alias("hi"),
                    _at(3).cast("double").alias("value"))


def read_scored_bed(spark: SparkSession, path: str, track: str) -> DataFrame:
    """BED records with a number in the 5th field as closed 1-based spans; records without one are left out."""
    rows = _fields(spark, path, 5).select(F.lit(track).alias("track"), _at(0).alias("chr"), (_at(1).cast("long") + 1).alias("lo"), _at(2).cast("long").alias("hi"),
                                          _at(4).try_cast("double").alias("value"))
    return rows.where(F.col("value").isNotNull())


def read_track(spark: SparkSession, path: str, track: str) -> DataFrame:
    """A value track (track, chr, lo, hi, value) by its suffix: bigWig, scored BED, else bedGraph."""
    suffix = path.lower().removesuffix(".gz").rsplit(".", 1)[-1]
    if suffix in ("bw", "bigwig"):
        from fragweave.sources.bigwig import BigWigSource

        spark.dataSource.register(BigWigSource)
        return spark.read.format("bigwig").load(path).select(F.lit(track).alias("track"), "chr", "lo", "hi", "value")
    return read_scored_bed(spark, path, track) if suffix == "bed" else read_bedgraph(spark, path, track)


def read_tracks(spark: SparkSession, specs: list[str]) -> dict[str, tuple[DataFrame, int]]:
    """Named value tracks from ``name:extension:path`` strings; a negative extension asks for the sum
    over the window width."""
    out = {}
    for spec in specs:
        name, ext, path = spec.split(":", 2)
        out[name] = (read_track(spark, path, name), int(ext))
    return out


def tracks_by_kind(spark: SparkSession, specs: list[str]) -> dict[str, dict[str, tuple[DataFrame, int]]]:
    """The same as ``value_tracks`` (means of records) and ``base_tracks`` (bigWig: means of covered bases) for the feature matrix."""
    is_base = lambda s: s.lower().endswith((".bw", ".bigwig"))
    return {"value_tracks": read_tracks(spark, [s for s in specs if not is_base(s)]), "base_tracks": read_tracks(spark, [s for s in specs if is_base(s)])}


def read_region_tracks(spark: SparkSession, specs: list[str]) -> dict[str, DataFrame]:
    """Named interval sets from ``name:path`` strings."""
    return {name: read_bed(spark, path) for name, path in (s.split(":", 1) for s in specs)}


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, 2).select(_at(0).alias("chr"), _at(1).cast("long").alias("length"))


def read_kmer_list(spark: SparkSession, path: str) -> DataFrame:
    """One k-mer per line, upper-cased."""
    t = spark.read.text(path).where(~F.col("value").startswith("#"))
    return t.select(F.upper(F.trim("value")).alias("kmer")).where(F.col("kmer") != "").distinct()


def read_sample_sheet(spark: SparkSession, path: str, patient: int = 0, library: int = 1) -> DataFrame:
    t = _fields(spark, path, max(patient, library) + 1).select(_at(patient).alias("patient"), _at(library).alias("library"))
    return t.where((F.col("patient") != "NA") & (F.col("library") != "NA"))


def read_fasta(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    """FASTA as fixed chunks: chr, chunk_start (0-based), bases. Lines before the first header are left out.

    A line belongs to the last header before it: inside an input split a running value finds it, and a
    small table with one row a split carries the last header of earlier splits over. Lines are placed by
    the running length of the lines before them, likewise first inside a split and then over splits. So
    neither a contig nor the list of contigs is gathered anywhere.
    """
    is_head = F.col("value").startswith(">")
    head = F.when(is_head, F.struct(F.col("_id").alias("at"), F.regexp_extract("value", r"^>(\S+)", 1).alias("chr")))
    raw = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id())
    raw = raw.select("_id", F.shiftright("_id", 33).alias("_split"), head.alias("_head"), F.when(~is_head, F.upper(F.trim("value"))).alias("b"))
    ends = raw.groupBy("_split").agg(F.max("_head").alias("_head"))
    earlier = Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)  # one small row a split
    carried = ends.select("_split", F.last("_head", ignorenulls=True).over(earlier).alias("_carried"))
    so_far = Window.partitionBy("_split").orderBy("_id")
    lines = raw.withColumn("_head", F.last("_head", ignorenulls=True).over(so_far)).join(carried, "_split")
    lines = lines.withColumn("_head", F.coalesce("_head", "_carried")).where(F.col("b").isNotNull() & F.col("_head").isNotNull())
    inside = Window.partitionBy("_split", "_head").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.select("_split", "_head", "b", F.coalesce(F.sum(F.length("b")).over(inside), F.lit(0)).alias("_in"))
    totals = lines.groupBy("_split", "_head").agg(F.sum(F.length("b")).alias("_t"))
    before = Window.partitionBy("_head").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_split", "_head", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    placed = lines.join(totals, ["_split", "_head"])
    at = F.col("_base") + F.col("_in")
    pieces = F.transform(
        F.sequence(F.floor(at / chunk), F.floor((at + F.length("b") - 1) / chunk)),
        lambda k: F.struct(
            (k * chunk).alias("chunk_start"), F.greatest(at, k * chunk).alias("p"),
            F.substring("b", (F.greatest(at, k * chunk) - at + 1).cast("int"),
                        (F.least(at + F.length("b"), (k + 1) * chunk) - F.greatest(at, k * chunk)).cast("int")).alias("s")))
    cut = placed.where(F.length("b") > 0).select("_head", F.inline(pieces))
    joined = cut.groupBy("_head", "chunk_start").agg(F.array_sort(F.collect_list(F.struct("p", "s"))).alias("_l"))
    return joined.select("_head.chr", "chunk_start", F.array_join(F.transform("_l", lambda x: x["s"]), "").alias("bases"))


def genome_lookup(rows: DataFrame, genome: DataFrame, chrom: str, start0, length: int | Column, name: str, *, chunk: int = 1 << 16,
                  longest: int | None = None, overlap: int = 0, distinct: bool = False) -> DataFrame:
    """Add ``length`` bases from 0-based ``start0`` on; bases outside the contig are missing from the string.

    Where ``length`` is a column, ``longest`` bounds it, and a longer row is an error.

    Every chunk is first lengthened by the head of the next one (a join of two unique keys), so that
    each row meets exactly one chunk; chunks stored with an ``overlap`` of all but one of the bases to
    look up (``fragments.cut_sequences``) have it already. ``distinct`` says that no two rows begin at one
    place, but for those moved to a contig's start: then a chunk cannot be hot, and rows are not counted first.
    """
    from fragweave.operators import skew

    most = length if isinstance(length, int) else longest
    if most is None or most > chunk:
        raise ValueError(f"look-ups of {most} bases need chunks at least as long, not {chunk}")
    if not isinstance(length, int):
        message = F.concat(F.lit(f"a look-up of more than {most} bases: "), length.cast("string"))
        length = F.when(length <= most, length).otherwise(F.raise_error(message).cast("bigint"))
    if overlap >= most - 1:
        long = genome.select(F.col("chr").alias(chrom), F.col("chunk_start").alias("_c0"), F.col("bases").alias("_b"))
    else:
        own = F.substring("bases", 1, chunk)
        heads = genome.select("chr", (F.col("chunk_start") - chunk).alias("chunk_start"), F.substring("bases", 1, most - 1).alias("_head"))
        long = genome.join(heads, ["chr", "chunk_start"], "left")
        long = long.select(F.col("chr").alias(chrom), F.col("chunk_start").alias("_c0"), F.concat(own, F.coalesce("_head", F.lit(""))).alias("_b"))
    s = start0.cast("long")
    inside = F.greatest(s, F.lit(0).cast("long"))
    keyed = rows.withColumns({"_s": inside, "_n": ((F.lit(length) if isinstance(length, int) else length) - (inside - s)).cast("int"), "_c0": F.floor(inside / chunk) * chunk})
    out = skew.attach(keyed, long, [chrom, "_c0"], "left", **({"hot": None} if distinct else {}))
    piece = F.substring("_b", (F.col("_s") - F.col("_c0") + 1).cast("int"), F.greatest(F.col("_n"), F.lit(0)))
    return out.withColumn(name, F.coalesce(piece, F.lit(""))).drop("_s", "_n", "_c0", "_b")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text as aligned reads; optional MD and MC tags become columns."""
    f = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 11)
    tag = lambda t: F.regexp_extract(F.array_join(F.slice("f", 12, F.greatest(F.size("f") - 11, F.lit(0))), "\t"), f"(?:^|\t){t}:Z:([^\t]*)", 1)
    quals = F.transform(F.split(_at(10), ""), lambda q: F.ascii(q) - 33)
    t = f.select(
        _at(0).alias("read_name"), _at(1).cast("int").alias("flag"), _at(2).alias("chr"), _at(3).cast("int").alias("pos"),
        _at(4).cast("int").alias("mapq"), _at(5).alias("cigar"), _at(7).cast("int").alias("mate_pos"), _at(8).cast("int").alias("insert_size"),
        F.upper(_at(9)).alias("bases"), quals.alias("quals"), F.nullif(tag("MD"), F.lit("")).alias("md"), F.nullif(tag("MC"), F.lit("")).alias("mc"))
    from fragweave.functions import reads as R

    return t.withColumn("end_pos", R.aligned_end(F.col("cigar"), F.col("pos")))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variants that passed their filters, one row per sample: chr, pos, ref, alt, library, gt, ad, pl, dp, gq, called."""
    header = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    if header is None:
        raise ValueError(f"no VCF header line in {path}")
    samples = header[0].split("\t")[9:]
    rows = _fields(spark, path, 10).where(_at(6).isin("PASS", "."))
    each = F.transform(F.array(*[F.lit(s) for s in samples]), lambda s, i: F.struct(s.alias("library"), F.get("f", i + 9).alias("v")))
    long = rows.select(_at(0).alias("chr"), _at(1).cast("int").alias("pos"), _at(3).alias("ref"), _at(4).alias("alt"),
                       F.split(_at(8), ":").alias("_keys"), F.inline(each))
    m = F.map_from_arrays("_keys", F.slice(F.concat(F.split("v", ":"), F.array_repeat(F.lit("."), F.size("_keys"))), F.lit(1), F.size("_keys")))
    long = long.withColumn("_m", m)
    get = lambda k: F.try_element_at("_m", F.lit(k))
    ints = lambda k: F.transform(F.split(F.coalesce(get(k), F.lit("")), ","), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return long.select(
        "chr", "pos", "ref", "alt", "library", get("GT").alias("gt"), ints("AD").alias("ad"), ints("PL").alias("pl"),
        F.coalesce(get("DP").try_cast("int"), F.lit(0)).alias("dp"), F.coalesce(get("GQ").try_cast("int"), F.lit(0)).alias("gq"),
        (~F.coalesce(get("GT"), F.lit(".")).contains(".")).alias("called"))


def read_window_matrix(spark: SparkSession, path: str, samples: list[str]) -> DataFrame:
    """Window table: id in the 4th field, then (methylated, coverage) pairs from the 7th on, one row per sample."""
    rows = _fields(spark, path, 6 + 2 * len(samples))
    each = F.array(*[
        F.struct(F.lit(s).alias("sample"), _at(6 + 2 * k).try_cast("double").alias("methylated"), _at(7 + 2 * k).try_cast("double").alias("coverage"))
        for k, s in enumerate(samples)])
    return rows.select(F.regexp_replace(_at(3), "chr", "").alias("window"), F.inline(each))
