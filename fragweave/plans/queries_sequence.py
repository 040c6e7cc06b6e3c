"""Queries over base sequences, reads, alignments and genotypes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fragweave.functions import reads as R
from fragweave.functions import sequence as S
from fragweave.operators import fragments as FR
from fragweave.operators import merge as ME
from fragweave.plans import bindings as B
from fragweave.sources import text as TX

CHUNK = 256


def kmer_freq(spark, sf):
    t = FR.kmer_frequencies(B.sequences(spark, sf), ["doc_id"], "seq", 2)
    return t.select("doc_id", *[F.round(c, 8).alias(c) for c in t.columns[1:]])


def kmer_freq_sparse(spark, sf):
    t = FR.kmer_frequencies(B.sequences(spark, sf), ["doc_id"], "seq", 4, long=True)
    return t.select("doc_id", "kmer", "n", F.round("freq", 8).alias("freq"))


def gc_content(spark, sf):
    s = F.col("seq")
    return B.sequences(spark, sf).select(
        "doc_id", F.length(s).alias("n"), F.round(S.gc_percent(s), 8).alias("gc"), F.round(S.pattern_frequency(s, "CG"), 8).alias("cg_freq"),
        S.pattern_count(s, "ACA").alias("n_aca"), S.iupac_search(s, "CH").alias("n_ch"), S.iupac_search(s, "WCGW").alias("n_wcgw"))


def revcomp(spark, sf):
    return B.sequences(spark, sf).select("doc_id", S.complement("seq").alias("complement"), S.reverse_complement("seq").alias("reverse_complement"))


def seq_encode(spark, sf):
    return B.aligned_reads(spark, sf).select("doc_id", "i", S.base_digits("ref", 120).alias("ref_digits"), S.base_digits("bases", 120).alias("base_digits"))


def iupac_table(spark, sf):
    """IUPAC comparison and combination of the codes under consecutive letters of every text."""
    codes = B.letter_codes("text", (S.IUPAC_CODES * 2)[:26])
    pairs = F.regexp_extract_all(codes, F.lit("(?=([A-Z]{2}))"), F.lit(1))
    t = B.table(spark, sf, "documents").select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    a, b = F.substring("pair", 1, 1), F.substring("pair", 2, 1)
    return t.select("pair", "n", S.iupac_match(a, b).alias("matches"), S.iupac_overlap(a, b).alias("overlaps"), S.iupac_combine(a, b).alias("combined"),
                    S.is_regular_base(a).alias("regular"), S.base_index(a).alias("base_index"), S.complement(a).alias("complement"))


def _genome(spark, sf, overlap):
    """Sequences as fixed chunks of a contig per document."""
    return FR.cut_sequences(B.sequences(spark, sf), "doc_id", "seq", CHUNK, overlap)


def flank_sequence(spark, sf):
    """Bases around every CpG of every text, fewer at its ends, by chunk lookup; reverse complement on the minus strand."""
    sites = FR.pattern_sites(B.sequences(spark, sf), ["doc_id"], "seq", "CG").select(F.col("doc_id").alias("chr"), "pos0", (F.col("k") % 2 == 1).alias("neg"))
    k = 5
    out = TX.genome_lookup(sites, _genome(spark, sf, 2 * k), "chr", F.col("pos0") - k, 2 * k + 1, "flank", chunk=CHUNK, overlap=2 * k, distinct=True)
    flank = F.when(F.col("neg"), S.reverse_complement("flank")).otherwise(F.col("flank"))
    return out.select("chr", F.col("pos0").cast("long").alias("pos0"), "neg", flank.alias("flank"))


def methyl_call(spark, sf):
    t = B.alignments(spark, sf)
    neg, second = R.has(F.col("flag"), R.REVERSE), R.has(F.col("flag"), R.SECOND)
    mol = R.source_negative(neg, second)
    return t.select("read_name", "line", "partkey", "ref", "base", mol.alias("molecule"), R.methyl_call(mol, F.col("ref"), F.col("base")).alias("state"),
                    R.bisulfite_match(F.col("ref"), F.col("base"), mol).alias("compatible"), R.phred_weight(F.col("qual")).alias("weight"))


def read_filters(spark, sf):
    f = F.col("flag")
    return B.alignments(spark, sf).select(
        "read_name", "line", "partkey", "flag", R.passes_flags(f, F.col("mapq"), 30).alias("strict"),
        R.passes_flags(f, F.col("mapq"), 30, skip_second=True).alias("first_only"), R.passes_flags_loose(f).alias("loose"),
        R.not_proper_pair(f).alias("not_proper"), R.inverted_duplicate(f, F.col("pos"), F.col("mate_pos")).alias("inverted"))


def read_geometry(spark, sf):
    f, pos, mate, n = F.col("flag"), F.col("pos"), F.col("mate_pos"), F.col("read_len")
    neg, mneg, second = R.has(f, R.REVERSE), R.has(f, R.MATE_REVERSE), R.has(f, R.SECOND)
    return B.alignments(spark, sf).select(
        "read_name", "line", "partkey",
        R.read_is_facing(neg, mneg, second, pos, pos + n - 1, mate, n).alias("facing"),
        R.pair_is_facing(neg, second, pos, pos + n - 1, mneg, ~second, mate, mate + n - 1).alias("pair_facing"),
        R.fragment_offset(pos, mate, F.col("insert_size"), n, F.col("read_offset")).cast("int").alias("offset_"),
        R.distance_to_end(pos, mate, n, F.col("read_offset")).cast("int").alias("dist_end"),
        R.v2_offset(pos + F.col("read_offset"), pos, mate, F.col("insert_size"), neg).cast("int").alias("v2_offset"),
        R.inside_trim(F.col("read_offset"), n, neg, second, 5, 10).alias("kept"), S.contig_id("chr").alias("contig"))


def cigar_geometry(spark, sf):
    c, pos = F.col("cigar"), F.col("pos")
    return B.alignments(spark, sf).select(
        "read_name", "line", "partkey", R.mate_end(c, pos).cast("int").alias("mate_end"), R.aligned_end(c, pos).cast("int").alias("aligned_end"),
        R.read_position(c, pos, pos + 5).alias("offset_at_5"))


def conversion_filter(spark, sf):
    t = B.aligned_reads(spark, sf)
    mol = F.col("molecule")
    return t.select("doc_id", "i", R.conversion_filter(F.col("ref"), F.col("bases"), mol).alias("lenient"),
                    R.conversion_filter(F.col("ref"), F.col("bases"), mol, max_ch_rate=0.1, check_mismatch=True).alias("strict"))


def cpg_counts(spark, sf):
    return FR.call_counts(B.aligned_reads(spark, sf), ["doc_id", "i"], min_base_q=10, start=20)


def cpg_locations(spark, sf):
    t = FR.cpg_vectors(B.aligned_reads(spark, sf), ["doc_id", "i"], 120, 40, 30, min_base_q=5)
    text = lambda c, *a: F.array_join(F.col(c).cast("array<string>"), *a)
    return t.select("doc_id", "i", text("locations", ",").alias("locations"), text("states", "", ".").alias("states"))


def merged_fragments(spark, sf):
    t = FR.merge_mates(B.read_mates(spark, sf), ["doc_id", "i"])
    return t.select("doc_id", "i", "ref", "bases", F.aggregate("quals", F.lit(0), lambda a, x: a + x).alias("qual_sum"))


def fragment_metrics(spark, sf):
    """Methylation, density, GC and 2-mer percentages of merged fragments."""
    n1, n2 = F.length("ref1"), F.length("ref2")
    t = B.read_mates(spark, sf).withColumns({"n1": n1, "n2": n2, "frag_len": F.col("start2") + n2})
    t = FR.merged_metrics(t, ["doc_id", "i", "n1", "n2", "frag_len"], 2, min_base_q=5)
    m, u = F.col("m"), F.col("u")
    t = t.withColumns({"methy_frac": F.try_divide(100.0 * m, m + u), "density": FR.methyl_density(m, F.col("frag_len"), F.col("n1"), F.col("n2"))})
    return t.select("doc_id", "i", "m", "u", *[F.round(c, 7).alias(c) for c in ("methy_frac", "density", "gc_perc", "AA", "CG", "GC", "TT")])


def fragment_digits(spark, sf):
    return FR.fragment_digits(B.aligned_reads(spark, sf), ["doc_id", "i"], 110, min_base_q=5).select("doc_id", "i", "ref_digits", "methy_digits")


def mate_pairs(spark, sf):
    t = B.alignments(spark, sf).selectExpr("read_name", "line", "pos", "mapq", "(flag & 128) != 0 as second", "partkey")
    out = FR.mate_pairs(t, "read_name", "second", "pos", tolerate_single=True)
    return out.select("read_name", F.col("left.pos").alias("left_pos"), F.col("right.pos").alias("right_pos"), F.col("left.line").alias("left_line"),
                      F.col("right.line").alias("right_line"))


def stat_merge(spark, sf):
    """Per-supplier statistics of four measures, merged over suppliers."""
    long = B.table(spark, sf, "lineitem").select("l_suppkey", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("v")) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")])))
    part = long.groupBy("l_suppkey", "feature").agg(F.count("v").alias("n"), F.min("v").alias("minimum"), F.max("v").alias("maximum"),
                                                    F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    t = ME.merge_feature_stats(part, ["feature"])
    return t.select("feature", "n", "minimum", "maximum", F.round("mean", 5).alias("mean"), F.round("sd", 5).alias("sd"))


def genotype_merge(spark, sf):
    t = ME.merge_genotypes(B.genotypes(spark, sf), ["variant"], "patient", "library")
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return t.select("variant", "patient", "gt", text("ad").alias("ad"), text("pl").alias("pl"), "dp", "gq")


def patient_libraries(spark, sf):
    sheet = B.table(spark, sf, "orders").selectExpr("case when o_custkey % 10 = 0 then 'NA' else cast(o_custkey as string) end as patient",
                                                    "case when o_orderstatus = 'P' then 'NA' else cast(o_orderkey as string) end as lib")
    known = B.table(spark, sf, "lineitem").selectExpr("cast(l_orderkey as string) as library")
    return ME.patient_libraries(sheet, "patient", "lib", known)


def union_parts(spark, sf):
    m = B.matrix(spark, sf)
    parts = [m.where(F.col("strand") == s).select("chr", "start_", "read_name", "strand") for s in ("+", "-")]
    return ME.union_parts(parts)
