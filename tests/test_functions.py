"""Statistics, sequence and read functions on hand-made input."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragweave.functions import numeric as NU
from fragweave.functions import reads as R
from fragweave.functions import sequence as S
from fragweave.operators import fragments as FR
from fragweave.operators import merge as ME
from fragweave.operators import sites as SI
from fragweave.operators import windows as W
from fragweave.operators.intervals import Span


def one(spark, *cols, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return tuple(df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_student_p_against_known_values():
    t = np.array([0.0, 2.228138852, 12.7062047, 1.959963985, np.inf])
    df = np.array([5.0, 10.0, 1.0, 1e7, 3.0])
    np.testing.assert_allclose(NU.student_two_sided(t, df), [1.0, 0.05, 0.05, 0.05, 0.0], atol=1e-6)


def test_pearson_needs_points_and_variance(spark):
    r = lambda xs, ys: one(spark, NU.pearson_from_sums(*[F.lit(float(v)) for v in (
        len(xs), sum(xs), sum(ys), sum(x * x for x in xs), sum(y * y for y in ys), sum(x * y for x, y in zip(xs, ys)))]))[0]
    assert r([1, 2, 3], [2, 4, 6]) == pytest.approx(1)
    assert r([1, 1, 1], [2, 4, 6]) is None and r([1], [2]) is None


@pytest.mark.parametrize("values", [[5.0] * 50, list(range(101)), [1e300, -1e300, 0.0, 1e-300] * 5, [random.Random(1).gauss(0, 1e6) for _ in range(500)]])
def test_values_at_ranks(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    ranks = [1, len(values) // 2, len(values)]
    assert NU.values_at_ranks(df, "v", ranks) == {r: sorted(values)[r - 1] for r in ranks}
    assert NU.linear_quantile(df, "v", 0.9) == pytest.approx(float(np.quantile(values, 0.9)), rel=1e-12)


def test_grouped_ranks(spark):
    df = spark.range(1000).selectExpr("case when id % 3 = 0 then 'a' else 'b' end as g", "cast(id as double) as v")
    assert NU.values_at_ranks(df, "v", [], "g", {"a": [1, 334], "b": [2]}) == {("a", 1): 0.0, ("a", 334): 999.0, ("b", 2): 2.0}


def test_sequence_functions(spark):
    c = F.lit
    assert one(spark, S.complement(c("ACGTRYN")), S.reverse_complement(c("AACG")), S.base_digits(c("ATCGn"), 7)) == ("TGCAYRN", "CGTT", "1234500")
    assert one(spark, S.pattern_count(c("CGCGCG"), "CGC"), S.pattern_count(c("AAAA"), "AA"), S.iupac_search(c("CACGCTC"), "CH")) == (2, 3, 2)
    assert one(spark, S.pattern_frequency(c("C"), "CG"), S.gc_percent(c("GGCA"))) == (None, 75.0)
    assert one(spark, S.contig_id(c("chrX")), S.contig_id(c("7")), S.contig_id(c("chrMT")), S.contig_id(c("chrUn"))) == (23, 7, 25, None)
    assert one(spark, S.b37_name(c("chrM")), S.b37_name(c("chr1")), S.add_chr(c("2"))) == ("MT", "1", "chr2")
    assert one(spark, S.iupac_combine(c("A"), c("G")), S.iupac_match(c("R"), c("C")), S.iupac_overlap(c("Y"), c("S"))) == ("R", False, True)
    assert one(spark, S.one_hot(c("A"), c(True)), S.one_hot(c("N"), c(False))) == ([0.0, 1.0, 0.0, 0.0], [0.25] * 4)


def test_kmer_windows_with_other_letters_stay_in_the_denominator(spark):
    df = spark.createDataFrame([(1, "AANAA"), (2, "A")], "id int, s string")
    got = {r["id"]: r for r in FR.kmer_frequencies(df, ["id"], "s", 2).collect()}
    assert got[1]["AA"] == pytest.approx(50.0) and got[1]["CG"] == 0.0 and got[2]["AA"] == 0.0


def test_reference_from_md(spark):
    cases = [
        ("ACGTACGT", "8M", "8", "ACGTACGT"),
        ("ACGTACGT", "8M", "3A4", "ACGAACGT"),
        ("ACGTTACGT", "4M1I4M", "2C5", "ACCTTACGT"),
        ("ACGTACGT", "4M2D4M", "4^GG4", "ACGTACGT"),
        ("TTACGTACGT", "2S8M", "0C7", "CCGTACGT"),
    ]
    for bases, cigar, md, want in cases:
        assert one(spark, R.reference_from_md(F.lit(bases), F.lit(cigar), F.lit(md))) == (want,), (cigar, md)


def test_cigar_functions(spark):
    cg = F.lit("2S3M1I4M2D5M")
    assert one(spark, R.mate_end(cg, F.lit(100)), R.aligned_end(cg, F.lit(100))) == (112, 113)
    assert one(spark, *[R.read_position(cg, F.lit(100), F.lit(p)) for p in (100, 103, 107, 109, 113, 114)]) == (2, 6, None, 10, 14, None)
    assert one(spark, R.aligned_bases(F.lit("1S2M1I2M1D1M"), F.lit("xACgGTC"))) == ("ACGTNC",)
    assert one(spark, R.clip(F.lit("AACCGG"), F.lit(2), F.lit(1))) == ("CCG",)


def test_merging_mates(spark):
    q = lambda *v: F.array(*[F.lit(x) for x in v])
    m = R.merged_fragment(F.lit(10), F.lit("AACC"), F.lit("AATC"), q(9, 9, 5, 5), F.lit(12), F.lit("CCGG"), F.lit("CAGG"), q(9, 5, 9, 9), F.lit(True))
    assert one(spark, m)[0].asDict() == {"ref": "AACCGG", "bases": "AACCGG", "quals": [9, 9, 9, 5, 9, 9]}
    tie = R.merged_fragment(F.lit(10), F.lit("AACC"), F.lit("AATC"), q(9, 9, 5, 5), F.lit(12), F.lit("CCGG"), F.lit("CAGG"), q(5, 5, 9, 9), F.lit(False))
    assert one(spark, tie)[0]["bases"] == "AACAGG"
    gap = R.merged_fragment(F.lit(10), F.lit("AA"), F.lit("AA"), q(9, 9), F.lit(15), F.lit("GG"), F.lit("GG"), q(9, 9), F.lit(True), gap_extra=0)
    assert one(spark, gap)[0]["bases"] == "AANNNGG"


def test_single_read_percentiles_and_positions(spark):
    df = spark.createDataFrame([("s", float(v)) for v in (1, 2, 3, 10)], "site string, v double")
    r = SI.site_distribution(df, ["site"], {"v": F.col("v")}).first()
    assert (r["p10"], r["p50"], r["p90"], r["p100"]) == (1.0, 2.5, 10.0, 10.0)
    assert r["p30"] == pytest.approx(1.5) and r["sd"] == pytest.approx(np.std([1, 2, 3, 10], ddof=1))


def test_pair_concordance_against_all_pairs(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xy"), rng.choice("+-"), rng.randrange(5), rng.randrange(5), rng.choice("mu"), f"r{rng.randrange(9)}") for _ in range(80)]
    df = spark.createDataFrame(rows, "site string, strand string, o int, d int, st string, name string")
    got = SI.pair_concordance(df, ["site"], strand="strand", offset="o", dist="d", state="st", name="name", min_dist=1).first()
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1:] if a[:2] == b[:2] and a[5] != b[5] and abs(a[2] - b[2]) == 1 and abs(a[3] - b[3]) == 1]
    assert got["n_pairs"] == len(pairs) and got["n_concordant"] == sum(a[4] == b[4] for a, b in pairs)
    with pytest.raises(ValueError):
        SI.pair_concordance(df, ["site"], strand="strand", offset="o", dist="d", state="st", name="name", min_dist=0)


def test_windows_leave_out_a_partial_last_one(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 1001), ("c", 2501)], "chr string, length long")
    got = sorted((r["chr"], r["w_start"]) for r in W.genome_windows(sizes, 1000, 500).collect())
    assert got == [("b", 0), ("c", 0), ("c", 500), ("c", 1000), ("c", 1500)]


def test_hot_window_median_equals_plain_median(spark):
    wins = spark.createDataFrame([("c", 1, 100), ("c", 101, 200)], "chr string, lo int, hi int")
    track = spark.range(999).selectExpr("'c' as t_chr", "cast(id % 100 + 1 as int) as p", "sin(id) as v")
    args = (wins, track, Span("chr", "lo", "hi"), Span("t_chr", "p", "p"), "v")
    plain = sorted(map(tuple, W.value_stats(*args).collect()))
    hot = sorted(map(tuple, W.value_stats(*args, hot_rows=100).collect()))
    assert [r[:4] for r in plain] == [r[:4] for r in hot] and plain[1][3] == 0
    assert hot[0][-1] == pytest.approx(plain[0][-1]) == pytest.approx(float(np.median(np.sin(np.arange(999)))))


def test_pairs_contract(spark):
    df = spark.createDataFrame([("a", 5, False), ("a", 2, True), ("b", 1, False)], "n string, pos int, second boolean")
    assert [r["left"]["pos"] for r in FR.mate_pairs(df, "n", "second", "pos", tolerate_single=True).collect()] == [2]
    with pytest.raises(Exception, match="two records"):
        FR.mate_pairs(df, "n", "second", "pos").collect()


def test_genotype_seed_and_ties(spark):
    s = "v int, pat string, lib string, gt string, ad array<int>, pl array<int>, dp int, gq int, called boolean"
    rows = [(1, "p", "l1", "0/0", [5, 0], [0, 1, 2], 5, 50, True), (1, "p", "l2", "0/1", [1, 1], [1, 0, 1], 2, 30, True), (1, "p", "l3", "0/1", [2, 2], [1, 0, 1], 4, 30, True),
            (2, "p", "l1", "./.", [0, 0], [0, 0, 0], 0, 0, False),
            (3, "p", "l1", "0/0", [9, 0], [0, 1, 2], 9, 10, True), (3, "p", "l2", "0/1", [1, 1], [1, 0, 1], 2, 10, True)]
    got = {r["v"]: r for r in ME.merge_genotypes(spark.createDataFrame(rows, s), ["v"], "pat", "lib").collect()}
    assert (got[1]["gt"], got[1]["ad"], got[1]["dp"], got[1]["gq"]) == ("0/1", [3, 3], 6, 60)
    assert got[2]["gt"] == "./." and got[3]["gt"] == "0/1"


def test_stat_merge_pools_within_parts(spark):
    rows = [("f", 2, 0.0, 4.0, 1.0, 1.0), ("f", 6, -1.0, 9.0, 3.0, 2.0)]
    r = ME.merge_feature_stats(spark.createDataFrame(rows, "k string, n long, minimum double, maximum double, mean double, sd double"), ["k"]).first()
    assert (r["n"], r["minimum"], r["maximum"], r["mean"]) == (8, -1.0, 9.0, 2.5) and r["sd"] == pytest.approx(math.sqrt((2 + 24) / 8))
