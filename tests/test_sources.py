"""Readers and writers on small files."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from fragweave.operators import matrix as M
from fragweave.operators import tissue as TI
from fragweave.sources import sinks as K
from fragweave.sources import text as X


def put(tmp_path, name, text):
    p = tmp_path / name
    if name.endswith(".gz"):
        p.write_bytes(gzip.compress(text.encode()))
    else:
        p.write_text(text)
    return str(p)


def test_bed(spark, tmp_path):
    p = put(tmp_path, "a.bed.gz", "#c\ntrack x\nchr1\t5\t6\nchr1\t7\nchr2\t1\t2\tn\t3.5\t-\nchr2\t1\t2\tn\tx\t?\n")
    got = [tuple(r) for r in X.read_bed(spark, p).collect()]
    assert got == [("chr1", 5, 6, None, None, "."), ("chr2", 1, 2, "n", 3.5, "-"), ("chr2", 1, 2, "n", None, ".")]


def test_bed_methyl_needs_eight_fields(spark, tmp_path):
    p = put(tmp_path, "a.bed", "c\t1\t2\tn\t0\t+\t0.5\t9\nc\t1\t2\tn\t0\t+\t0.5\nc\t3\t4\tn\t0\t-\t0.1\t\t\n")
    assert [r["methy"] for r in X.read_bed_methyl(spark, p).collect()] == [0.5]


def test_matrix_round_trip(spark, tmp_path):
    text = "\t".join([*K.MATRIX_HEADER, "prior"]) + "\n" + "c\t1\t2\tr\t100\t+\tm\t1.5\t30\t4\t5\t50.0\n" + "c\t1\t2\tr\t100\t+\tm\t1.5\t30\t4\t5\tNaN\n" + "c\t1\t2\n"
    m = X.read_feature_matrix(spark, put(tmp_path, "m.tsv", text))
    assert m.columns == M.COLUMNS and [r["prior"] for r in m.collect()] == [50.0, None]
    K.write_matrix(m, str(tmp_path / "out"), ["prior"])
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect() if not r[0].startswith("chr\t"))
    assert lines == ["c\t1\t2\tr\t100\t+\tm\t1.500000\t30\t4\t5\t50.000", "c\t1\t2\tr\t100\t+\tm\t1.500000\t30\t4\t5\tNaN"]


def test_bedgraph_sizes_kmers_sheet(spark, tmp_path):
    g = X.read_bedgraph(spark, put(tmp_path, "g.bg", "track a\nc 0 10 1.5\nc\t10\t20\t2\n"), "t").collect()
    assert [(r["lo"], r["hi"], r["value"]) for r in g] == [(1, 10, 1.5), (11, 20, 2.0)]
    assert X.read_chrom_sizes(spark, put(tmp_path, "s", "c\t100\n")).first()["length"] == 100
    assert {r[0] for r in X.read_kmer_list(spark, put(tmp_path, "k", "#x\nacg\nACG\nTT\n\n")).collect()} == {"ACG", "TT"}
    assert [tuple(r) for r in X.read_sample_sheet(spark, put(tmp_path, "sh", "p\tl\nNA\tl\np\tNA\n")).collect()] == [("p", "l")]
    tracks = X.read_tracks(spark, [f"a:-5:{tmp_path}/g.bg"])
    assert tracks["a"][1] == -5


def test_fasta_and_lookup(spark, tmp_path):
    import random

    rng = random.Random(1)
    seqs = {c: "".join(rng.choice("ACGTn") for _ in range(n)) for c, n in (("c1", 1000), ("c2", 37))}
    text = "".join(f">{c} note\n" + "".join(s[i:i + 13] + "\n" for i in range(0, len(s), 13)) for c, s in seqs.items())
    g = X.read_fasta(spark, put(tmp_path, "g.fa", text), chunk=64)
    got = {}
    for r in g.orderBy("chr", "chunk_start").collect():
        assert r["chunk_start"] == len(got.get(r["chr"], ""))
        got[r["chr"]] = got.get(r["chr"], "") + r["bases"]
    assert got == {c: s.upper() for c, s in seqs.items()}
    at = [("c1", 0), ("c1", 60), ("c1", 63), ("c1", 995), ("c2", 30), ("c1", 128), ("c1", -4), ("c2", 500)]
    rows = spark.createDataFrame(at, "chr string, p long")
    found = {(r["chr"], r["p"]): r["s"] for r in X.genome_lookup(rows, g, "chr", F.col("p"), 11, "s", chunk=64).collect()}
    assert found == {(c, p): seqs[c].upper()[max(p, 0):p + 11] for c, p in at}
    with pytest.raises(ValueError):
        X.genome_lookup(rows, g, "chr", F.col("p"), 65, "s", chunk=64)


def test_sam(spark, tmp_path):
    r = X.read_sam(spark, put(tmp_path, "a.sam", "@HD\tx\nr1\t99\tc\t10\t60\t2S3M1D2M\t=\t50\t90\tacgtacg\tIIIII!!\tMC:Z:5M\tMD:Z:3^A2\n")).first()
    assert (r["read_name"], r["flag"], r["pos"], r["end_pos"], r["bases"], r["md"], r["mc"]) == ("r1", 99, 10, 15, "ACGTACG", "3^A2", "5M")
    assert r["quals"] == [40] * 5 + [0, 0]


def test_vcf(spark, tmp_path):
    text = ("##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"
            "c\t5\t.\tA\tG\t1\tPASS\t.\tGT:AD:DP:GQ:PL\t0/1:3,4:7:50:1,0,2\t./.\nc\t6\t.\tA\tG\t1\tlow\t.\tGT\t0/1\t0/1\n")
    got = {r["library"]: r for r in X.read_vcf(spark, put(tmp_path, "a.vcf", text)).collect()}
    assert set(got) == {"s1", "s2"} and got["s1"]["ad"] == [3, 4] and got["s1"]["pl"] == [1, 0, 2] and got["s1"]["called"] and not got["s2"]["called"]


def test_window_matrix(spark, tmp_path):
    p = put(tmp_path, "w.tsv", "c\t0\t1000\tchr1:0-1000\t.\t+\t0.5\t1\t0.001\t0.002\n")
    t = X.read_window_matrix(spark, p, ["a", "b"])
    lv = {r["sample"]: r["level"] for r in TI.window_levels(t, ["window"], "sample", "methylated", "coverage").collect()}
    assert lv == {"a": 0.5, "b": None} and t.first()["window"] == "1:0-1000"


def test_sink_numbers(spark):
    r = spark.createDataFrame([(None,), (1.23456,)], "v double").select(K.fixed("v", 3).alias("a"), K.na("v").alias("b")).collect()
    assert [tuple(x) for x in r] == [("NaN", "NA"), ("1.235", "1.235")]


def test_vcf_lines(spark):
    g = spark.createDataFrame([(1, "p", "0/1", [1, 2], [0, 1, 2], 3, 9)], "v int, pat string, gt string, ad array<int>, pl array<int>, dp int, gq int")
    assert K.vcf_lines(g, ["v"], "pat").first()["samples"] == {"p": "0/1:1,2:3:9:0,1,2"}


def test_fasta_of_very_many_contigs_and_of_long_ones(spark, tmp_path):
    """A hundred thousand short contigs, and one that goes over many input splits."""
    (tmp_path / "many.fa").write_text("".join(f">c{k} some words\n{'ACGT'[k % 4] * (k % 7)}\n" for k in range(100_000)))
    got = X.read_fasta(spark, str(tmp_path / "many.fa"), chunk=4)
    total, chunks = got.agg(F.sum(F.length("bases")), F.count(F.lit(1))).first()
    assert total == sum(k % 7 for k in range(100_000)) and chunks == sum(-(-(k % 7) // 4) for k in range(100_000))
    assert [tuple(r) for r in got.where("chr in ('c6', 'c99998')").orderBy("chr", "chunk_start").collect()] == [
        ("c6", 0, "GGGG"), ("c6", 4, "GG"), ("c99998", 0, "GGG")]
    rng = random.Random(2)
    seqs = {"a": "".join(rng.choice("ACGTn") for _ in range(50_000)), "b": "".join(rng.choice("acgt") for _ in range(777)), "empty": "", "c": "ACGT" * 5000}
    lines = ["; before the first header"] + [line for name, s in seqs.items() for line in [f">{name}", *[s[i:i + 61] for i in range(0, len(s), 61)], ""]]
    (tmp_path / "long.fa").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = X.read_fasta(spark, str(tmp_path / "long.fa"), chunk=1000).orderBy("chr", "chunk_start").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.openCostInBytes", str(512 << 10))
    got = {}
    for r in rows:
        assert r.chunk_start == len(got.get(r.chr, ""))
        got[r.chr] = got.get(r.chr, "") + r.bases
    assert got == {k: v.upper() for k, v in seqs.items() if v}
