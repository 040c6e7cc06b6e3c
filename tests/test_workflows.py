"""From alignments to predictions on a small made-up library."""

import random

import pytest
from pyspark.sql import functions as F

from fragweave.operators.intervals import Span
from fragweave.plans import workflows as WF

CHUNK = 64


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(4)
    genome = "".join(rng.choice("ACGT") + ("CG" if rng.random() < 0.2 else "") for _ in range(800))
    sites = [("chr1", i, i + 1) for i in range(len(genome) - 1) if genome[i:i + 2] == "CG"]
    reads = []
    for k in range(150):
        n = 40
        size = rng.randrange(90, 160)
        start = rng.randrange(0, len(genome) - size)
        cut = genome[start:start + n]
        bases = "".join("T" if c == "C" and (cut[i + 1:i + 2] != "G" or rng.random() < 0.4) else c for i, c in enumerate(cut))
        reads.append((f"r{k}", 99, "chr1", start + 1, 60, f"{n}M", start + size - n + 1, size, bases, [30 if rng.random() < 0.9 else 3] * n, None, None, start + n))
    reads.append(("bad", 99 | 1024, "chr1", 1, 60, "40M", 90, 130, genome[:40], [30] * 40, None, None, 40))
    schema = ("read_name string, flag int, chr string, pos int, mapq int, cigar string, mate_pos int, insert_size int, bases string, quals array<int>, "
              "md string, mc string, end_pos int")
    chunks = [("chr1", i, genome[i:i + CHUNK]) for i in range(0, len(genome), CHUNK)]
    return dict(genome=genome, sites=sites, reads=reads, s=spark.createDataFrame(sites, "chr string, start_ int, end_ int"),
                r=spark.createDataFrame(reads, schema), g=spark.createDataFrame(chunks, "chr string, chunk_start long, bases string"))


def expected(w):
    out = {}
    good = [r for r in w["reads"] if r[0] != "bad"]
    for c, a, b in w["sites"]:
        over = [r for r in good if r[3] <= b <= r[12]]
        for r in over:
            off = b - r[3]
            state = {"C": "m", "T": "u"}.get(r[8][off])
            if r[9][off] > 5 and state:
                out[(a, r[0])] = (state, off, off, r[7], pytest.approx(len(over) / (len(good) / 1e6)))
    return out


def test_extract_matrix(spark, world):
    prior = spark.createDataFrame([("chr1", a, b, float(a % 100)) for _, a, b in world["sites"]], "chr string, lo int, hi int, v double")
    tracks = spark.createDataFrame([("chr1", 100, 200, "+", 1.0)], "chr string, lo int, hi int, strand string, value double")
    m = WF.extract_matrix(world["r"], world["s"], world["g"], prior=(prior, Span("chr", "lo", "hi"), "v", 0), overlap_tracks={"in_t": tracks},
                          distance_tracks={"d": tracks}, value_tracks={"val": (tracks, 10)}, ref_kmers=2, kmer_ext=3, chunk=CHUNK)
    rows = m.collect()
    got = {(r["start_"], r["read_name"]): (r["methy_stat"], r["offset_"], r["dist_end"], r["frag_len"], r["norm_cov"]) for r in rows}
    assert len(rows) == len(got) and got == expected(world)
    for r in rows:
        inside = r["start_"] <= 200 and r["end_"] >= 100
        assert r["in_t"] == int(inside) and (r["d"] == 0) == inside
        assert (r["val"] == 1.0) == (r["start_"] - 10 <= 200 and r["end_"] + 10 >= 100)
    i = next(r for r in rows if r["start_"] > 10)
    flank = world["genome"][i["start_"] - 3: i["start_"] + 4]
    assert i["CG"] == pytest.approx(100 * sum(flank[k:k + 2] == "CG" for k in range(6)) / 6)


def test_extract_matrix_with_fragment_features(spark, world):
    """K-mers of the fragment on its strand, contexts, neighbours and both kinds of track means."""
    track = spark.createDataFrame([("chr1", 100, 120, 2.0), ("chr1", 121, 121, 8.0)], "chr string, lo int, hi int, value double")
    cpgs = world["s"].withColumn("strand", F.lit("."))
    wide, seq = 256, world["genome"]
    g = spark.createDataFrame([("chr1", i, seq[i:i + wide]) for i in range(0, len(seq), wide)], "chr string, chunk_start long, bases string")
    m = WF.extract_matrix(world["r"], world["s"], g, chunk=wide, frag_kmers=2, context=2, all_sites=cpgs, max_frag_len=wide,
                          value_tracks={"records": (track, 30)}, base_tracks={"bases": (track, 30)})
    plain = WF.extract_matrix(world["r"], world["s"], world["g"], chunk=CHUNK)
    rows, genome, starts = m.collect(), world["genome"], sorted(a for _, a, _ in world["sites"])
    key = lambda r: (r["start_"], r["read_name"])
    at_cg = {key(r) for r in plain.collect() if genome[r["start_"]] in "CG"}
    assert {key(r) for r in rows} == at_cg and len(rows) == len(at_cg) > 0
    ends = {}
    for r in world["reads"]:
        if r[0] != "bad":
            n = len(r[8])
            mate = (r[6], r[6] + n - 1) if r[6] > 0 else (r[3], r[12])
            lo, hi = ends.get(r[0], (10 ** 9, 0))
            ends[r[0]] = min(lo, r[3], mate[0]), max(hi, r[12], mate[1])
    turn = str.maketrans("ACGT", "TGCA")
    for r in rows:
        a, (lo, hi) = r["start_"], ends[r["read_name"]]
        minus = r["strand"] == "-"
        seq = genome[lo - 1:hi]
        seq = seq.translate(turn)[::-1] if minus else seq
        pairs = [seq[i:i + 2] for i in range(len(seq) - 1)]
        assert r["frag_kmers"] == pytest.approx({k: 100 * pairs.count(k) / len(pairs) for k in set(pairs)})
        begin = a - 2 - minus
        context = genome[max(begin, 0):begin + 6]
        assert r["context"] == (context.translate(turn)[::-1] if minus else context)
        back, ahead = (1, 2) if genome[a] == "C" else (2, 1)
        others = [abs(x - a) for x in starts if x <= a - back or x >= a + ahead]
        assert (r["nearest_cpg"] is None) == (not others)
        window = [x for x in range(max(a - 30, 1), a + 1 + 30 + 1) if 100 <= x <= 121]
        if window:
            assert r["bases"] == pytest.approx(sum(8.0 if x == 121 else 2.0 for x in window) / len(window))
            assert r["records"] == pytest.approx(sum(v for lo, hi, v in ((100, 120, 2.0), (121, 121, 8.0)) if hi >= max(a - 30, 1) and lo <= a + 31) / sum(hi >= max(a - 30, 1) and lo <= a + 31 for lo, hi in ((100, 120), (121, 121))))
        else:
            assert r["bases"] is None and r["records"] is None


def test_train_and_predict(spark, world):
    m = WF.extract_matrix(world["r"], world["s"], world["g"], chunk=CHUNK).withColumn("prior", F.col("start_") % 101 * 1.0)
    region = spark.createDataFrame([("chr1", 0, 10 ** 6)], "chr string, lo int, hi int")
    none = spark.createDataFrame([("chr2", 0, 10 ** 6)], "chr string, lo int, hi int")
    frags = WF.training_fragments(m, regions=region, exclude=none, region_span=Span("chr", "lo", "hi"), outlier=3.0)
    for init in ("gmm", "observed"):
        t = WF.train_model(frags, init=init, max_iter=3, kl_min_len=3)
        p = WF.predict(frags, t.model)
        total = frags.agg(F.sum("n")).first()[0]
        assert p.agg(F.sum("total_count_predict")).first()[0] == total > 0
    low = WF.training_fragments(m, low_coverage=True)
    assert "z_cov" not in low.columns
    assert WF.predict(low, WF.train_model(low, low_coverage=True, max_iter=2, kl_min_len=3).model, low_coverage=True).count() > 0
