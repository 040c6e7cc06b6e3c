"""Gapped mates, k-mers, extents, contexts and mate checks against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fragweave.functions import reads as R
from fragweave.operators import fragments as FR
from fragweave.sources import text as TX


def plain_merge(m1, m2, first_is_left, gap_extra=2):
    """Read the first end base by base; add what the second end has beyond it."""
    def places(m):
        out, at = [], m["start"]
        for n, op in re.findall(r"(\d+)([MIDNSHP=X])", m["cigar"]):
            n = int(n)
            if op in "M=X":
                out += range(at, at + n)
                at += n
            elif op in "IS":
                out += [None] * n
            elif op in "DN":
                at += n
        return out, at - 1

    (p1, end1), (p2, _) = places(m1), places(m2)
    lead, rest = (m1, m2) if first_is_left else (m2, m1)
    pl, pr = (p1, p2) if first_is_left else (p2, p1)
    where = {p: k for k, p in enumerate(pr) if p is not None}
    body, met = [], []
    for k, p in enumerate(pl):
        mine, other = (lead["ref"][k], lead["bases"][k], lead["quals"][k]), None
        if p is not None and p in where:
            j = where[p]
            met.append(j)
            other = rest["ref"][j], rest["bases"][j], rest["quals"][j]
        body.append(other if other and other[1].upper() != mine[1].upper() and mine[2] < other[2] else mine)
    whole = list(zip(rest["ref"], rest["bases"], rest["quals"]))
    gap = [] if met else [("N", "N", 0)] * max(m2["start"] - end1 - 1 + gap_extra, 0)
    out = body + gap + whole[max(met) + 1 if met else 0:] if first_is_left else (whole[:min(met)] if met else whole) + gap + body
    return "".join(x[0] for x in out), "".join(x[1] for x in out), [x[2] for x in out]


def random_mate(rng, start):
    ops = [(rng.randint(1, 12), rng.choice("MMMMIDN=X")) for _ in range(rng.randint(1, 6))]
    if rng.random() < 0.4:
        ops = [(rng.randint(1, 4), "H")] * (rng.random() < 0.5) + [(rng.randint(1, 4), "S")] + ops
    n = sum(k for k, o in ops if o in "MIS=X")
    return {"start": start, "cigar": "".join(f"{k}{o}" for k, o in ops), "ref": "".join(rng.choice("ACGT") for _ in range(n)),
            "bases": "".join(rng.choice("ACGTacN") for _ in range(n)), "quals": [rng.randrange(41) for _ in range(n)]}


MATES = ", ".join(f"start{k} int, cigar{k} string, ref{k} string, bases{k} string, quals{k} array<int>" for k in (1, 2))


def test_gapped_mates_match_a_plain_merge(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for i in range(3000):
        a = rng.randint(1, 10 ** 9)
        m1, m2, left = random_mate(rng, a), random_mate(rng, a + rng.randint(0, 70)), rng.random() < 0.5
        rows.append((i, *m1.values(), *m2.values(), left))
        want[i] = plain_merge(m1, m2, left)
    got = FR.merge_gapped_mates(spark.createDataFrame(rows, f"id int, {MATES}, first_is_left boolean").repartition(3), ["id"])
    assert {r.id: (r.ref, r.bases, r.quals) for r in got.collect()} == want


def test_gapped_mates_with_missing_parts(spark):
    whole = (1, "2M", "AC", "AC", [1, 2])
    rows = [(1, *whole, 3, "2M", "GT", "GT", [3, 4], True), (2, *whole, 3, None, "GT", "GT", [3, 4], True), (3, *whole, *whole, None),
            (4, 1, "*", "", "", [], 2, "1M", "G", "G", [9], True), (None, *whole, *whole, False)]
    df = spark.createDataFrame(rows, f"id int, {MATES}, first_is_left boolean")
    got = {r.id: (r.ref, r.bases, r.quals) for r in FR.merge_gapped_mates(df, ["id"]).collect()}
    # the gap between touching mates is as long as the format's extra two positions
    assert got == {1: ("ACNNGT", "ACNNGT", [1, 2, 0, 0, 3, 4]), 2: (None,) * 3, 3: (None,) * 3, 4: ("NNNG", "NNNG", [0, 0, 0, 9]), None: ("AC", "AC", [1, 2])}
    assert FR.merge_gapped_mates(df.limit(0), ["id"]).count() == 0


def test_a_cigar_that_does_not_fit_its_read_is_an_error(spark):
    rows = [(1, 1, "5M", "AC", "AC", [1, 2], 3, "2M", "GT", "GT", [3, 4], True)]
    with pytest.raises(Exception, match="equally long"):
        FR.merge_gapped_mates(spark.createDataFrame(rows, f"id int, {MATES}, first_is_left boolean"), ["id"]).collect()


def plain_kmers(seq, turned, first, last):
    if turned:
        seq = "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(c.upper(), "N") for c in reversed(seq))
    out = {}
    for k in range(first, last + 1):
        for p in range(len(seq) - k + 1):
            w = seq[p:p + k].upper()
            if set(w) <= set("ACGT"):
                out[w] = out.get(w, 0) + 1
    return {w: (n, 100.0 * n / (len(seq) - len(w) + 1)) for w, n in out.items()}


def test_fragment_kmers_match_plain_counts(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ACGTACGTacgtN") for _ in range(rng.randint(0, 60))), rng.random() < 0.5) for i in range(400)]
    rows += [(900, None, True), (901, "", False), (902, "A", False), (903, "NNNN", True), (904, "é" * 5 + "ACG", False), (905, "ACGT", None)]
    df = spark.createDataFrame(rows, "id int, s string, neg boolean").repartition(3)
    got = {}
    for r in FR.fragment_kmers(df, ["id"], "s", 2, 4, reverse="neg").collect():
        got.setdefault(r.id, {})[r.kmer] = (r.n, r.freq)
    for i, s, neg in rows:
        if i != 904:
            assert got.get(i, {}) == plain_kmers(s or "", neg, 2, 4)
    assert set(got[904]) == {"AC", "CG", "ACG"}
    assert FR.fragment_kmers(df.limit(0), ["id"], "s", 1, 3).count() == 0


def test_selected_kmers_become_columns(spark):
    df = spark.createDataFrame([(1, "ACACG"), (2, "TTTT")], "id int, s string")
    t = FR.fragment_kmer_maps(df, ["id"], "s", 2, 2, selected=["AC", "GG"])
    assert [tuple(r) for r in t.collect()] == [(1, 50.0, 0.0)]
    whole = {r.id: r.frag_kmers for r in FR.fragment_kmer_maps(df, ["id"], "s", 2, 2).collect()}
    assert whole == {1: {"AC": 50.0, "CA": 25.0, "CG": 25.0}, 2: {"TT": 100.0}}


def test_extents_count_both_mates_and_their_tags(spark):
    rows = [("a", "chr1", 100, 149, 200, "10M5I3D20M4S", "A" * 50), ("a", "chr1", 200, 228, 100, None, "A" * 30), ("b", "chr1", 10, 20, 0, None, "A" * 500),
            ("c", "chr1", 50, 60, 30, None, "A" * 100), ("a", "chr2", 5, 6, 5, "2M", "AC")]
    df = spark.createDataFrame(rows, "read_name string, chr string, pos int, end_pos int, mate_pos int, mc string, bases string")
    got = {(r.chr, r.read_name): (r.lo, r.hi, r.n_records) for r in FR.fragment_extents(df, ["chr", "read_name"]).collect()}
    assert got == {("chr1", "a"): (100, 234, 2), ("chr1", "b"): (10, 20, 1), ("chr1", "c"): (30, 129, 1), ("chr2", "a"): (5, 6, 1)}


def test_pair_reasons_in_their_order(spark):
    first, second = 99, 147  # forward first end, reverse second end
    rows = [("kept", first, 100, 149, 200), ("kept", second, 250, 299, -200), ("alone", first, 1, 50, 90), ("flags", first | 4, 1, 50, 90), ("flags", second, 60, 90, -90),
            ("same_way", first, 1, 50, 90), ("same_way", second & ~16, 41, 90, -90), ("long", first, 1, 50, 900), ("long", second, 851, 900, -900),
            ("differ", first, 1, 50, 90), ("differ", second, 41, 90, -91), ("three", first, 1, 50, 90), ("three", second, 41, 90, -90), ("three", second, 41, 90, -90)]
    df = spark.createDataFrame(rows, "read_name string, flag int, pos int, end_pos int, insert_size int")
    got = dict(map(tuple, FR.pair_reasons(df, ["read_name"], good=R.passes_flags_loose(F.col("flag"))).collect()))
    assert got == {"kept": "kept", "alone": "records", "flags": "flags", "same_way": "orientation", "long": "too_long", "differ": "lengths_differ", "three": "records"}


def test_context_on_both_strands_and_at_the_ends(spark):
    seq = "ACGTTCGGA"
    genome = spark.createDataFrame([("c", 0, seq[:4]), ("c", 4, seq[4:8]), ("c", 8, seq[8:])], "chr string, chunk_start long, bases string")
    sites = spark.createDataFrame([("c", 6, "+"), ("c", 7, "-"), ("c", 2, "+"), ("c", 3, "-"), ("x", 3, "-")], "chr string, end_ int, strand string")
    got = {(r.chr, r.end_): r.context for r in FR.strand_context(sites, genome, 1, chunk=4).collect()}
    assert got == {("c", 6): "TCGG", ("c", 7): "CCGA", ("c", 2): "ACGT", ("c", 3): "ACGT", ("x", 3): ""}
    plain = {r.end_: r.context for r in FR.strand_context(sites.where("chr = 'c'"), genome, 1, turn=False, chunk=4).collect()}
    assert plain[7] == "TCGG"


def test_look_ups_of_varying_length(spark):
    genome = spark.createDataFrame([("c", 0, "ACGTA"), ("c", 5, "CCGGT")], "chr string, chunk_start long, bases string")
    rows = spark.createDataFrame([(3, 4), (0, 1), (-2, 4), (8, 5)], "a int, n int").withColumn("chr", F.lit("c"))
    got = {r.a: r.s for r in TX.genome_lookup(rows, genome, "chr", F.col("a"), F.col("n"), "s", chunk=5, longest=5).collect()}
    assert got == {3: "TACC", 0: "A", -2: "AC", 8: "GT"}
    with pytest.raises(Exception, match="more than 4"):
        TX.genome_lookup(rows, genome, "chr", F.col("a"), F.col("n"), "s", chunk=5, longest=4).collect()
