"""One small case for each finding of a review that would have failed before."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from __spark_entry__ import queries

from pyspark.sql import functions as F

from fragweave.functions import basekernel as K
from fragweave.functions import reads as R
from fragweave.functions import sequence as S
from fragweave.operators import fragments as FR
from fragweave.operators import intervals as I
from fragweave.operators import sites as SI
from fragweave.operators import skew
from fragweave.operators import windows as W
from fragweave.operators.intervals import Span
from fragweave.sources import text as TX
from tests.conftest import SF


def test_mates_of_a_later_slice_of_a_batch():
    bases = ["ACGTA" + "C" * (k % 7) for k in range(50)]
    text, cigar = pa.array(bases), pa.array([f"{len(b)}M" for b in bases])
    quals = pa.array([[1] * len(b) for b in bases], pa.list_(pa.int32()))
    part = [c.slice(30, 10) for c in (cigar, text, text, quals)]
    skip = np.arange(10) == 4
    mate = K.mate(np.zeros(10, np.int64), *part, skip)
    want = ["" if k == 4 else b for k, b in enumerate(bases[30:40])]
    assert mate.bases.data.tobytes().decode() == "".join(want)
    assert mate.bases.length.tolist() == [len(b) for b in want] and len(mate.quals) == len(mate.bases.data)


def test_every_window_has_its_variability(spark):
    t = queries()["most_variable_windows"](spark, SF).toPandas()
    assert len(t) == spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").distinct().count()
    assert 0 < t["variable"].sum() <= len(t) // 100 + 1
    assert t.loc[t["variable"], "sd"].min() >= t.loc[~t["variable"], "sd"].max()


def test_no_fragment_meets_a_site_that_is_too_deep(spark, monkeypatch):
    sites = spark.createDataFrame([("c", 10, 11, "+", 1.0), ("c", 90, 91, "+", 1.0)], "chr string, start_ int, end_ int, strand string, prior double")
    frags = spark.createDataFrame([("c", k, 60, f"f{k}", 40, "+-"[k % 2]) for k in range(5)] + [("c", 80, 100, "g", 40, "+")],
                                  "f_chr string, f_start int, f_end int, f_name string, f_mapq int, f_strand string")
    met, pairs = [], SI.overlap_pairs
    monkeypatch.setattr(SI, "overlap_pairs", lambda left, right, *a, **k: met.append([r["start_"] for r in right.collect()]) or pairs(left, right, *a, **k))
    out = SI.fragment_matrix_from_bed(sites, frags, max_coverage=4).collect()
    assert met == [[90]] and [(r["read_name"], r["norm_cov"]) for r in out] == [("g", 1 / (6 / 1e6))]
    deep = SI.fragment_matrix_from_bed(sites, frags, max_coverage=5).collect()
    assert sorted(r["read_name"] for r in deep) == ["f0", "f2", "f4", "g"]


def test_site_bedgraph_makes_no_pairs(spark):
    sites = spark.createDataFrame([("c", 5, 5), ("c", 5000, 5000), ("c", 9, 9)], "chr string, lo int, hi int")
    calls = spark.createDataFrame([("c", 1, 5, "m"), ("c", 5, 4999, "U"), ("c", 2, 8, "x"), ("d", 5, 5, "m")], "k string, a int, b int, state string")
    t = SI.site_bedgraph(sites, calls, Span("chr", "lo", "hi"), Span("k", "a", "b"), "state")
    assert sorted(map(tuple, t.collect())) == [("c", 4, 5, 0.5, 2), ("c", 8, 9, 0.0, 1)]
    assert "Join" not in t._jdf.queryExecution().executedPlan().toString()


def test_rows_that_share_an_interval_are_matched_once(spark, monkeypatch):
    rows = spark.createDataFrame([("c", k % 3 * 300, k % 3 * 300 + 20, k) for k in range(60)] + [(None, 1, 2, 60)], "c string, lo int, hi int, id int")
    right = spark.createDataFrame([("c", 0, 310, 1), ("c", 20, 20, 2), ("c", 600, 601, 3), ("d", 0, 900, 4)], "rc string, rlo int, rhi int, rid int")
    probed, plain = [], I._overlap
    monkeypatch.setattr(I, "_overlap", lambda left, *a: probed.append(left.count()) or plain(left, *a))
    got = {n: sorted((r["id"], r["rid"]) for r in I.overlap_pairs(rows, right, Span("c", "lo", "hi"), Span("rc", "rlo", "rhi"), broadcast_rows=n, hot_rows=h).collect())
           for n, h in ((500_000, 1000), (0, 7))}
    want = sorted((k, r) for k in range(60) for r in ((1, 2), (1,), (3,))[k % 3])
    assert got == {500_000: want, 0: want} and probed == [4, 4]


def test_tasks_are_cut_by_the_pairs_they_make(spark, monkeypatch):
    monkeypatch.setattr(skew, "TASK_PAIRS", 500, raising=False)
    spots = [0 if k % 2 else k % 24 * 100 for k in range(1200)]  # half of the rows share one interval
    rows = spark.createDataFrame([("c", p, p + 1, k) for k, p in enumerate(spots)] + [("d", 1, 2, k) for k in range(99)] + [(None, 0, 1, 7)] * 9,
                                 "c string, lo int, hi int, id int").coalesce(1)
    regions = [(0, 1500, k // 2) for k in range(30)] + [(1200, 1200, None), (9000, 9001, 40)]
    right = spark.createDataFrame([("c", *r) for r in regions], "rc string, rlo int, rhi int, rid int")
    out = I.overlap_pairs(rows, right, Span("c", "lo", "hi"), Span("rc", "rlo", "rhi")).withColumn("task", F.spark_partition_id()).collect()
    want = sorted((k, str(r)) for k, p in enumerate(spots) for a, b, r in regions if p <= b and a <= p + 1)
    assert sorted((r["id"], str(r["rid"])) for r in out) == want
    tasks = Counter(r["task"] for r in out)
    assert len(tasks) >= 10 and max(tasks.values()) < len(want) / 3


def test_only_names_within_reach_are_paired(spark, monkeypatch):
    rng = random.Random(3)
    frags = [("c", lo := rng.randrange(9000), lo + rng.randrange(40), rng.randrange(150), rng.randrange(-90, 90)) for _ in range(400)]
    wins = [("c", lo := rng.randrange(-20, 9000), lo + rng.choice([0, 50, 300])) for _ in range(80)] + [("d", 1, 2)]
    named, pairs = [], W.overlap_pairs
    monkeypatch.setattr(W, "overlap_pairs", lambda left, *a: named.append(left.count() if "name" in left.columns else 0) or pairs(left, *a))
    df = W.fragment_length_stats(spark.createDataFrame(wins, "chr string, wlo int, whi int"), spark.createDataFrame(frags, "f string, lo int, hi int, name int, n int"),
                                 Span("chr", "wlo", "whi"), Span("f", "lo", "hi"), "name", "n")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}
    assert set(got) == set(wins) and 0 < sum(named) < 200
    for c, a, b in wins:
        least = {}
        for f, lo, hi, name, n in frags:
            if f == c and lo <= b and hi >= a:
                least[name] = min(least.get(name, 999), abs(n))
        x = list(least.values())
        want = (len(x), np.mean(x), np.std(x, ddof=1) if len(x) > 1 else 0.0, np.median(x)) if x else (0, None, None, None)
        assert got[c, a, b] == (want if not x else pytest.approx(want))


def test_tensor_of_windows_is_not_broadcast(spark):
    plan = queries()["window_tensor"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "SortMergeJoin" in joins[0] and sum("pos" in line and "Broadcast" in line for line in joins) == 0


@pytest.mark.parametrize("length", [0, 30])
def test_window_values_without_pairs(spark, monkeypatch, length):
    rng = random.Random(4)
    track = [("c", lo := rng.randrange(3000), lo + rng.randrange(length + 1), rng.choice([rng.random(), None, 0.5])) for _ in range(900)]
    wins = [("c", lo := rng.randrange(-20, 3000), lo + rng.choice([0, 9, 700])) for _ in range(60)] + [("d", 1, 2)]
    monkeypatch.setattr(W, "overlap_pairs", None)
    df = W.value_stats(spark.createDataFrame(wins, "chr string, wlo int, whi int"), spark.createDataFrame(track, "t string, lo int, hi int, v double"),
                       Span("chr", "wlo", "whi"), Span("t", "lo", "hi"), "v")
    got = {tuple(r)[:3]: tuple(r)[3:] for r in df.collect()}
    assert set(got) == set(wins)
    for c, a, b in wins:
        x = [v for t, lo, hi, v in track if t == c and lo <= b and hi >= a and v is not None]
        want = (len(x), np.mean(x), np.std(x, ddof=1) if len(x) > 1 else 0.0, np.median(x)) if x else (0, None, None, None)
        assert got[c, a, b] == (want if not x else pytest.approx(want))


def test_points_that_share_a_place_are_matched_once(spark):
    points = spark.createDataFrame([("c", 5, k) for k in range(20)], "c string, p int, id int")
    right = spark.createDataFrame([("c", 5, 9, 1), ("c", 6, 9, 2)], "rc string, rlo int, rhi int, rid int")
    got = I.overlap_pairs(points, right, Span("c", "p", "p"), Span("rc", "rlo", "rhi"))
    assert sorted((r["id"], r["rid"]) for r in got.collect()) == [(k, 1) for k in range(20)]


def test_calls_of_whole_batches_equal_those_base_by_base(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("CGCGATNcg") for _ in range(n))
    rows = [(k, text(n := rng.randrange(50)), text(n), [rng.randrange(41) for _ in range(n)], k % 2 == 1) for k in range(5000)]
    df = spark.createDataFrame(rows, "id int, ref string, bases string, quals array<int>, molecule boolean").coalesce(1)
    out = FR.call_counts(df, ["id"], min_base_q=10, start=5)
    got = {r["id"]: tuple(r)[1:] for r in out.collect()}
    assert "MapInArrow" in queries()["cpg_counts"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for k, ref, bases, quals, minus in rows:
        ref, bases, sums, calls = ref.upper(), bases.upper(), [0] * 8, []
        for p, (r, b, q) in enumerate(zip(ref, bases, quals)):
            state = {"GG": 1, "GA": 0}.get(r + b) if minus else {"CC": 1, "CT": 0}.get(r + b)
            near = p - 1 if minus else p + 1
            if state is None or not 0 <= near < len(ref):
                continue
            cpg = ref[near] == ("C" if minus else "G")
            inner = p < len(ref) - 5 if minus else p >= 5
            for j, hit in enumerate((cpg, cpg and q >= 10, cpg and q >= 10 and inner, not cpg and q >= 10)):
                sums[2 * j + 1 - state] += hit
            calls += [f"{p - minus}:{state}"] * (cpg and q >= 10 and inner)
        assert got[k] == (*sums, ",".join(calls))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def random_mates(spark, rows):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("CGCGATNcg") for _ in range(n))
    out = []
    for k in range(rows):
        whole, n1, n2, at = text(60), rng.randrange(1, 30), rng.randrange(1, 30), rng.randrange(30)
        ref1, ref2 = whole[:n1], whole[at:at + n2]
        change = lambda s: "".join(rng.choice("TA") if rng.random() < 0.2 else c for c in s)
        out.append((k, ref1, change(ref1), [rng.randrange(9) for _ in ref1], at, ref2, change(ref2), [rng.randrange(9) for _ in ref2], k % 3 > 0))
    return spark.createDataFrame(out, "id int, ref1 string, bases1 string, quals1 array<int>, start2 int, ref2 string, bases2 string, quals2 array<int>, first_is_left boolean")


def test_mates_merge_in_whole_batches(spark):
    df = random_mates(spark, 5000).coalesce(1)
    m = R.merged_fragment(F.lit(0), F.col("ref1"), F.col("bases1"), F.col("quals1"), F.col("start2"), F.col("ref2"), F.col("bases2"), F.col("quals2"), F.col("first_is_left"))
    want = {r["id"]: (r["m"]["ref"], r["m"]["bases"], r["m"]["quals"]) for r in df.select("id", m.alias("m")).collect()}
    got = {r["id"]: (r["ref"], r["bases"], r["quals"]) for r in FR.merge_mates(df, ["id"]).collect()}
    assert got == want
    part = df.limit(3).withColumn("quals2", F.when(F.col("id") != 1, F.col("quals2")))
    assert [(r["id"], r["ref"] is None, r["quals"] is None) for r in FR.merge_mates(part, ["id"]).collect()] == [(0, False, False), (1, True, True), (2, False, False)]
    assert "MapInArrow" in plan_of(queries()["merged_fragments"](spark, SF))


def test_merged_fragments_are_measured_where_they_stand(spark):
    df = random_mates(spark, 3000)
    got = {r["id"]: r for r in FR.merged_metrics(df, ["id"], 2, min_base_q=4).collect()}
    assert len(got) == 3000
    for r in FR.merge_mates(df, ["id"]).collect():
        ref, bases, x = r["ref"].upper(), r["bases"].upper(), got[r["id"]]
        calls = [b for p, (b, q) in enumerate(zip(bases, r["quals"])) if ref[p:p + 2] == "CG" and q >= 4]
        assert (x["m"], x["u"]) == (calls.count("C"), calls.count("T"))
        assert x["gc_perc"] == 100.0 * sum(c in "GC" for c in ref) / len(ref)
        pairs = [ref[p:p + 2] for p in range(len(ref) - 1)]
        assert all(x[m] == (100.0 * pairs.count(m) / len(pairs) if pairs else 0.0) for m in ("AA", "CG", "GC", "TT"))
    assert "Aggregate" not in plan_of(queries()["fragment_metrics"](spark, SF))


def test_qualities_repeat(spark):
    from fragweave.plans import bindings as B

    rows = [(k, "A" * n) for k in (-50, -3, 0, 5, 40, 41, 10 ** 12) for n in (1, 41, 100)]
    for step, plus in ((7, 0), (11, 3)):
        t = spark.createDataFrame(rows, "k long, s string").select("k", "s", B.qualities("s", step, plus).alias("q"))
        for r in t.collect():
            x = [j * step + r["k"] + plus for j in range(len(r["s"]))]
            assert r["q"] == [v % 41 if v >= 0 else -(-v % 41) for v in x]


def test_sites_come_from_whole_batches(spark):
    rng = random.Random(9)
    rows = [(k, "".join(rng.choice("CGcgAN") for _ in range(rng.randrange(30)))) for k in range(2500)] + [(9999, None)]
    df = spark.createDataFrame(rows, "id int, s string").coalesce(1)
    found = sorted(map(tuple, FR.pattern_sites(df, ["id"], "s", "CG").collect()))
    both = sorted(map(tuple, FR.cytosine_sites(df, ["id"], "s", edge=2).collect()))
    want, ends = [], []
    for k, s in rows:
        s = (s or "").upper()
        at = [p for p in range(len(s)) if s[p:p + 2] == "CG"]
        want += [(k, p, j) for j, p in enumerate(at)]
        ends += [(k, p + 1, "+" if c == "C" else "-") for p, c in enumerate(s) if c in "CG" and (p in at or p - 1 in at or p < 2 or p >= len(s) - 2)]
    assert found == want and both == ends


def test_look_ups_in_overlapping_chunks(spark):
    rng = random.Random(10)
    seqs = {f"c{k}": "".join(rng.choice("ACGT") for _ in range(n)) for k, n in enumerate((0, 3, 16, 17, 47, 400))}
    df = spark.createDataFrame(list(seqs.items()), "id string, seq string")
    rows = spark.createDataFrame([(c, p) for c, s in seqs.items() for p in range(-3, len(s) + 3)], "c string, p int")
    for overlap in (0, 4, 9):
        got = {(r["c"], r["p"]): r["x"] for r in TX.genome_lookup(rows, FR.cut_sequences(df, "id", "seq", 16, overlap), "c", F.col("p") - 2, 5, "x", chunk=16,
                                                                 overlap=overlap, distinct=True).collect()}
        assert got == {(c, p): s[max(p - 2, 0):max(p + 3, 0)] for c, s in seqs.items() for p in range(-3, len(s) + 3)}


@pytest.mark.parametrize("name", ["strand_context", "fragment_kmers", "flank_sequence"])
def test_look_ups_join_once_and_count_nothing_first(spark, monkeypatch, name):
    monkeypatch.setattr(skew, "hot_keys", None)
    plan = plan_of(queries()[name](spark, SF))
    assert sum("Join" in line for line in plan.splitlines()) == 1 and "Window" not in plan and "filter(transform" not in plan


def test_reads_are_called_in_whole_batches(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("CGCGATNcg") for _ in range(n))
    rows = [(k, text(n := rng.randrange(1, 40)), text(n), [rng.randrange(9) for _ in range(n)], k % 2 == 1) for k in range(4500)]
    df = spark.createDataFrame(rows, "id int, ref string, bases string, quals array<int>, molecule boolean").coalesce(1)
    parts = [F.col(c) for c in ("ref", "bases", "quals", "molecule")]
    states = R.base_states(*parts, min_base_q=4)
    digits = F.rpad(F.array_join(F.transform(states, lambda s: F.when(s == 1, "2").when(s == 0, "3").otherwise("1")), ""), 25, "0")
    for width, anchor, extend in ((24, 9, 12), (13, 0, 5)):
        want = df.select("id", S.base_digits("ref", 25), S.base_digits("bases", 25), digits, R.cpg_location_vector(F.col("ref"), F.col("molecule"), width),
                         R.state_vector(*parts, F.lit(anchor), extend, 4))
        got = FR.fragment_digits(df, ["id"], 25, min_base_q=4).join(FR.cpg_vectors(df, ["id"], width, anchor, extend, min_base_q=4), "id")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    part = df.limit(3).withColumn("bases", F.when(F.col("id") != 1, F.col("bases")))
    assert [r["methy_digits"] is None for r in FR.fragment_digits(part, ["id"], 9).collect()] == [False, True, False]


@pytest.mark.parametrize("name", ["cpg_locations", "fragment_digits"])
def test_no_structure_a_base(spark, name):
    plan = plan_of(queries()[name](spark, SF))
    assert "MapInArrow" in plan and "arrays_zip" not in plan


def test_kmers_are_counted_in_bounded_slices_and_not_shuffled(spark, monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choice("ACGTacgtN") for _ in range(rng.choice([0, 3, 40, 900]))) for _ in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], names=["id", "s"])
    parts = [p.column(1).to_pylist() for p in K.slices(batch, 1, rows=7, size=1000)]
    assert sum(parts, []) == texts and all(len(p) <= 7 and (len(p) == 1 or sum(map(len, p)) <= 1000) for p in parts)
    wide = [list(K.kmer_counts(K.flat(pa.array(texts)), None, 1, 4))]
    monkeypatch.setattr(K, "TABLE", 0)
    wide.append(list(K.kmer_counts(K.flat(pa.array(texts)), None, 1, 4)))
    for a, b in zip(*wide):
        assert all(np.array_equal(x, y) if not isinstance(x, pa.Array) else x.equals(y) for x, y in zip(a, b))
        for row, kmer, n, windows in zip(a.row, a.kmer.to_pylist(), a.n, a.windows):
            s, k = texts[row].upper(), len(kmer)
            assert (sum(s[p:p + k] == kmer for p in range(len(s))), max(len(s) - k + 1, 0)) == (n, windows)
    for name in ("kmer_freq", "kmer_freq_sparse"):
        assert "Aggregate" not in plan_of(queries()[name](spark, SF))
