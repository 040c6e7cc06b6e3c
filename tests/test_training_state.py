"""Restart of a training that runs away, resuming one that was cut off, one-pass reports and tensors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fragweave.operators import fragments as FR
from fragweave.operators import hmm as H
from fragweave.operators import windows as W
from fragweave.sources import sinks as K

BINS = 6


@pytest.fixture(scope="module")
def seqs(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(120):
        n, state = rng.randint(10, 16), rng.random() < 0.5
        d, p, x, y, z = [], [], [], [], []
        for _ in range(n):
            state ^= rng.random() < 0.2
            d.append(rng.randrange(BINS))
            p.append(rng.random() * 0.8 + 0.1)
            for f in (x, y, z):
                f.append(rng.gauss(1.0 if state else -1.0, 0.8))
        rows.append((d, p, x, y, z))
    return spark.createDataFrame(rows, "dist array<int>, prior array<double>, z_len array<double>, z_cov array<double>, z_dist array<double>").cache()


def start(seed):
    pi, a = H._random_rows(np.random.default_rng(seed), BINS)
    one = ((1.0,),) * 3
    return H.Model(pi, a, tuple(H.Emission(((m,),) * 3, ((1.0,),) * 3, one) for m in (-0.5 - seed / 50, 0.5)))


def broken():
    m = start(0)
    return H.replace(m, emit=(H.Emission(((math.nan,),) * 3, ((1.0,),) * 3, ((1.0,),) * 3), m.emit[1]))


def same(a, b):
    assert all(x[:4] == y[:4] and x[4] == pytest.approx(y[4]) for x, y in zip(sorted(a.to_rows()), sorted(b.to_rows()), strict=True))


def test_a_training_that_runs_away_goes_on_from_the_next_start(seqs):
    with pytest.raises(H.NotFinite):
        H.train(seqs, broken(), max_iter=4)
    asked = []

    def next_start(k):
        asked.append(k)
        return broken() if k == 1 else start(k)

    got = H.train(seqs, broken(), max_iter=8, restart=next_start)
    assert asked == [1, 2] and got.restarts == 2
    plain = H.train(seqs, start(2), max_iter=6)  # two of eight steps were spent
    same(got.model, plain.model)
    assert got.distances == pytest.approx(plain.distances)


def test_a_training_that_never_works_ends(seqs):
    got = H.train(seqs, broken(), max_iter=3, restart=lambda k: broken())
    assert got.restarts == 3 and not got.distances


def test_a_training_goes_on_from_its_last_step(spark, seqs, tmp_path, monkeypatch):
    whole = H.train(seqs, start(1), max_iter=5, tol=0, decay=0)
    path, real, calls = str(tmp_path / "state"), H.e_step, []

    def fails(*a, **k):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("the driver is gone")
        return real(*a, **k)

    monkeypatch.setattr(H, "e_step", fails)
    with pytest.raises(RuntimeError):
        H.train(seqs, start(1), max_iter=5, tol=0, decay=0, state_path=path)
    monkeypatch.setattr(H, "e_step", lambda *a, **k: calls.append(1) or real(*a, **k))
    (tmp_path / "state" / "step=9" / "_temporary").mkdir(parents=True)  # a step whose writing was cut off
    calls.clear()
    got = H.train(seqs, start(30), max_iter=5, tol=0, decay=0, state_path=path)
    assert len(calls) == 3  # three of six passes were done before
    same(got.model, whole.model)
    assert got.distances == pytest.approx(whole.distances) and got.log_likelihood == pytest.approx(whole.log_likelihood)


def test_reports_compute_their_source_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    rows = [(f"r{i}", 100 + i % 7, i % 5, i % 3, 0, 1) for i in range(500)]
    kinds = "name string, frag_len int, m_cg long, u_cg long, m_ch long, u_ch long"
    source = spark.createDataFrame(rows, kinds).repartition(3)
    K.write_fragment_reports(source.mapInPandas(count, kinds), str(tmp_path / "out"))
    assert seen.value == 500
    read = lambda name: spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(f"{tmp_path}/out/{name}")
    assert sorted(map(tuple, read("detail").collect())) == sorted(rows)
    for name, want in (("by_length", FR.methylation_by_length(source)), ("by_methylation", FR.length_by_methylation(source))):
        got = [[float(x) for x in r] for r in read(name).collect()]
        assert got == [pytest.approx([float(x) for x in r]) for r in want.orderBy(want.columns[0]).collect()]
        assert [r[0] for r in got] == sorted(r[0] for r in got)


def test_windows_are_numbered_alike_whatever_the_stretches(spark):
    rng = random.Random(4)
    rows = {(rng.choice(["chr1", "chr10", "chr2"]), a := rng.randrange(5000), a + rng.randint(1, 90)) for _ in range(300)}
    want, row = [], 0
    for k, (c, a, b) in enumerate(sorted(rows)):
        want.append((k, c, a, b, row))
        row += b - a
    df = spark.createDataFrame([*rows, *list(rows)[:20]], "chr string, start_ int, end_ int")
    for stretch in (64, 1000, 1 << 20):
        assert sorted(map(tuple, W.number_windows(df, stretch=stretch).collect())) == want


def test_tensors_keep_overlapping_windows_apart(spark, tmp_path):
    wins = spark.createDataFrame([("c", 2, 6), ("c", 4, 7), ("c", 2, 6)], "chr string, start_ int, end_ int")
    bases = spark.createDataFrame([("c", p, "ACGTN"[p % 5]) for p in range(1, 9)], "chr string, pos int, base string")
    frags = spark.createDataFrame([("c", 3, 5, "+"), ("c", 4, 9, "-")], "chr string, f_start int, f_end int, f_strand string")
    cpg = spark.createDataFrame([("c", 5, 0.5)], "chr string, pos int, methy double")
    numbered = W.number_windows(wins)
    K.write_tensors(numbered, W.window_tensor(numbered, bases, frags, cpg, max_cov=2), str(tmp_path / "t"))
    win = {r.window: r for r in spark.read.parquet(f"{tmp_path}/t/windows").collect()}
    pos = sorted(spark.read.parquet(f"{tmp_path}/t/positions").collect(), key=lambda r: r.row)
    assert {w: (r.start_, r.end_, r.first_row) for w, r in win.items()} == {0: (2, 6, 0), 1: (4, 7, 4)}
    assert [(r.row, r.window, r.pos) for r in pos] == [(0, 0, 3), (1, 0, 4), (2, 0, 5), (3, 0, 6), (4, 1, 5), (5, 1, 6), (6, 1, 7)]
    assert [(r.methy, r.n_plus, r.n_minus) for r in pos[2:5]] == [(0.5, 1, 1), (0.0, 0, 1), (0.5, 1, 1)]
    assert all(r.row - win[r.window].first_row == r.pos - win[r.window].start_ - 1 for r in pos)
    assert spark.read.parquet(f"{tmp_path}/t/positions").where(F.size("vectors") != 2).isEmpty()
