"""Model recursions against a plain loop, training invariants, tissue program."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fragweave.operators import hmm as H
from fragweave.operators import matrix as M
from fragweave.operators import tissue as TI
from fragweave.plans import queries_model as Q
from tests.conftest import SF

FEATS = ["z_len", "z_cov", "z_dist"]
ONE = ((1.0,),) * 3


def model(bins=6, seed=1, comps=1):
    rng = np.random.default_rng(seed)
    pi = rng.random((bins, 2)) + 0.1
    a = rng.random((bins, 2, 2)) + 0.1
    def em(s):
        return H.Emission(tuple(tuple(s + rng.normal() for _ in range(comps)) for _ in range(3)),
                          tuple(tuple(0.5 + rng.random() for _ in range(comps)) for _ in range(3)),
                          tuple(tuple(1.0 / comps for _ in range(comps)) for _ in range(3)))
    return H.Model(pi / pi.sum(1, keepdims=True), a / a.sum(2, keepdims=True), (em(-0.5), em(0.5)))


def sequences(n=40, seed=2, lens=(1, 2, 3, 9, 10, 25)):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        k = lens[i % len(lens)]
        out.append(dict(read_name=i, n=k, dist=rng.integers(0, 6, k).tolist(), offset=list(range(k)), prior=rng.random(k).tolist(),
                        z_len=rng.normal(size=k).tolist(), z_cov=rng.normal(size=k).tolist(), z_dist=rng.normal(size=k).tolist(),
                        obs=rng.integers(0, 2, k).tolist()))
    return out


SCHEMA = ("read_name long, n int, dist array<int>, offset array<int>, prior array<double>, z_len array<double>, z_cov array<double>, "
          "z_dist array<double>, obs array<int>")


def frame(spark, seqs):
    return spark.createDataFrame([tuple(s[c] for c in ("read_name", "n", "dist", "offset", "prior", *FEATS, "obs")) for s in seqs], SCHEMA)


def batch(seqs):
    cols = {c: pa.array([s[c] for s in seqs], pa.list_(pa.int32() if c == "dist" else pa.float64())) for c in ("dist", "prior", *FEATS)}
    return H.Batch(pa.RecordBatch.from_pydict(cols), FEATS)


def scores(m, s, t):
    x = [s[f][t] for f in FEATS]
    out = []
    for e in m.emit:
        prod = 1.0
        for f in range(3):
            prod *= sum(w * math.exp(-0.5 * (x[f] - mu) ** 2 / v) / math.sqrt(2 * math.pi * v) for mu, v, w in zip(e.mean[f], e.var[f], e.prop[f]))
        out.append(math.exp(prod))
    return out


def plain_posteriors(m, s):
    """Enumerate forward and backward products without scaling."""
    k = s["n"]
    b = [scores(m, s, t) for t in range(k)]
    al = [[m.pi[s["dist"][0]][i] * b[0][i] for i in (0, 1)]]
    for t in range(1, k):
        al.append([sum(al[-1][i] * m.a[s["dist"][t]][i][j] for i in (0, 1)) * b[t][j] for j in (0, 1)])
    be = [[1.0, 1.0]]
    for t in range(k - 2, -1, -1):
        be.insert(0, [sum(m.a[s["dist"][t + 1]][i][j] * b[t + 1][j] * be[0][j] for j in (0, 1)) for i in (0, 1)])
    p = sum(al[-1])
    xi = [[[al[t][i] * m.a[s["dist"][t + 1]][i][j] * b[t + 1][j] * be[t + 1][j] / p for j in (0, 1)] for i in (0, 1)] for t in range(k - 1)]
    return p, xi


@pytest.mark.parametrize("comps", [1, 2])
def test_expectation_matches_plain_products(comps):
    m, seqs = model(comps=comps), sequences()
    b = batch(seqs)
    sc = np.stack([m.emit[i].score(b.x) for i in (0, 1)], 1)
    alpha, scale = H.forward(b, m, sc)
    beta = H.backward(b, m, sc, scale)
    xi, gamma, at = H.expected_states(b, m, sc, alpha, beta)
    lnp = H.log_likelihood(b, scale)
    start = np.cumsum([0] + [s["n"] for s in seqs])
    for rank, i in enumerate(b.order):
        p, want = plain_posteriors(m, seqs[i])
        assert lnp[rank] == pytest.approx(math.log(p))
        for t, x in enumerate(want):
            np.testing.assert_allclose(xi[start[i] + t + 1], x, rtol=1e-9)
        if seqs[i]["n"] > 1:
            np.testing.assert_allclose(gamma[start[i]:start[i + 1]].sum(1), 1.0)


def plain_decode(m, s, th):
    """The decision rule, one point at a time."""
    me, u, f = m.methylated, 1 - m.methylated, m.bayes_factor
    k = s["n"]
    b = [scores(m, s, t) for t in range(k)]
    d = [-math.log(m.pi[s["dist"][0]][i]) - math.log(b[0][i]) for i in (0, 1)]
    back = []
    def wins(du, dm):
        eu, em = math.exp(-du), math.exp(-dm)
        return em / (em + eu) > eu / (em + eu) + th
    for t in range(1, k):
        pm, pu = b[t - 1][me] * (0.5 - f / 2 + s["prior"][t - 1] * f), b[t - 1][u] * (0.5 + f / 2 - s["prior"][t - 1] * f)
        post = {me: pm / (pm + pu), u: pu / (pm + pu)}
        a = m.a[s["dist"][t]]
        row, new = [], []
        for j in (0, 1):
            val = {i: d[i] + math.log(b[t - 1][i]) - math.log(post[i]) - math.log(a[i][j]) for i in (0, 1)}
            src = me if wins(val[u], val[me]) else u
            row.append(src)
            new.append(d[src] - math.log(a[src][j]) - math.log(b[t][j]))
        back.append(row)
        d = new
    last = me if wins(d[u], d[me]) else u
    path = [last]
    for row in reversed(back):
        path.insert(0, row[path[0]])
    return path, -d[last]


@pytest.mark.parametrize("th,me", [(0.0, 1), (0.2, 0), (-1.0, 1), (1.0, 1)])
def test_decode_matches_plain_rule(spark, th, me):
    from dataclasses import replace

    m, seqs = replace(model(), methylated=me), sequences(24, 5)
    got = {r["read_name"]: r for r in H.decode(frame(spark, seqs).repartition(3), m, FEATS, th).collect()}
    for s in seqs:
        path, lnp = plain_decode(m, s, th)
        assert got[s["read_name"]]["states"] == path
        assert got[s["read_name"]]["ln_prob"] == pytest.approx(lnp)


def test_training_step_on_spark_equals_loop(spark):
    m, seqs = model(), [s for s in sequences(60, 8) if s["n"] > 1]
    st = H.e_step(frame(spark, seqs).repartition(4), m, FEATS)
    num, pi = np.zeros((6, 2, 2)), np.zeros((6, 2))
    for s in seqs:
        _, xi = plain_posteriors(m, s)
        for t, x in enumerate(xi):
            num[s["dist"][t + 1]] += x
        pi[s["dist"][0]] += np.sum(xi[0], axis=1)
    np.testing.assert_allclose(st["num"], num, rtol=1e-8)
    np.testing.assert_allclose(st["pi"], pi, rtol=1e-8)
    new = H.m_step(m, st)
    np.testing.assert_allclose(new.a.sum(2), 1.0)
    np.testing.assert_allclose(new.pi.sum(1), 1.0)
    np.testing.assert_allclose(new.a, num / num.sum(2, keepdims=True), rtol=1e-8)
    # The outer distance bins add to the old values, the others start anew.
    inner = pi[1] / pi[1].sum()
    np.testing.assert_allclose(new.pi[1], inner)
    outer = m.pi[0] + pi[0] / len(seqs)
    np.testing.assert_allclose(new.pi[0], outer / outer.sum())


def test_refit_single_component_is_weighted_mean_and_biased_variance(spark):
    m, seqs = model(), [s for s in sequences(30, 9) if s["n"] > 1]
    new = H.m_step(m, H.e_step(frame(spark, seqs), m, FEATS))
    w, x = [[], []], []
    for s in seqs:
        _, xi = plain_posteriors(m, s)
        g = [np.sum(v, axis=1) for v in xi] + [np.sum(xi[-1], axis=0)]
        x += s["z_cov"]
        for i in (0, 1):
            w[i] += [v[i] for v in g]
    for i in (0, 1):
        mean = np.average(x, weights=w[i])
        assert new.emit[i].mean[1][0] == pytest.approx(mean)
        assert new.emit[i].var[1][0] == pytest.approx(np.average((np.array(x) - mean) ** 2, weights=w[i]))


def test_training_is_repeatable_and_fails_without_long_fragments(spark):
    seqs = [s for s in sequences(60, 8) if s["n"] > 1]
    df = frame(spark, seqs)
    a, b = (H.train(df, model(), FEATS, max_iter=4, kl_min_len=9) for _ in (0, 1))
    np.testing.assert_allclose(a.model.a, b.model.a, rtol=1e-9)
    assert len(a.distances) >= 1
    with pytest.raises(ValueError, match="undefined"):
        H.train(frame(spark, [s for s in seqs if s["n"] < 5]), model(), FEATS, max_iter=3)
    with pytest.raises(ValueError, match="no fragment"):
        H.train(df.where("n > 1000"), model(), FEATS)


@pytest.mark.parametrize("query", [Q.em_train, Q.train_and_predict])
def test_training_queries_end_by_the_stop_rule_only(spark, monkeypatch, query):
    train, got = H.train, []

    def unsettled(*args, **kw):
        got.append(train(*args, **kw, tol=0.0, decay=0.0))
        return got[-1]

    monkeypatch.setattr(H, "train", unsettled)
    assert query(spark, SF).count() > 0
    assert len(got[0].distances) == 50


def test_model_round_trip(spark, tmp_path):
    m = model(comps=2)
    m.save(spark, str(tmp_path / "m"))
    back = H.Model.load(spark, str(tmp_path / "m"))
    np.testing.assert_array_equal(back.a, m.a)
    assert back.emit == m.emit and back.methylated == m.methylated


def test_starts_give_proper_models(spark):
    df = frame(spark, [s for s in sequences(80, 4) if s["n"] > 1])
    for init in (H.init_gmm, H.init_observed, H.init_random):
        m = init(df, FEATS, bins=6)
        np.testing.assert_allclose(m.a.sum(2), 1.0)
        np.testing.assert_allclose(m.pi.sum(1), 1.0)
        assert all(v[0] > 0 for e in m.emit for v in e.var)
    mixed = H.init_gmm(df, FEATS, bins=6, comps=[1, 2, 2])
    assert [len(v) for v in mixed.emit[0].mean] == [1, 2, 2]


def test_halves_split_at_exact_rank_with_ties(spark):
    pts = spark.range(101).selectExpr("id as read_name", "cast(id % 2 as int) as offset", "case when id < 80 then 1.0D else 2.0D end as z_len",
                                      "0.0D as z_cov", "0.0D as z_dist")
    t = H.split_by_row_mean(pts, FEATS)
    assert t.where("half = 0").count() == 50
    assert t.where("half = 1 and z_len = 2").count() == 21


MATRIX = ("chr string, start_ int, end_ int, read_name string, frag_len int, strand string, methy_stat string, norm_cov double, base_q int, "
          "offset_ int, dist_end int, prior double")


def row(read="r", off=0, ln=100, q=30, prior=50.0, stat="m", pos=1):
    return ("c", pos, pos + 1, read, ln, "+", stat, 1.0, q, off, 5, prior)


def test_row_filter_bounds_are_strict(spark):
    rows = [row(ln=n, read=str(n)) for n in (30, 31, 499, 500)] + [row(q=5, read="q5"), row(q=6, read="q6"), row(prior=float("nan"), read="nan"), row(off=-1, read="neg")]
    kept = {r["read_name"] for r in M.valid_rows(spark.createDataFrame(rows, MATRIX)).collect()}
    assert kept == {"31", "499", "q6"}


def test_prior_leaves_the_ends(spark):
    t = spark.createDataFrame([(0.0,), (100.0,), (50.0,), (99.995,)], "p double").select(M.clipped_prior(F.col("p")).alias("v"))
    assert [pytest.approx(r["v"]) for r in t.collect()] == [0.0001, 0.9999, 0.5, 0.99995]


def test_fragments_reject_long_gaps_and_keep_order(spark):
    rows = [row("a", 10), row("a", 510, pos=2), row("b", 10), row("b", 511, pos=2), row("c", 501), row("d", 3, stat="u"), row("d", 1, pos=9), row("e", 10 ** 9)]
    pts = spark.createDataFrame(rows, MATRIX).selectExpr("*", "0.5D as p", "0.0D as z_len")
    got = {r["read_name"]: r for r in M.fragments(pts, ["z_len"]).collect()}
    assert set(got) == {"a", "d"}
    assert got["a"]["dist"] == [10, 500] and got["d"]["offset"] == [1, 3] and got["d"]["obs"] == [1, 0]
    binned = {r["read_name"]: r["dist"] for r in M.fragments(pts, ["z_len"], bin_bp=100).collect()}
    assert binned["a"] == [0, 5]


def test_first_of_equal_offsets_wins_with_one_hot_read(spark):
    n = 5000
    hot = spark.range(n).selectExpr("'c' as chr", "cast(id as int) as start_", "cast(id + 1 as int) as end_", "'hot' as read_name", "100 as frag_len", "'+' as strand",
                                    "'m' as methy_stat", "1.0D as norm_cov", "30 as base_q", "cast(id % 3 as int) as offset_", "5 as dist_end", "50.0D as prior")
    got = sorted((r["offset_"], r["start_"]) for r in M.first_per_offset(hot).collect())
    assert got == [(0, 0), (1, 1), (2, 2)]


def test_simplex_program_against_grid():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x = rng.random((30, 3))
        y = x @ np.array([0.7, 0.3, 0.0]) + rng.normal(scale=0.3, size=30)
        g, d = x.T @ x, x.T @ y
        b = TI.simplex_least_squares(g, d)
        assert b.min() >= 0 and b.sum() == pytest.approx(1)
        f = lambda v: 0.5 * v @ g @ v - d @ v
        grid = min(f(np.array([i, j, 100 - i - j]) / 100) for i in range(101) for j in range(101 - i))
        assert f(b) <= grid + 1e-9
    g = np.ones((4, 4))
    assert TI.simplex_least_squares(g, np.ones(4)).sum() == pytest.approx(1)


def test_tissue_query_fits_most_variable_complete_windows(spark, monkeypatch):
    raw = Q._vectors(spark, SF).withColumn("coverage", F.when((F.col("vec_id") % 2 == 0) & (F.col("sample") == 20), -1.0).otherwise(F.col("coverage")))
    monkeypatch.setattr(Q, "_vectors", lambda *_: raw)
    fit, used = TI.tissue_fractions, []

    def seen(ref, cf, *args):
        used.append({r["vec_id"] for r in ref.join(cf, "vec_id").collect()})
        return fit(ref, cf, *args)

    monkeypatch.setattr(TI, "tissue_fractions", seen)
    assert Q.tissue_fractions(spark, SF).count() == 540
    levels: dict = {}
    for r in raw.where("sample < 10").collect():
        levels.setdefault(r["vec_id"], []).append(r["methylated"] / (r["coverage"] + 0.02))
    sd = {v: np.std(x, ddof=1) for v, x in levels.items()}
    cut = np.quantile(list(sd.values()), 0.99)
    assert used[0] == {v for v, s in sd.items() if s > cut and v % 2} != set()


def test_tissue_fractions_recover_a_mixture(spark):
    rng = np.random.default_rng(3)
    x = rng.random((200, 4))
    y = np.stack([x @ [0.6, 0.4, 0, 0], x[:, 3]], 1)
    ref = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "w int, x array<double>")
    cf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "w int, y array<double>")
    got = {(r["sample"], r["tissue"]): r["fraction"] for r in TI.tissue_fractions(ref, cf, ["w"], ["a", "b", "c", "d"], ["s", "t"]).collect()}
    assert got[("s", "a")] == pytest.approx(0.6, abs=1e-6) and got[("s", "c")] == 0.0 and got[("t", "d")] == pytest.approx(1)
