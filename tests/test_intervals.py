"""Interval, nearest and track operators against brute force, with forced skew handling."""

import random

import pytest

from fragweave.operators import intervals as I
from fragweave.operators import nearest as N
from fragweave.operators import skew
from fragweave.operators import tracks as T
from fragweave.operators.intervals import Span

L, R = Span("chr", "lo", "hi"), Span("r_chr", "r_lo", "r_hi")


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    left = [("chr1" if rng.random() < 0.8 else "chr2", a := rng.choice([500, 500, 500, rng.randrange(5000)]), a + 1, i) for i in range(600)]
    right = []
    for i in range(120):
        a = rng.randrange(5000)
        right.append((rng.choice(["chr1", "chr3"]), a, a + rng.choice([0, 3, 50, 4000]), i))
    return left, right


def frames(spark, data):
    return (spark.createDataFrame(data[0], "chr string, lo int, hi int, id int"),
            spark.createDataFrame(data[1], "r_chr string, r_lo int, r_hi int, rid int"))


def overlaps(a, b):
    return a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2]


@pytest.mark.parametrize("how", ["broadcast", "shuffle", "salted"])
def test_overlap_pairs(spark, data, how):
    lf, rf = frames(spark, data)
    kw = {"broadcast": {}, "shuffle": {"broadcast_rows": 0}, "salted": {"broadcast_rows": 0, "hot_rows": 20}}[how]
    got = sorted((r["id"], r["rid"]) for r in I.overlap_pairs(lf, rf, L, R, bin_size=8, **kw).collect())
    assert got == sorted((a[3], b[3]) for a in data[0] for b in data[1] if overlaps(a, b))


@pytest.mark.parametrize("kw", [{"row_length": 1}, {"row_length": 1, "broadcast_rows": 0}, {}, {"hot_rows": 20}])
def test_semi_and_anti(spark, data, kw):
    lf, rf = frames(spark, data)
    hit = {a[3] for a in data[0] if any(overlaps(a, b) for b in data[1])}
    assert {r["id"] for r in I.overlap_semi(lf, rf, L, R, bin_size=64, **kw).collect()} == hit
    anti = [r["id"] for r in I.overlap_anti(lf, rf, L, R, bin_size=64, **kw).collect()]
    assert sorted(anti) == sorted({a[3] for a in data[0]} - hit)


def test_touching_ends_count_and_neighbours_do_not(spark):
    lf = spark.createDataFrame([("c", 10, 11, 1), ("c", 13, 14, 2), ("d", 10, 11, 3)], "chr string, lo int, hi int, id int")
    rf = spark.createDataFrame([("c", 11, 12, 1)], "r_chr string, r_lo int, r_hi int, rid int")
    assert [r["id"] for r in I.overlap_semi(lf, rf, L, R, row_length=1).collect()] == [1]
    assert sorted(r["id"] for r in I.overlap_anti(lf, rf, L, R, row_length=1).collect()) == [2, 3]


def test_declared_row_length_is_checked(spark):
    lf = spark.createDataFrame([("c", 10, 50, 1)], "chr string, lo int, hi int, id int")
    rf = spark.createDataFrame([("c", 11, 12, 1)], "r_chr string, r_lo int, r_hi int, rid int")
    with pytest.raises(Exception, match="row_length"):
        I.overlap_semi(lf, rf, L, R, row_length=1).collect()


def test_attach_spreads_hot_keys_without_losing_rows(spark):
    rows = spark.range(3000).selectExpr("case when id % 3 = 0 then 0 else id end as k", "id")
    dim = spark.range(0, 3000, 2).selectExpr("id as k", "id * 10 as v")
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = sorted(map(tuple, rows.join(dim, "k", how).collect()), key=str)
        hot = skew.attach(rows, dim, ["k"], how, hot_rows=100)
        assert sorted(map(tuple, hot.collect()), key=str) == plain
    found = skew.hot_keys(rows, ["k"], 100).collect()
    assert len(found) == 1 and found[0]["k"] == 0


def test_spread_uses_several_salts(spark):
    rows = spark.range(0, 20000, 1, 8).selectExpr("0L as k", "id")
    dim = spark.createDataFrame([(0, 1)], "k long, v long")
    left, right = skew.spread(rows, dim, ["k"], skew.hot_keys(rows, ["k"], 2500))
    per_salt = [r["count"] for r in left.groupBy(skew.SALT).count().collect()]
    assert len(per_salt) == right.count() == 9 and max(per_salt) < 4000


def test_nearest_feature_across_bins(spark):
    rng = random.Random(3)
    sites = [("c", p := rng.randrange(3000), p + 1) for _ in range(200)] + [("x", 5, 6)]
    feats = sorted({("c", p := rng.randrange(3000), p + rng.choice([1, 20]), rng.choice("+-.")) for _ in range(15)})
    first = {}
    for f in feats:
        first.setdefault(f[:3], f[3])
    sf = spark.createDataFrame(sites, "chr string, lo int, hi int")
    ff = spark.createDataFrame(feats, "r_chr string, r_lo int, r_hi int, s string")
    got = {(r["chr"], r["lo"]): r["d"] for r in N.nearest_feature(sf, ff, L, R, "s", "d", bin_size=100).collect()}

    def dist(f, s):
        if f[1] <= s[1] <= f[2] or f[1] <= s[2] <= f[2]:
            return 0
        g = min([s[1] - f[1], s[1] - f[2], s[2] - f[1], s[2] - f[2]], key=abs)
        return -g if first[f] == "-" else g if first[f] == "+" else abs(g)

    for s in sites:
        up = [f for f in first if f[0] == s[0] and (f[1], f[2]) <= (s[1], s[2])]
        down = [f for f in first if f[0] == s[0] and (f[1], f[2]) >= (s[1], s[2])]
        u = dist(max(up, key=lambda f: f[1:]), s) if up else None
        d = dist(min(down, key=lambda f: f[1:]), s) if down else None
        want = N.NO_FEATURE if u is None and d is None else u if d is None else d if u is None or abs(u) >= abs(d) else u
        assert got[(s[0], s[1])] == want


@pytest.mark.parametrize("ext,size", [(0, 16), (7, 16), (100, 64)])
def test_track_windows(spark, ext, size):
    rng = random.Random(ext)
    sites = sorted({("c", p := rng.randrange(1, 900), p + 1) for _ in range(80)})
    recs = [("c", a := rng.randrange(1, 900), a + rng.choice([0, 0, 30, 200]), float(rng.randrange(1, 9))) for _ in range(60)] + [("c", 5, 5, None)]
    sf = spark.createDataFrame(sites, "chr string, lo int, hi int")
    tf = spark.createDataFrame(recs, "r_chr string, r_lo int, r_hi int, v double")
    got = {r["lo"]: (r["n"], r["total"]) for r in T.window_record_stats(sf, tf, L, R, "v", ext, bin_size=size).collect()}
    base = {r["lo"]: (r["n"], r["total"]) for r in T.window_base_stats(sf, tf, L, R, "v", ext, bin_size=size).collect()}
    for _, lo, hi in sites:
        a, b = max(1, lo - ext), hi + ext
        hit = [r for r in recs if r[3] is not None and r[1] <= b and r[2] >= a]
        assert got[lo] == (len(hit), pytest.approx(sum(r[3] for r in hit)))
        wide = [(min(r[2], b) - max(r[1], a) + 1, r[3]) for r in hit]
        assert base[lo] == (sum(w for w, _ in wide), pytest.approx(sum(w * v for w, v in wide)))
