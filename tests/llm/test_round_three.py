"""Periodic runs, token alignment and nearest neighbours against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from fragweave.llm import neighbours, periodic_runs, queries, textkernel, token_alignment
from tests.llm.helpers import corpus, docs_of

ROOT = __file__.rsplit("/", 3)[0]


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# periodic runs

def plain_runs(x, least=12):
    out = {}
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j - i >= p:
                out.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in out.items() if n >= least)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def words_with_runs(rng):
    size, out = rng.randint(0, 500), []
    while len(out) < size:
        root = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.choice([1, 2, 3, 5, 11, 17, 30, 60]))]
        out += (root * 40)[:rng.randint(1, 180)] * rng.choice([1, 1, 2, 3])
        if rng.random() < 0.3:
            out.append(99)
    return out


def test_runs_match_a_quadratic_search():
    rng = random.Random(11)
    texts = [words_with_runs(rng) for _ in range(250)]
    texts += [[], [1], fibonacci(700), [0] * 300, [0, 1, 2] * 33 + [0] + [0, 1, 2] * 33, [0, 1, 2] * 60 + [0] + [0, 1, 2] * 10 + [0], ([0, 1] * 30 + [0]) * 5]
    for lo in range(0, len(texts), 16):
        part = texts[lo:lo + 16]
        got = periodic_runs.find_runs([textkernel.mix(np.array(t, np.uint64)) for t in part])
        for t, g in zip(part, got, strict=True):
            assert [tuple(r) for r in g.tolist()] == plain_runs(t)


def plain_op11(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    if doc_id is not None and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def as_table(spark, tmp_path, df, name):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_op11_matches_the_contract(spark, tmp_path):
    rng = random.Random(2)
    rows = [r for r in corpus(rng, 40) if len(r[1] or "") < 20_000]
    rows += [(2000 + i, " ".join(f"w{x}" for x in words_with_runs(rng))) for i in range(60)]
    rows += [(3000, "a b   a b " * 20), (3001, "X x " * 8), (None, "z " * 30), (3002, ("w " * 12).strip()), (3003, "w " * 11)]
    sf = as_table(spark, tmp_path, docs_of(spark, rows).repartition(3), "documents")
    got = [tuple(r) for r in queries.op11_periodic_runs(spark, sf).collect()]
    assert Counter(got) == Counter(plain_op11(r[0], r[1]) for r in rows)


def test_runs_of_an_empty_table_and_of_a_very_long_text(spark):
    empty = periodic_runs.periodic_runs(docs_of(spark, []))
    assert empty.columns == ["doc_id", "n_words", "runs", "collapsed"] and empty.count() == 0
    root = " ".join(f"u{i}" for i in range(50_000))
    row = periodic_runs.periodic_runs(docs_of(spark, [(1, f"{root} {root} {root}")])).first()
    assert row.n_words == 150_000 and [tuple(r) for r in row.runs] == [(0, 150_000, 50_000)] and row.collapsed == root


# token alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Plain:
    """Both tokenizers by their own libraries, aligned token by token."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(PATHS[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
        from fragweave.llm.bpe import byte_symbols
        code = {c: i for i, c in enumerate(byte_symbols())}
        self.bytes_a = {i: bytes(code[c] for c in t) for t, i in self.a.get_vocab().items() if all(c in code for c in t)}

    def byte_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    def groups(self, text):
        if not text:
            return []
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        x, y = [self.bytes_a[i] for i in a], [self.byte_b(i) for i in b]
        if not b"".join(x) == b"".join(y) == (" " + text).encode():
            return []
        out, i, j, at_a, at_b, ga, gb = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                at_a += len(x[i])
                ga.append(a[i])
                i += 1
            else:
                at_b += len(y[j])
                gb.append(b[j])
                j += 1
            if at_a == at_b:
                out.append((ga, gb))
                ga, gb = [], []
        return out


ALPHABET = ["a", "b", "é", " ", "  ", "\n", "\t", "<0x41>", "</s>", "<|endoftext|>", "<unk>", "日本", "▁", "don't", "123", "ﬁ",
            "é", "\x1c", "\x85", "　", "\U0001f600", "\x00", "the ", "and ", " house", "zzzzzz"]


def random_texts(rng, n):
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("hot_pairs", [1_000_000, 5, 0])
def test_op12_matches_a_plain_alignment(spark, hot_pairs):
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate(random_texts(rng, 250))]
    rows += [r for r in corpus(rng, 30)] + [(5000, "the house and the dog"), (5000, "the house and the dog"), (None, "the end"), (5001, "zq" * 5000)]
    plain = Plain()
    groups = [plain.groups(r[1]) for r in rows]
    count = Counter(p for g in groups for p in {(x, y) for ga, gb in g for x in ga for y in gb})
    best: dict[int, int] = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    want = []
    for r, g in zip(rows, groups, strict=True):
        links = [(x, y) for ga, gb in g for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        want.append((r[0], sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), text))
    got = token_alignment.align(docs_of(spark, rows).repartition(4), *PATHS, hot_pairs=hot_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert sum(w[3] > 0 for w in want) > 100 and any(w[1] and not w[3] == w[1] for w in want)


def test_merge_pieces_agree_whatever_their_size():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 400))
        a, b = (np.union1d(rng.choice(n, int(rng.integers(1, n + 1)), replace=False), [n]) for _ in range(2))
        both = np.intersect1d(a, b)
        for piece in (1, 2, 7, 64, 5000):
            x, y = token_alignment.merge_groups(a, b, piece)
            assert (x == np.searchsorted(both, a)).all() and (y == np.searchsorted(both, b)).all()


def test_links_come_in_blocks_of_any_size(monkeypatch):
    pair = token_alignment.Pair(*PATHS)
    s = pair.spell(random_texts(random.Random(3), 80))
    g = token_alignment.group_batch(s, pair.size_a, pair.size_b)
    whole = token_alignment.distinct_links(s, g, pair.width, pair.span)
    monkeypatch.setattr(token_alignment, "LINK_BLOCK", 7)
    for x, y in zip(whole, token_alignment.distinct_links(s, g, pair.width, pair.span), strict=True):
        assert (x == y).all()


def test_alignment_of_an_empty_table(spark):
    assert token_alignment.align(docs_of(spark, []), *PATHS).count() == 0
    row = token_alignment.align(docs_of(spark, [(1, None)]), *PATHS).first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "")


# nearest neighbours

def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id bigint, embedding array<float>, v int, id int, rank int")


def exact_neighbours(rows, every, k):
    use = sorted({(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in use:
        if i % every == 0:
            near = [(float(np.sqrt(((np.array(w, np.float32).astype(float) - np.array(v, np.float32).astype(float)) ** 2).sum())), j)
                    for j, w in use if (j, w) != (i, v) and len(w) == len(v)]
            out[i, v] = sorted(near)[:k]
    return out


def test_neighbours_with_ties_repeats_and_unusable_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(150)]
    same = rng.normal(size=5).astype(np.float32).tolist()
    rows += [(1000 + i, same) for i in range(120)]  # one vector held by many rows
    rows += [rows[10], rows[10], (20, rows[30][1]), (None, same), (200, None), (300, []), (400, [0.0] * 5), (410, [1.0, None, 2.0, 3.0, 4.0]), (420, [1.0, float("nan"), 0.0, 0.0, 0.0]),
             (430, [float("inf")] * 5), (-10, [9.0] * 5), (500, [1.0, 2.0]), (501, [1.0, 3.0])]
    got = neighbours.nearest(vectors_of(spark, rows), every=10, k=10, shard_rows=40, query_block=7).collect()
    want = exact_neighbours(rows, 10, 10)
    lists: dict = {}
    for r in got:
        lists.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(lists) == {i for i, _ in want}
    hits = total = 0
    for (i, _), near in want.items():
        if i in (20,):  # two rows of one id ask for themselves
            assert len(lists[i]) == 20
            continue
        mine = sorted(lists[i])
        assert [r for r, _, _ in mine] == list(range(1, len(near) + 1))
        assert [(s, j) for _, s, j in mine] == sorted((s, j) for _, s, j in mine)
        total += len(near)
        hits += len({j for _, j in near} & {j for _, _, j in mine})
    assert hits >= 0.98 * total
    assert [j for _, j in want[1000, tuple(same)]] == [j for _, _, j in sorted(lists[1000])]  # equal distances: smaller ids first


def test_neighbours_recall_at_production_settings(spark):
    """The given table, and 6,000 random vectors of 64 dimensions, which is the hardest case."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(6000, 64)).astype(np.float32)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    for table in (rows, spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")):
        data = table.select("vec_id", "embedding").collect()
        ids, x = np.array([r[0] for r in data]), np.array([r[1] for r in data], np.float64)
        got: dict = {}
        for r in neighbours.nearest(table).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = n = 0
        for q in np.flatnonzero(ids % 100 == 0):
            d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
            d[q] = np.inf
            near = set(ids[np.argsort(d, kind="stable")[:10]].tolist())
            hits += len(near & got[ids[q]])
            n += 10
        assert hits >= 0.95 * n, hits / n


def test_pruned_edges_are_few_and_lead_apart():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(200, 8)) * 0.01 + c for c in rng.normal(size=(5, 8))]).astype(np.float32)
    edges, entry = neighbours.build_graph(points, degree=16)
    assert edges.shape == (1000, 16)
    ids, _ = neighbours.beam_search(points, edges, entry, points, 32)
    assert (ids[:, 0] == np.arange(1000)).mean() > 0.95  # every cluster can be reached
    some = neighbours.robust_prune(points, np.arange(50), np.broadcast_to(np.arange(1000), (50, 1000)), 16, 1.2)
    for p, row in enumerate(some):
        kept = row[row >= 0]
        for k, v in enumerate(kept[1:], 1):  # none kept is 1.2 times nearer to an earlier one than to p
            assert all(1.2 * np.linalg.norm(points[u] - points[v]) > np.linalg.norm(points[p] - points[v]) * 0.9999 for u in kept[:k])


def test_neighbours_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert neighbours.nearest(empty).count() == 0


# executors that lack the package

def test_every_query_runs_where_executors_lack_the_package(tmp_path):
    """Python workers start in an empty folder with no path to the repository."""
    code = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", {ROOT + "/__spark_entry__.py"!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from fragweave.session import local_session
spark = local_session("bare", 4)
for name, query in entry.queries().items():
    if name.startswith("op") or name == "pipeline":
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print(name, flush=True)
"""
    import os
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1200)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split()) >= 14
