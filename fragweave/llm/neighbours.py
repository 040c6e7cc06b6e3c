"""Approximate nearest neighbours (Euclidean) by robust-pruned directed graphs, one per shard.

Rows are dealt by a hash of the vector into shards of about ``shard_rows`` distinct vectors. In each
shard points join a graph in batches: a greedy beam search over the graph so far proposes neighbours,
robust pruning keeps the nearest one, drops every other proposal that is ``ALPHA`` times nearer to it
than to the point, and goes on with the next, so at most ``DEGREE`` edges that lead in different
directions stay. Edges are added backwards too, and lists that grow too long are pruned again. The
index is a table in the shared folder: one row a node with its vector and edges. Queries then run a
beam search in every shard, in blocks of ``query_block``, and the best of all shards are ranked by
distances in double precision from the vectors as given.

Bounds: a task holds one shard and one block of queries, whatever the table's size. Every row is
indexed; nothing is fitted on a sample. On uniformly random vectors of 64 dimensions, which have no
structure to exploit, a shard of 4,096 is searched at a recall of 0.9 and more with ``BEAM``. A shard costs
a query about as much at ten times the rows, so ``shard_rows`` should grow with the table up to what a
task's memory holds.

Equal vectors are one node, which names its smallest k + 1 ids: more can never be among k nearest,
as ties go to the smaller id. A vector held by a third of all rows is cut to that before the shuffle.
Rows without an id, and vectors that are null, empty, zero or hold null or non-finite components, take
no part. Rows equal in id and vector are one row; rows that share an id only are all candidates, and
each asks for itself. Vectors of another length are never compared. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragweave.llm.common import written

SHARD_ROWS = 4096
QUERY_BLOCK = 2048
DEGREE = 32
BEAM = 128
BUILD_BEAM = 64
ALPHA = 1.2
WIDE = 4
BATCH = 512


def _apart(vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances between each row's vectors and its own target; differences keep near copies apart."""
    off = vectors - to[:, None]
    return np.einsum("mcd,mcd->mc", off, off)


def beam_search(points: np.ndarray, edges: np.ndarray, entry: int, asked: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances of the ``beam`` nearest points that a greedy search meets, nearest first.

    All queries step at once; each expands its WIDE nearest open points a step until none is open.
    Absent places hold id -1 and distance infinity. ``edges`` holds -1 where a point has no further edge.
    """
    m, n = len(asked), len(points)
    ids, dist, done = np.full((m, beam), -1, np.int32), np.full((m, beam), np.inf, np.float32), np.ones((m, beam), bool)
    seen = np.zeros((m, n + 1), bool)  # the last column stands for "no edge"
    seen[:, n] = seen[:, entry] = True
    ids[:, 0], dist[:, 0], done[:, 0] = entry, _apart(points[np.full((m, 1), entry)], asked)[:, 0], False
    live = np.arange(m)
    while len(live):
        open_at = np.where(done[live], np.inf, dist[live])
        at = np.argpartition(open_at, WIDE - 1, axis=1)[:, :WIDE] if beam > WIDE else np.broadcast_to(np.arange(beam), (len(live), beam))
        from_ids = np.where(np.isfinite(np.take_along_axis(open_at, at, 1)), np.take_along_axis(ids[live], at, 1), -1)
        done[live[:, None], at] = True
        going = (from_ids >= 0).any(axis=1)
        live, from_ids = live[going], from_ids[going]
        if not len(live):
            break
        near = np.where(from_ids[:, :, None] >= 0, edges[from_ids], -1).reshape(len(live), -1)
        near = np.sort(np.where(near < 0, n, near), axis=1)
        fresh = ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[live[:, None], near] = True
        most = int(fresh.sum(axis=1).max(initial=0))
        if not most:
            continue
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :most]
        fresh = np.take_along_axis(fresh, order, 1)
        near = np.where(fresh, np.take_along_axis(near, order, 1), 0)
        d = np.where(fresh, _apart(points[near], asked[live]), np.inf).astype(np.float32)
        all_d = np.concatenate([dist[live], d], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[live] = np.take_along_axis(all_d, best, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1).astype(np.int32)], axis=1), best, 1)
        done[live] = np.take_along_axis(np.concatenate([done[live], ~fresh], axis=1), best, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def robust_prune(points: np.ndarray, own: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` diverse neighbours of each point ``own`` among its proposals (-1: none)."""
    ids = np.sort(proposed, axis=1)
    bad = (ids < 0) | (ids == own[:, None])
    bad[:, 1:] |= ids[:, 1:] == ids[:, :-1]
    safe = np.where(bad, 0, ids)
    d = np.where(bad, np.inf, _apart(points[safe], points[own]))
    order = np.argsort(d, axis=1, kind="stable")
    ids, d = np.take_along_axis(safe, order, 1), np.take_along_axis(d, order, 1)
    alive = np.isfinite(d)
    kept = np.full((len(own), degree), -1, np.int32)
    vectors = points[ids]
    rows = np.arange(len(own))
    for k in range(degree):
        at = alive.argmax(axis=1)
        some = alive[rows, at]
        if not some.any():
            break
        pick = ids[rows, at]
        kept[some, k] = pick[some]
        alive &= alpha * alpha * _apart(vectors, points[pick]) > d
        alive[rows, at] = False
    return kept


def _add_backwards(points: np.ndarray, edges: np.ndarray, new: np.ndarray, alpha: float) -> None:
    """Give every neighbour of the new points an edge back; lists that overflow are pruned."""
    degree = edges.shape[1]
    target, source = edges[new].ravel(), np.repeat(new, degree)
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    touched, first, count = np.unique(target, return_index=True, return_counts=True)
    room = degree - (edges[touched] >= 0).sum(axis=1)
    simple = np.flatnonzero(count <= room)
    for k in range(int(count[simple].max(initial=0))):
        some = simple[count[simple] > k]
        edges[touched[some], (degree - room[some]) + k] = source[first[some] + k]
    full = np.flatnonzero(count > room)
    full = full[np.argsort(count[full])]  # similar lengths together, so that padding stays small
    for lo in range(0, len(full), BATCH):
        part = full[lo:lo + BATCH]
        extra = np.full((len(part), int(count[part].max())), -1, np.int64)
        for row, k in enumerate(part):
            extra[row, :count[k]] = source[first[k]:first[k] + count[k]]
        both = np.concatenate([edges[touched[part]].astype(np.int64), extra], axis=1)
        edges[touched[part]] = robust_prune(points, touched[part], both, degree, alpha)


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (n x degree, -1 padded) and the point where searches enter: the one nearest the mean."""
    n = len(points)
    middle = points.mean(axis=0, dtype=np.float64).astype(points.dtype)
    entry = int(np.argmin(_apart(points[None], middle[None])[0]))
    edges = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(n).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    first = order[:degree + 1]
    edges[first] = robust_prune(points, first, np.broadcast_to(first, (len(first), len(first))), degree, alpha)
    at = len(first)
    while at < n:
        new = order[at:at + min(at, BATCH)]
        proposed, _ = beam_search(points, edges, entry, points[new], beam)
        edges[new] = robust_prune(points, new, proposed.astype(np.int64), degree, alpha)
        _add_backwards(points, edges, new, alpha)
        at += len(new)
    return edges, entry


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a.astype(np.float64) - b.astype(np.float64)) ** 2).sum(axis=-1))


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct (id, v, dim) of the rows that take part."""
    v = F.col("v")
    rows = vectors.select(vectors[id_col].cast("bigint").alias("id"), vectors[vector_col].alias("v"))
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).distinct().withColumn("dim", F.size("v"))


def build_index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """The written index (dim, shard, node, v, ids, edges, entry) of usable rows, and its number of shards."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = rows.withColumn("_at", rank).where(F.col("_at") <= k + 1).groupBy("v", "dim").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = written(nodes, "ann-nodes")
    shards = max(1, -(-nodes.count() // shard_rows))
    kind = dict(nodes.dtypes)["v"]

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        points = np.stack(part["v"].to_numpy()).astype(np.float32)
        edges, entry = build_graph(points)
        is_entry = np.zeros(len(part), bool)
        is_entry[entry] = True
        return pd.DataFrame({"dim": part["dim"], "shard": part["shard"], "node": np.arange(len(part), dtype=np.int32), "v": part["v"],
                             "ids": part["ids"], "edges": [e[e >= 0] for e in edges], "entry": is_entry})

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    graph = dealt.groupBy("dim", "shard").applyInPandas(build, f"dim int, shard int, node int, v {kind}, ids array<bigint>, edges array<int>, entry boolean")
    return written(graph, "ann-index"), shards


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = BEAM,
            shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose id is divisible by ``every``."""
    rows = written(_usable(vectors, id_col, vector_col), "ann-rows")
    index, shards = build_index(rows, k, shard_rows)
    asked = rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() // query_block))
    block = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
    # the stated queries meet every shard, block by block
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"), F.col("id").alias("query_id"), "v")
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(key: tuple, nodes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "who": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "who": "int64", "vec_id": "int64"})
        if nodes.empty or queries.empty:
            return empty
        nodes = nodes.sort_values("node", kind="stable")
        given = np.stack(nodes["v"].to_numpy())
        points = given.astype(np.float32)
        edges = np.full((len(nodes), DEGREE), -1, np.int32)
        for row, e in enumerate(nodes["edges"]):
            edges[row, :len(e)] = e
        members, entry = nodes["ids"].to_numpy(), int(nodes["entry"].to_numpy().argmax())
        asked_v = np.stack(queries["v"].to_numpy())
        ids = queries["query_id"].to_numpy()
        out = []
        for lo in range(0, len(ids), BATCH):
            got, _ = beam_search(points, edges, entry, asked_v[lo:lo + BATCH].astype(np.float32), beam)
            for row, found in enumerate(got):
                found = found[found >= 0]
                score = _distances(given[found], asked_v[lo + row])
                names = np.concatenate([members[f] for f in found])
                score = np.repeat(score, [len(members[f]) for f in found])
                other = ~((names == ids[lo + row]) & (score == 0))
                names, score = names[other], score[other]
                best = np.lexsort((names, score))[:k]
                out.append(pd.DataFrame({"query_id": ids[lo + row], "who": queries["who"].iloc[lo + row], "vec_id": names[best], "score": score[best]}))
        return pd.concat(out) if out else empty

    keys = ("dim", "shard", "block")
    asked = asked.withColumn("who", F.xxhash64("v"))
    found = index.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "query_id bigint, who bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "who").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
