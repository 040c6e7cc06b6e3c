"""N-gram Jaccard self-join by a size-aware split into small and large sets.

A document is its set of distinct word shingles; equal sets are one class. Two small sets that are
similar share a subset of the size that their sizes require, so small sets enumerate their subsets of
that fixed size. Large sets scan inverted lists: in one global order of shingles (rare bins before
frequent ones, then by hash) similar sets share one of their first shingles, so only those are
listed. The boundary is the size with the least cost over the histogram of sizes.

Lists are not expanded into all pairs. Members are first compared with one pivot of their list;
linked members join components; then only members of different components of one list are
compared, all of them, so no link between different sets is lost for connectivity.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragweave.llm.common import written
from fragweave.llm.components import components
from fragweave.llm.textkernel import chunks, mix, shingles, words

BIN_BITS = 18
#: Sizes that may count as small; above, the subsets outnumber any list.
SMALL_LIMIT = 32
SEEN_BITS = 23
#: Bits of the parity signature that bounds how much two sets differ.
SIGN_BITS = 11


def overlap_needed(a: int, b: int, percent: int) -> int:
    """Least intersection of similar sets of sizes a and b: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def partners(size: int, percent: int) -> range:
    return range(-(-percent * size // 100), 100 * size // percent + 1)


def first_shingles(size: int, percent: int) -> int:
    """How many shingles in the global order must hold a common one with any similar set."""
    return size - -(-percent * size // 100) + 1


def subsets_of(size: int, limit: int, percent: int) -> list[tuple[int, int]]:
    """(partner size, subset size) for which a small set lists its subsets; equal sets are one class already."""
    need = [(p, overlap_needed(size, p, percent)) for p in partners(size, percent) if 0 < p <= limit]
    return [(p, c) for p, c in need if c <= min(p, size) and not (p == size and c == size)]


def boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """Largest size treated as small: least total of subsets listed and list entries scanned."""
    def cost(limit: int) -> float:
        small = sum(n * sum(comb(s, c) for _, c in subsets_of(s, limit, percent)) for s, n in sizes.items() if s <= limit)
        return small + sum(n * first_shingles(s, percent) * (1 + list_length) for s, n in sizes.items() if s > limit or s in partners(limit + 1, percent))
    return min(range(SMALL_LIMIT + 1), key=cost)


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for _, _, data, offsets in chunks(column):
        yield from shingles(*words(data, offsets), k)


def _bins(sets: np.ndarray) -> np.ndarray:
    return (mix(sets) >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def profile(docs: DataFrame, k: int) -> tuple[np.ndarray, dict[int, int], float]:
    """Frequent bins of shingles (a fixed-size bitmap), the histogram of small sizes, the mean list length.

    A bin is frequent when it exceeds the mean by ten standard deviations of a random count, so a
    shingle in an infrequent bin occurs in few documents: about the root of the mean.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BIN_BITS) + SMALL_LIMIT + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                got = [s for s in _sets(batch.column(0).slice(lo, 500), k) if len(s)]
                if got:
                    total += np.bincount(_bins(np.concatenate(got)), minlength=len(total))
                    small = np.bincount([len(s) for s in got if len(s) <= SMALL_LIMIT], minlength=SMALL_LIMIT + 1)
                    total[1 << BIN_BITS:] += small.astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bin", "n"])

    counted = docs.select("text").where("text is not null").mapInArrow(count, "bin int, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # at most 2**BIN_BITS rows and the small sizes
    at, n = found["bin"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    in_bin = at < 1 << BIN_BITS
    mean = n[in_bin].sum() / (1 << BIN_BITS)
    frequent = np.zeros(1 << BIN_BITS, bool)
    frequent[at[in_bin & (n > mean + 10 * np.sqrt(mean) + 16)]] = True
    sizes = {int(a) - (1 << BIN_BITS): int(m) for a, m in zip(at[~in_bin], n[~in_bin], strict=True)}
    return frequent, sizes, float(np.sqrt(mean))


def keyed(docs: DataFrame, frequent: np.ndarray, limit: int, k: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sign, keys): first shingles of large sets, subset hashes of small ones.

    ``sign`` holds, for every bin, whether an odd number of the set's shingles falls into it.
    """
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(frequent))  # 2**BIN_BITS bits
    # small sets that can be similar to a large one also stand in the lists
    listed_from = -(-percent * (limit + 1) // 100)

    def keys_of(s: np.ndarray, hot: np.ndarray) -> list[np.ndarray]:
        n, out = len(s), []
        if n >= listed_from:
            most = first_shingles(n, percent)
            rare = np.flatnonzero(~hot)[:most]
            out.append(s[rare] if len(rare) == most else np.concatenate((s[rare], s[np.flatnonzero(hot)[:most - len(rare)]])))
        if n <= limit:
            for p, c in subsets_of(n, limit, percent):
                seed = np.uint64(min(n, p) << 20 | max(n, p) << 8 | c)
                rows = np.array(list(combinations(s, c)), np.uint64)
                h = mix(rows[:, 0] + seed)
                for j in range(1, c):
                    h = mix(h * np.uint64(3) + rows[:, j])
                out.append(h)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                got = list(_sets(part.column(1), k))
                size = np.array([len(s) for s in got], np.int64)
                flat = np.concatenate(got)
                start = np.concatenate(([0], np.cumsum(size)))
                hot = often[_bins(flat)]
                sums = [np.concatenate((mix(flat ^ np.uint64(c)), np.zeros(1, np.uint64))) for c in (11, 12)]
                sums = np.stack([np.add.reduceat(x, start[:-1]) for x in sums], 1)
                place = (flat & np.uint64((1 << SIGN_BITS) - 1)).astype(np.int64)
                digest, sign, keys, ends = [], [], [], [0]
                for i, s in enumerate(got):
                    odd = np.bincount(place[start[i]:start[i + 1]], minlength=1 << SIGN_BITS) & 1
                    sign.append(np.packbits(odd.astype(bool)).tobytes())
                    own = keys_of(s, hot[start[i]:start[i + 1]]) if len(s) else []
                    digest.append(sums[i].tobytes() if len(s) else b"")
                    keys += own
                    ends.append(ends[-1] + sum(map(len, own)))
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size), pa.array(digest, pa.binary()), pa.array(sign, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["doc_id", "n_shingles", "digest", "sign", "keys"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, sign binary, keys array<bigint>")


def _marks(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) >> np.uint64(64 - SEEN_BITS)).astype(np.int64)


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, set) of the documents named in ``ids`` (id); a fixed-size bitmap spares others the shuffle."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << SEEN_BITS, bool)
        for batch in batches:
            seen[_marks(batch.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int32())], names=["mark"])

    marks = ids.select("id").mapInArrow(mark, "mark int").distinct().toPandas()["mark"].to_numpy()  # at most 2**SEEN_BITS
    seen = np.zeros(1 << SEEN_BITS, bool)
    seen[marks] = True
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(bits.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(wanted[_marks(batch.column(0).to_numpy())]))
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                got = list(_sets(part.column(1), k))
                ends = np.concatenate(([0], np.cumsum([len(s) for s in got])))
                flat = np.concatenate(got).view(np.int64) if got else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["id", "set"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return source.mapInArrow(run, "id bigint, set array<bigint>").join(ids.select("id").hint("merge"), "id", "left_semi")


def plausible(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets may be similar by their signatures, which differ in no more bins than the sets in shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sign_a", "sign_b"))
                na, nb = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
                need = -(-percent * (na + nb) // (100 + percent))
                batch = batch.filter(pa.array(np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= na + nb - 2 * need))
            yield batch.select(["a", "b"])

    side = lambda c: signs.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sign").alias(f"sign_{c}"))
    both = pairs.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b")
    return written(both.select("a", "b", "n_a", "n_b", "sign_a", "sign_b").mapInArrow(run, "a bigint, b bigint").distinct(), "plausible")


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar, compared exactly."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = written(sets_of(docs, ids, k), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")).hint("merge"), "a").join(
        sets.select(F.col("id").alias("b"), F.col("set").alias("sb")).hint("merge"), "b")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("i"))
    return written(both.where(f"100 * i >= {percent} * (na + nb - i)").select("a", "b"), "links")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Documents link when 100 * intersection >= percent * union of their shingle sets; component_id is
    the smallest doc_id reachable. Null and empty texts have no shingles and link with nothing; a
    null doc_id has a null component. Rows that share a doc_id count as one document.
    """
    frequent, sizes, length = profile(docs, k)
    limit = boundary(sizes, length, percent)
    sets = written(keyed(docs, frequent, limit, k, percent), "shingle-keys")
    classes = written(
        sets.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "set-classes")
    # one row per class: the document that stands for it
    own = sets.select("doc_id", "digest", "n_shingles", "keys").join(classes.hint("merge"), [sets["doc_id"] == classes["rep"], sets["digest"] == classes["digest"]]).select("rep", "n_shingles", "keys")
    signs = sets.select("doc_id", "digest", "n_shingles", "sign").join(classes.hint("merge"), [sets["doc_id"] == classes["rep"], sets["digest"] == classes["digest"]]).select("rep", "n_shingles", "sign")
    entries = own.select("rep", F.col("n_shingles").alias("n"), F.posexplode("keys").alias("pos", "key"))
    # subset hashes stand behind the first shingles and have no place in the global order
    in_order = F.expr(f"n >= {-(-percent * (limit + 1) // 100)} and pos <= n - ceil({percent} * n / 100)")
    entries = entries.withColumn("pos", F.when(in_order, F.col("pos")).otherwise(0))
    lists = entries.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("key")
    members = written(entries.join(lists.hint("merge"), "key", "left_semi"), "lists")

    # If this is the first shingle two sets share, it and what follows must make up the overlap they need.
    # Similar sets pass at their first shared shingle.
    def possible(x: str, y: str) -> Column:
        need = f"({percent} * (n{x} + n{y}) + {99 + percent}) div {100 + percent}"
        return F.expr(f"least(n{x}, n{y}) >= {need} and n{x} - pos{x} >= {need} and n{y} - pos{y} >= {need}")

    # the pivot is the member that has the list's shingle earliest: that of a group of near copies is their origin
    pivots = members.groupBy("key").agg(F.min(F.struct("pos", "rep", "n")).alias("p")).select("key", *(F.col(f"p.{c}").alias(f"{c}_p") for c in ("pos", "rep", "n")))
    first = members.join(pivots.hint("merge"), "key").where((F.col("rep") != F.col("rep_p")) & possible("", "_p"))
    first = written(first.select(F.least("rep", "rep_p").alias("a"), F.greatest("rep", "rep_p").alias("b")).distinct(), "pairs")
    links = verified(docs, plausible(first, signs, percent), k, percent)
    labels = components(links)
    # what is left: members of one list that are in different components
    at = members.join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("key", "rep", "n", "pos", F.coalesce("label", "rep").alias("label"))
    mixed = at.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    at = written(at.join(mixed.hint("merge"), "key", "left_semi"), "mixed-lists")
    x, y = (at.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "pos", "label"))) for s in "xy")
    cross = x.join(y.hint("merge"), "key").where((F.col("label_x") < F.col("label_y")) & possible("_x", "_y"))
    cross = cross.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct()
    cross = written(cross.join(first.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    more = verified(docs, plausible(cross, signs, percent), k, percent)
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    # class -> component, then every document of the class
    found = classes.join(labels.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("digest", F.coalesce("label", "rep").alias("component_id"))
    return _attach(sets.select("doc_id", "n_shingles", "digest"), found)


def _attach(sets: DataFrame, found: DataFrame) -> DataFrame:
    """Join every document to the component of its class; classes of very many documents go by broadcast."""
    total = sets.count()
    big = sets.groupBy("digest").count().where((F.col("count") * 1000 > total) & (F.length("digest") > 0)).select("digest")  # fewer than 1000
    hot = found.join(F.broadcast(big), "digest")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(own)
    few = sets.join(F.broadcast(big), "digest", "left_anti")
    empty, few = few.where("n_shingles = 0").withColumn("component_id", F.lit(None).cast("bigint")), few.where("n_shingles > 0")
    out = sets.join(F.broadcast(hot), "digest").unionByName(few.join(found.hint("merge"), "digest", "left")).unionByName(empty)
    return out.select("doc_id", "n_shingles", own.alias("component_id"))
