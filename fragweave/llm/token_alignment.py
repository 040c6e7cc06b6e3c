"""Alignment of two tokenizers' tokens by merge-path partitioning.

Both tokenizers spell the same bytes, so each gives an ascending list of byte offsets at which its
tokens end. Where both end, the text is cut into groups; the tokens of a group are linked. The two
lists are merged in pieces of ``PIECE`` ends: a binary search on each diagonal of the merge grid
finds where a piece begins in either list, so all pieces hold equal work and need nothing of each
other, and numpy walks them side by side, one end a step. A piece numbers the groups it meets from 0;
an exclusive sum over the pieces' counts stitches groups that cross their borders. Texts of a batch
lie behind one another, so a text of any length is cut into equal pieces like all others.

An id pair's count is the number of texts that hold it linked. Texts are encoded once, and their
distinct pairs written; counts are summed in every task before they shuffle, and then every text looks
up its own pairs. The ``HOT_PAIRS`` most frequent pairs are broadcast (24 bytes each, whatever the
input), all others are joined by id pair, where a key has fewer rows than any hot one.

A null or empty text, or one whose tokens do not spell a space and the text, has no tokens and
counts of zero. Every row is a text of its own, so repeated rows count each, and keys may be null;
further columns are left behind. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fragweave.llm.bpe import byte_symbols
from fragweave.llm.common import written

PIECE = 64
HOT_PAIRS = 1_000_000
BATCH_BYTES = 1 << 20
LINK_BLOCK = 4_000_000
#: Fixed value: how byte-level vocabularies of this family pre-split a text.
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Spelling(NamedTuple):
    """Token ids of a batch of texts, one after the other, and how many each text has."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray


class Pair:
    """The two tokenizers, loaded from their files in the worker that uses them."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        ids = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        byte_level = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        if not byte_level or spec["normalizer"] or ids != list(range(256, 256 + len(ids))):
            raise ValueError("the first tokenizer must be a plain byte-level BPE whose ids follow its merges")
        code = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes([code[c] for c in token]): i for token, i in vocab.items() if i < 256 + len(ids)}
        self.first = tiktoken.Encoding("first", pat_str=SPLITS, mergeable_ranks=ranks, special_tokens={})
        self.second = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = np.zeros(max(vocab.values()) + 1, np.int64), np.array([len(x) for x in self.bytes_b], np.int64)
        for token, i in ranks.items():
            self.size_a[i] = len(token)
        self.width, self.span = len(self.size_b), len(self.size_a) * len(self.size_b)

    def spell(self, texts: list[str | None]) -> Spelling:
        """Tokens of the texts that both tokenizers spell; the first one always does, as it merges bytes."""
        given = [t or "" for t in texts]
        b = self.second.encode(given, num_threads=1)
        for k, text in enumerate(given):
            if not text or b"".join([self.bytes_b[i] for i in b[k]]) != (" " + text).encode():
                b[k] = []
        a = [self.first.encode_ordinary(" " + text) if x else [] for text, x in zip(given, b, strict=True)]
        n_a, n_b = (np.array([len(x) for x in t], np.int64) for t in (a, b))
        return Spelling(*(np.fromiter(chain.from_iterable(t), np.int64, int(n.sum())) for t, n in ((a, n_a), (b, n_b))), n_a, n_b)


def merge_groups(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The group number of every element of two strictly ascending lists of ends; a group ends where both do."""
    na, nb = len(a), len(b)
    start = np.arange(0, na + nb, piece)
    # where each diagonal meets the merge path: i ends of a and start - i of b come before it, a first in a tie
    low, high = np.maximum(0, start - nb), np.minimum(start, na)
    while (open_at := np.flatnonzero(low < high)).size:
        mid = (low[open_at] + high[open_at]) // 2
        before = a[mid] <= b[start[open_at] - 1 - mid]
        low[open_at[before]] = mid[before] + 1
        high[open_at[~before]] = mid[~before]
    i, j = low.copy(), start - low
    far = np.iinfo(np.int64).max
    a, b = np.append(a, far), np.append(b, far)
    group_a, group_b = np.zeros(na + 1, np.int64), np.zeros(nb + 1, np.int64)  # the last place takes what lies behind the end
    met = np.zeros(len(start), np.int64)
    for _ in range(piece):
        x, y = a[i], b[j]
        from_a = x <= y
        over = from_a & (x == far)
        from_a &= ~over
        from_b = ~from_a & ~over
        group_a[i[from_a]] = met[from_a]
        group_b[j[from_b]] = met[from_b]
        met += from_b & (i > 0) & (a[i - 1] == y)
        i += from_a
        j += from_b
    # stitch: groups that ended in earlier pieces come before
    base = np.cumsum(met) - met
    rank_a = np.arange(na) + np.searchsorted(b[:nb], a[:na], "left")
    rank_b = np.arange(nb) + np.searchsorted(a[:na], b[:nb], "right")
    return group_a[:na] + base[rank_a // piece], group_b[:nb] + base[rank_b // piece]


class Groups(NamedTuple):
    """Group numbers of the tokens of a batch, tokens a group, and the text of each group."""

    of_a: np.ndarray
    of_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    text: np.ndarray


def group_batch(s: Spelling, size_a: np.ndarray, size_b: np.ndarray) -> Groups:
    of_a, of_b = merge_groups(np.cumsum(size_a[s.a]), np.cumsum(size_b[s.b]))
    n = int(of_a[-1]) + 1 if len(of_a) else 0
    n_a, n_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    text = np.zeros(n, np.int64)
    text[of_a] = np.repeat(np.arange(len(s.n_a)), s.n_a)
    return Groups(of_a, of_b, n_a, n_b, text)


def _merged(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(keys) else times


def distinct_links(s: Spelling, g: Groups, width_b: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, times) of the distinct linked id pairs of each text; pair = a id * ``width_b`` + b id, below ``span``.

    Links are written out in blocks, so one very large group needs no more memory than others.
    """
    per_token = g.n_b[g.of_a]
    first_b = np.cumsum(g.n_b) - g.n_b
    upto = np.cumsum(per_token)
    keys, times = [], []
    lo = 0
    while lo < len(s.a):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + LINK_BLOCK, "right")))
        own = per_token[lo:hi]
        token = np.repeat(np.arange(lo, hi), own)
        place = np.arange(len(token)) - np.repeat(np.cumsum(own) - own, own)
        b = s.b[first_b[g.of_a[token]] + place]
        found = np.sort(g.text[g.of_a[token]] * span + s.a[token] * width_b + b)
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        keys.append(found[first])
        times.append(np.diff(np.append(first, len(found))))
        lo = hi
    if len(keys) > 1:
        both = _merged(np.concatenate(keys), np.concatenate(times))
    else:
        both = (keys[0], times[0]) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return both[0] // span, both[0] % span, both[1]


class GroupText:
    """Writes groups as a1,a2|b1;a3|b2,b3."""

    def __init__(self, n_a: int, n_b: int):
        self.tables = [np.array([f"{i}{sep}" for i in range(n)], object) for n, sep in ((n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";"))]

    def __call__(self, s: Spelling, g: Groups) -> list[str]:
        last_a, last_b = (np.append(x[1:] != x[:-1], True) if len(x) else np.zeros(0, bool) for x in (g.of_a, g.of_b))
        out = np.empty(len(s.a) + len(s.b), object)
        start_b, upto_a = np.cumsum(g.n_b) - g.n_b, np.cumsum(g.n_a)
        comma_a, end_a, comma_b, end_b = self.tables
        out[np.arange(len(s.a)) + start_b[g.of_a]] = np.where(last_a, end_a[s.a], comma_a[s.a])
        out[np.arange(len(s.b)) + upto_a[g.of_b]] = np.where(last_b, end_b[s.b], comma_b[s.b])
        bounds = np.concatenate([[0], np.cumsum(s.n_a + s.n_b)]).tolist()
        words = out.tolist()
        return ["".join(words[lo:hi])[:-1] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


def _slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of the batches of about BATCH_BYTES of text, and their texts."""
    for batch in batches:
        texts = batch.column(at).to_pylist()
        lo, size = 0, 0
        for hi, text in enumerate(texts, 1):
            size += len(text or "")
            if size >= BATCH_BYTES or hi == len(texts):
                yield batch.slice(lo, hi - lo), texts[lo:hi]
                lo, size = hi, 0


def _aligned(source: DataFrame, path_a: str, path_b: str, keep: tuple[str, ...], full: bool) -> DataFrame:
    """One row a text: its counts, groups, and its distinct linked pairs with how often each is linked."""
    n_keep = len(keep)
    names = [*keep, "n_a", "n_b", "n_groups", "n_links", "groups", "_pairs", "_times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(path_a, path_b)
        write = GroupText(len(pair.size_a), len(pair.size_b))
        for batch, texts in _slices(batches, n_keep):
            s = pair.spell(texts)
            g = group_batch(s, pair.size_a, pair.size_b)
            n_groups, n_links = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            np.add.at(n_groups, g.text, 1)
            np.add.at(n_links, g.text, g.n_a * g.n_b)
            text, found, times = distinct_links(s, g, pair.width, pair.span)
            bounds = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int64())) for x in (found, times)]
            groups = write(s, g)
            if not full:
                groups = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in groups]
            numbers = [pa.array(x, pa.int64()) for x in (s.n_a, s.n_b, n_groups, n_links)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *numbers, pa.array(groups, pa.string()), *lists], names=names)

    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)
    schema += ", n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, _pairs array<bigint>, _times array<bigint>"
    return written(source.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "aligned", compression="zstd")


def _pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): texts that hold a pair, and whether no other pair of its A id has more."""
    counts = aligned.select(F.explode("_pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(F.expr(f"pair div {width}"))  # at most one row for each B id in a window
    return written(counts.withColumn("best", F.col("n") == F.max("n").over(own)), "pair-counts")


def _hot_and_rest(counts: DataFrame, most: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], DataFrame]:
    """At most ``most`` of the most frequent pairs as arrays (pair ascending), and the table of all others."""
    level = F.floor(F.log2("n") * 8)
    sizes = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    cut, total = (sizes[0][0] + 1 if sizes else 0), 0
    for at, size in sizes:
        total += size
        if total > most:
            break
        cut = at
    hot = counts.where(level >= cut).toPandas().sort_values("pair")
    return tuple(hot[c].to_numpy() for c in ("pair", "n", "best")), counts.where(level < cut)


def _looked_up(aligned: DataFrame, hot: tuple[np.ndarray, np.ndarray, np.ndarray], keep: tuple[str, ...]) -> DataFrame:
    """n_best and count_sum from the hot pairs; _pairs and _times keep all others."""
    shipped = aligned.sparkSession.sparkContext.broadcast(hot)
    names = [*keep, "n_a", "n_b", "n_groups", "n_links", "groups", "_row", "n_best", "count_sum", "_pairs", "_times"]
    n_first = len(keep) + 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_pair, hot_n, hot_best = shipped.value
        for batch in batches:
            m = batch.num_rows
            pairs, times = batch.column(n_first), batch.column(n_first + 1)
            text = np.repeat(np.arange(m), pairs.value_lengths().to_numpy(zero_copy_only=False))
            found, times = pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(hot_pair, found), max(len(hot_pair) - 1, 0))
            known = hot_pair[at] == found if len(hot_pair) else np.zeros(len(found), bool)
            n_best, count_sum = np.zeros(m, np.int64), np.zeros(m, np.int64)
            np.add.at(count_sum, text[known], hot_n[at[known]] * times[known])
            np.add.at(n_best, text[known], hot_best[at[known]] * times[known])
            bounds = pa.array(np.searchsorted(text[~known], np.arange(m + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x[~known], pa.int64())) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_first], pa.array(n_best), pa.array(count_sum), *lists], names=names)

    types = {f.name: f.dataType.simpleString() for f in aligned.schema.fields}
    schema = ", ".join(f"`{c}` {types.get(c, 'bigint')}" for c in names)
    return written(aligned.select(*names[:n_first], "_pairs", "_times").mapInArrow(run, schema), "looked-up")


def align(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), full: bool = True,
          hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Align the tokens of every whole text.

    ``path_a`` names a byte-level BPE of the tokenizers library, which reads a space and the text;
    ``path_b`` a sentencepiece model, which puts the space itself. Returns the columns ``keep``, n_a,
    n_b, n_groups, n_links, n_best (links whose pair is the most frequent of its A id), count_sum
    (counts of all links) and groups: ids as `a1,a2|b1;a3|b2,b3`, or their SHA-256 where ``full`` is
    false. Without tokens groups is ''.
    """
    aligned = _aligned(docs.select(*keep, docs[text_col].alias("_text")), path_a, path_b, keep, full)
    hot, rest = _hot_and_rest(_pair_counts(aligned, Pair(path_a, path_b).width), hot_pairs)
    found = _looked_up(aligned, hot, keep)
    linked = found.select("_row", F.explode(F.arrays_zip("_pairs", "_times")).alias("_link")).select("_row", F.col("_link._pairs").alias("pair"), F.col("_link._times").alias("times"))
    more = linked.join(rest.hint("merge"), "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum"))
    return found.join(more.hint("merge"), "_row", "left").select(
        *keep, "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"), "groups")
