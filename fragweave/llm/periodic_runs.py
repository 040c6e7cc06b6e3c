"""Periodic runs of words, by string synchronising sets.

A run is a stretch of consecutive words with smallest period q, at least 2 q and ``min_length`` long,
that no neighbouring word extends. All runs of a text are found:

* Periods below ``FIRST_PERIOD`` come from comparing the words with themselves, shifted.
* Scale t = 4, 8, 16 ... finds the periods p with 3 t - 1 <= p < 6 t - 1. A word position is
  selected when, of the hashes of the t-word windows that begin in the t + 1 positions from it on,
  the least stands at the first or the last one. Whether it is depends on the 2 t words from it on
  alone, so a position and the one a period later are selected alike, and have an equal context.
  Selected positions with equal contexts, p apart, propose p.
* Windows with a period of t / 3 or less are left out of the selection, else it would crowd in
  them. A run whose whole first period is such a region is the only kind this can lose. Two
  neighbouring regions of one small period r meet inside it, and their phases fix p modulo r: these
  p are proposed as well.

A proposal is extended both ways by binary lifting over prefix hashes and counts when it repeats;
the words themselves are compared at last, so hashes decide nothing. Of equal stretches the smallest
period stays. Work is about n log n words a text, and n / t positions at scale t.

Texts go through Arrow batches, about a megabyte at a time. A null or empty text, or one of white
space, has no words and no runs. Rows are read by themselves, so repeated rows, ties and null keys
need no care; further columns of the table are left behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

import fragweave.llm.common  # noqa: F401
from fragweave.llm import textkernel as tk

MIN_LENGTH = 12
FIRST_SCALE = 4
FIRST_PERIOD = 3 * FIRST_SCALE - 1
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Windows:
    """Hashes of stretches of a sequence, from prefix sums modulo 2**64."""

    def __init__(self, seq: np.ndarray):
        self.n = len(seq)
        self.up, self.down = tk._power(self.n + 1)
        self.total = np.zeros(self.n + 1, np.uint64)
        np.cumsum(seq * self.up[:-1], out=self.total[1:])

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        return tk.mix((self.total[at + length] - self.total[at]) * self.down[at])

    def same(self, at: np.ndarray, shift: np.ndarray, length: int) -> np.ndarray:
        """Whether the stretches at ``at`` and ``at + shift`` have equal hashes."""
        other = at + shift
        return (self.total[at + length] - self.total[at]) * self.up[shift] == self.total[other + length] - self.total[other]

    def extend(self, at: np.ndarray, shift: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """How many positions before and from ``at`` on equal those ``shift`` later."""
        before, after = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        step = 1 << max(longest, 1).bit_length() - 1
        for width in (1 << k for k in range(step.bit_length() - 1, -1, -1)):
            x = at + after
            fits = np.flatnonzero(x + shift + width <= self.n)
            after[fits[self.same(x[fits], shift[fits], width)]] += width
            x = at - before - width
            fits = np.flatnonzero(x >= 0)
            before[fits[self.same(x[fits], shift[fits], width)]] += width
        return before, after


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, _NONE)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[:n - width + 1], head[width - 1:n])


def _shifted(seq: np.ndarray, period: int) -> np.ndarray:
    """Stretches (start, end, period) of at least two periods, from the sequence compared with itself."""
    equal = np.zeros(max(len(seq) - period, 0) + 2, np.int8)
    equal[1:-1] = seq[:-period] == seq[period:] if len(seq) > period else 0
    edge = np.diff(equal)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= period
    return np.stack([start[long], end[long] + period, np.full(int(long.sum()), period)], axis=1)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """One row a stretch, with its smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def _selected(windows: Windows, runs: np.ndarray, t: int) -> np.ndarray:
    """Positions of the synchronising set of scale t, ascending."""
    at = np.arange(windows.n - t + 1)
    value = windows.hashes(at, t)
    small = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t)]
    cover = np.zeros(len(at) + 1, np.int64)
    np.add.at(cover, small[:, 0], 1)
    np.add.at(cover, small[:, 1] - t + 1, -1)
    value[np.cumsum(cover)[:-1] > 0] = _NONE
    least = _least(value, t + 1)
    m = len(least)
    return np.flatnonzero((least != _NONE) & ((least == value[:m]) | (least == value[t:t + m])))


def _context_pairs(windows: Windows, owner: np.ndarray, at: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Selected positions of one text with equal contexts, and how far they are apart."""
    low, high = 3 * t - 1, 6 * t - 1
    context = windows.hashes(at, 2 * t) ^ tk.mix(owner[at].astype(np.uint64))
    order = np.argsort(context, kind="stable")
    at, context = at[order], context[order]
    found, apart = [], []
    here = np.arange(len(at))
    for k in range(1, len(at)):
        here = here[here + k < len(at)]
        gap = at[here + k] - at[here]
        near = (context[here] == context[here + k]) & (gap < high)
        here, gap = here[near], gap[near]
        if not len(here):
            break
        wide = gap >= low
        found.append(at[here[wide]])
        apart.append(gap[wide])
    return np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(apart or [np.zeros(0, np.int64)])


def _region_pairs(windows: Windows, runs: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Periods of scale t from neighbouring regions of one small period that touch or overlap."""
    low, high = 3 * t - 1, 6 * t - 1
    long = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= low)]
    long = long[np.lexsort((long[:, 0], long[:, 2]))]
    found, apart = [], []
    meet = np.flatnonzero((long[1:, 2] == long[:-1, 2]) & (long[:-1, 1] >= long[1:, 0]))
    for (a, a_end, r), (b, b_end, _) in zip(long[meet].tolist(), long[meet + 1].tolist(), strict=True):
        root = windows.hashes(np.array([b]), r)
        turn = np.flatnonzero(windows.hashes(a + np.arange(r), r) == root)
        for phase in turn.tolist():
            first = low + (b - a - phase - low) % r
            periods = np.arange(first, min(high, a_end - a + 1, b_end - b + 1), r)
            found.append(np.maximum(a, b - periods))
            apart.append(periods)
    return np.concatenate(found or [np.zeros(0, np.int64)]), np.concatenate(apart or [np.zeros(0, np.int64)])


def _by_hand(seq: np.ndarray, start: int, end: int, period: int) -> Iterator[tuple[int, int, int]]:
    """The repeating stretches of a period inside a stretch that hashes alone took for one."""
    for s, e, _ in _shifted(seq[start:end], period).tolist():
        yield start + s, start + e, period


def _proposed(seq: np.ndarray, windows: Windows, at: np.ndarray, apart: np.ndarray, longest: int) -> np.ndarray:
    """Extend proposals and keep what repeats; every stretch is compared word by word."""
    before, after = windows.extend(at, apart, longest)
    whole = before + after >= apart
    rows = np.stack([(at - before)[whole], (at + apart + after)[whole], apart[whole]], axis=1)
    rows = np.unique(rows, axis=0) if len(rows) else rows
    out = []
    for s, e, p in rows.tolist():
        if np.array_equal(seq[s:e - p], seq[s + p:e]):
            out.append((s, e, p))
        else:
            out.extend(_by_hand(seq, s, e, p))
    return np.array(out, np.int64).reshape(-1, 3)


def find_runs(texts: list[np.ndarray], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """Rows (start, length, period) of the runs of each sequence of 64-bit values, by start, then period."""
    sizes = np.array([len(x) for x in texts], np.int64)
    longest = int(sizes.max(initial=0))
    first = np.cumsum(sizes + 1) - sizes - 1
    n = int((sizes + 1).sum())
    # a value of its own behind every text: no stretch reaches across
    seq = np.empty(n, np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    for x, lo in zip(texts, first.tolist(), strict=True):
        seq[lo:lo + len(x)] = x
    ends = first + sizes
    seq[ends] = tk.mix(np.arange(len(texts), dtype=np.uint64) + np.uint64(1 << 60))
    runs = _smallest(np.concatenate([_shifted(seq, p) for p in range(1, min(FIRST_PERIOD, longest // 2 + 1))] or [np.zeros((0, 3), np.int64)]))
    t, windows = FIRST_SCALE, Windows(seq)
    while 2 * (3 * t - 1) <= longest:
        at, apart = _context_pairs(windows, owner, _selected(windows, runs, t), t)
        more, periods = _region_pairs(windows, runs, t)
        new = _proposed(seq, windows, np.concatenate([at, more]), np.concatenate([apart, periods]), longest)
        if len(new):
            runs = _smallest(np.concatenate([runs, new]))
        t *= 2
    runs = runs[runs[:, 1] - runs[:, 0] >= min_length]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    of = owner[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    runs = np.stack([runs[:, 0] - first[of], runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1) if len(runs) else runs
    bounds = np.searchsorted(of, np.arange(len(texts) + 1))
    return [runs[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without what any run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()])


def _exact_values(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return tk.mix(np.array([number.setdefault(w, len(number)) for w in words], np.uint64))


def _read_words(texts: pa.Array, keys: list, order: Callable | None) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """For each text its words and the runs among them."""
    for lo, hi, data, offsets in tk.chunks(texts):
        values, bounds = tk.words(data, offsets, tk.BYTE_VALUE)
        raw = data.tobytes()
        words, numbers = [], []
        for k in range(hi - lo):
            own = raw[offsets[k]:offsets[k + 1]].split()
            mine = values[bounds[k]:bounds[k + 1]]
            at = order(keys[lo + k], len(own)) if order else None
            words.append(own if at is None else [own[i] for i in at.tolist()])
            numbers.append(mine if at is None else mine[at])
        for own, runs in zip(words, find_runs(numbers, 1), strict=True):
            if any(own[s:s + n - q] != own[s + q:s + n] for s, n, q in runs.tolist()):  # two words with one hash
                runs = find_runs([_exact_values(own)], 1)[0]
            yield own, runs


def periodic_runs(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), min_length: int = MIN_LENGTH,
                  order: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """All runs of the white-space separated words of every whole text.

    Returns the columns ``keep``, n_words, runs (array of start, length, period; words count from
    0) and collapsed (the words that stay when every run keeps its first period only). ``order``
    may give, for the first column of ``keep`` and the number of words, the word numbers to read
    in place of 0, 1, 2 ...; None reads the text as it is.
    """
    source = docs.select(*keep, docs[text_col].alias("_text"))
    n_keep = len(keep)
    names = [*keep, "n_words", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                sizes, flat, bounds, texts = [], [], [0], []
                for words, runs in _read_words(batch.column(n_keep), batch.column(0).to_pylist(), order):
                    runs = runs[runs[:, 1] >= min_length]
                    sizes.append(len(words))
                    flat.append(runs)
                    bounds.append(bounds[-1] + len(runs))
                    texts.append(collapsed(words, runs).decode("utf-8", "surrogatepass"))
                rows = np.concatenate(flat) if flat else np.zeros((0, 3), np.int64)
                items = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(_RUN))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items)
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], pa.array(sizes, pa.int64()), lists, pa.array(texts, pa.string())], names=names)

    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return source.mapInArrow(run, schema)
