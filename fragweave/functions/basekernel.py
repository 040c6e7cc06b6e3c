"""Operations on whole Arrow batches of base strings: k-mer counts and the merging of mates.

A column of strings is seen as its bytes and row offsets; work runs over all bases of a batch at
once, and results go back as buffers. No Python object is made per base or per read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: 2-bit codes of the bases in the order of k-mer names; every other letter has none.
BASES = b"ACGT"
_CODE = np.full(256, -1, np.int64)
_CODE[list(BASES)] = _CODE[list(BASES.lower())] = range(4)
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32
ROW = 1 << 34  # above any position inside a contig
TABLE = 1 << 22  # k-mers of a slice are counted in a table of so many entries at most


class Flat(NamedTuple):
    """Bytes of a string column, where each row begins in them, and which rows are null (and count as empty)."""

    data: np.ndarray
    offsets: np.ndarray
    null: np.ndarray

    @property
    def length(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.null)), self.length)


def flat(column: pa.Array) -> Flat:
    null = np.asarray(column.is_null())
    column = column.fill_null("").cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Flat(data[offsets[0]:offsets[-1]], offsets - offsets[0], null)


def slices(whole: pa.RecordBatch, text: int, rows: int = 2000, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows and ``size`` bytes of the text column of that number; a longer text is a part of its own."""
    ends, lo = flat(whole.column(text)).offsets, 0
    while lo < whole.num_rows:
        hi = min(lo + rows, int(np.searchsorted(ends, ends[lo] + size, "right")) - 1)
        hi = max(hi, lo + 1)
        yield whole.slice(lo, hi - lo)
        lo = hi


def flat_numbers(column: pa.Array) -> np.ndarray:
    """All numbers of a list column, one after the other."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1 ... for each span, one after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


def strings(data: np.ndarray, length: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    valid = pa.array(~null).buffers()[1] if null is not None and null.any() else None
    return pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)), valid)


def pieces(texts: Flat, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, place in it and letters of consecutive pieces of ``size`` letters, each with the ``overlap`` letters after it."""
    count = -(-texts.length // size)
    row = np.repeat(np.arange(len(texts.null)), count)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * size
    length = np.minimum(texts.length[row] - at, size + overlap)
    return row, at, strings(texts.data[spans(texts.offsets[row] + at, length)], length)


_DIGIT = np.full(256, ord("5"), np.uint8)
_DIGIT[list(b"ATCG")] = _DIGIT[list(b"atcg")] = list(b"1234")


def base_digits(texts: Flat) -> np.ndarray:
    """A1 T2 C3 G4, anything else 5, as letters."""
    return _DIGIT[texts.data]


# k-mers

class KmerCounts(NamedTuple):
    """One row for each k-mer of each sequence, and the windows each k-mer length has in it."""

    row: np.ndarray
    code: np.ndarray  # place of the k-mer among all of its length
    kmer: pa.Array
    n: np.ndarray
    windows: np.ndarray


def _letters(code: np.ndarray, k: int) -> np.ndarray:
    letters = np.empty((len(code), k), np.uint8)
    for j in range(k - 1, -1, -1):
        letters[:, j] = np.frombuffer(BASES, np.uint8)[code % 4]
        code = code // 4
    return letters


def kmer_counts(seqs: Flat, reverse: np.ndarray | None, first: int, last: int) -> Iterator[KmerCounts]:
    """Counts of all k-mers of length ``first`` to ``last``, one length after the other.

    Codes roll: a window's code is four times that of the window one shorter, plus the next base. A
    letter other than A, C, G, T rules out the windows over it, which still count as windows. Rows
    marked ``reverse`` are read as their reverse complement.
    """
    n, row, end = len(seqs.data), seqs.row, np.repeat(seqs.offsets[1:], seqs.length)
    base = _CODE[seqs.data]
    if reverse is not None and reverse.any():
        turned = np.repeat(reverse, seqs.length)
        base = base[np.where(turned, np.repeat(seqs.offsets[:-1], seqs.length) + end - 1 - np.arange(n), np.arange(n))]
        base = np.where((base >= 0) & turned, 3 - base, base)
    left = end - np.arange(n)
    code, good = np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(1, last + 1):
        ahead = np.concatenate([base[k - 1:], np.full(min(k - 1, n), -1)])
        good &= (ahead >= 0) & (left >= k)
        code = code * 4 + ahead
        if k < first:
            continue
        key = row[good] * 4 ** k + code[good]
        if len(seqs.null) * 4 ** k <= TABLE:
            table = np.bincount(key)
            key = np.flatnonzero(table)
            count = table[key]
        else:
            key, count = np.unique(key, return_counts=True)
        number, of = key % 4 ** k, key // 4 ** k
        letters = _letters(np.arange(4 ** k), k)[number] if 4 ** k < len(number) else _letters(number, k)
        windows = np.maximum(seqs.length - k + 1, 0)[of]
        yield KmerCounts(of, number, strings(letters.ravel(), np.full(len(key), k)), count, windows)


def kmer_percentages(seqs: Flat, k: int) -> np.ndarray:
    """Percentage of every k-mer among the windows of each sequence: a row a sequence, a column a k-mer."""
    out = np.zeros((len(seqs.null), 4 ** k))
    for found in kmer_counts(seqs, None, k, k):
        out[found.row, found.code] = 100.0 * found.n / found.windows
    return out


# calls of cytosines

class ReadCalls(NamedTuple):
    """Every base over a cytosine of its molecule that is converted or kept, in order."""

    row: np.ndarray
    offset: np.ndarray  # in the read
    qual: np.ndarray
    methylated: np.ndarray
    cpg: np.ndarray  # inside a CpG


def read_calls(ref: Flat, bases: Flat, quals: np.ndarray, negative: np.ndarray) -> ReadCalls:
    """On the minus strand the G is inspected. The outermost base has no neighbour to tell its context, so it is no call outside a CpG."""
    if not (len(bases.data) == len(ref.data) == len(quals) and (bases.length == ref.length).all()):
        raise ValueError("bases, reference and qualities of a read must be equally long")
    c, g, a, t = b"CGAT"
    r, b, row = _UPPER[ref.data], _UPPER[bases.data], ref.row
    minus = negative[row]
    at = np.flatnonzero(np.where(minus, (r == g) & ((b == g) | (b == a)), (r == c) & ((b == c) | (b == t))))
    row, minus = row[at], minus[at]
    beside = at + np.where(minus, -1, 1)
    inside = (beside >= ref.offsets[row]) & (beside < ref.offsets[row + 1])
    cpg = inside & (r[np.where(inside, beside, at)] == np.where(minus, c, g))
    keep = cpg | inside
    at, row, minus, cpg = at[keep], row[keep], minus[keep], cpg[keep]
    return ReadCalls(row, at - ref.offsets[row], quals[at], b[at] == np.where(minus, g, c), cpg)


def states(ref: Flat, bases: Flat, quals: np.ndarray, negative: np.ndarray, min_base_q: int) -> np.ndarray:
    """1 at a methylated, 0 at an unmethylated call in a CpG of ``min_base_q`` at least, -1 at every other base."""
    x = read_calls(ref, bases, quals, negative)
    keep = x.cpg & (x.qual >= min_base_q)
    out = np.full(len(ref.data), -1, np.int8)
    out[ref.offsets[x.row[keep]] + x.offset[keep]] = x.methylated[keep]
    return out


def cpg_marks(ref: Flat, negative: np.ndarray) -> np.ndarray:
    """True at the C of every CpG, for negative rows at its G."""
    first = pattern_starts(ref, b"CG")
    out = np.zeros(len(ref.data), bool)
    out[first + negative[ref.row[first]]] = True
    return out


def pattern_starts(seqs: Flat, pattern: bytes) -> np.ndarray:
    """Where the pattern begins in the data, overlapping ones included; none reaches into the next row."""
    n = max(len(seqs.data) - len(pattern) + 1, 0)
    hit = np.ones(n, bool)
    for j, letter in enumerate(pattern):
        hit &= _UPPER[seqs.data[j:j + n]] == letter
    at = np.flatnonzero(hit)
    return at[at + len(pattern) <= seqs.offsets[np.searchsorted(seqs.offsets, at, "right")]]


def around(values: np.ndarray, texts: Flat, first: np.ndarray, step: np.ndarray, width: int, empty: int) -> np.ndarray:
    """For each row ``width`` values from its place ``first`` on, in steps of 1 or -1; ``empty`` outside the row."""
    at = first[:, None] + step[:, None] * np.arange(width)
    inside = (at >= 0) & (at < texts.length[:, None])
    if not len(values):
        return np.full(at.shape, empty, values.dtype)
    return np.where(inside, values[np.where(inside, at + texts.offsets[:-1, None], 0)], empty).astype(values.dtype)


# mates

class Merged(NamedTuple):
    """Merged mates, base by base."""

    ref: np.ndarray
    bases: np.ndarray
    quals: np.ndarray
    length: np.ndarray

    def flat(self, letters: np.ndarray) -> Flat:
        return Flat(letters, np.concatenate([[0], np.cumsum(self.length)]), np.zeros(len(self.length), bool))


def merge_plain(ref: tuple[Flat, Flat], bases: tuple[Flat, Flat], quals: tuple[np.ndarray, np.ndarray], shift: np.ndarray,
                first_is_left: np.ndarray, gap_extra: int = 2) -> Merged:
    """Mates without gaps, the right one ``shift`` bases behind the left one, as ``reads.merged_fragment`` merges them.

    The left mate is laid down whole. Where the other differs with a better quality, it wins, on ties the first end of the
    pair. Then comes what the right mate has beyond the left one; N of quality 0 fill the stretch between mates that do not meet.
    """
    for r, b, q in zip(ref, bases, quals, strict=True):
        if not (len(b.data) == len(r.data) == len(q) and (b.length == r.length).all()):
            raise ValueError("bases, reference and qualities of a read must be equally long")
    left, right = bases
    (n1, n2), far = (left.length, right.length), len(left.data)
    letters = np.concatenate([left.data, right.data, np.frombuffer(b"N", np.uint8)])
    below = np.concatenate([ref[0].data, ref[1].data, np.frombuffer(b"N", np.uint8)])
    q = np.concatenate([*quals, [0]])
    row, own = left.row, np.arange(far)
    over = own - left.offsets[row] - shift[row]
    shared = (over >= 0) & (over < n2[row])
    across = np.where(shared, far + right.offsets[row] + over, far)
    better = np.where(first_is_left[row], q[own] < q[across], q[own] <= q[across])
    own = np.where(shared & (_UPPER[letters[own]] != _UPPER[letters[across]]) & better, across, own)
    gap = np.where(shift >= n1, np.maximum(shift - n1 + gap_extra, 0), 0)
    skip = np.maximum(n1 - shift, 0)
    tail = np.maximum(n2 - skip, 0)
    total = n1 + gap + tail
    begin = np.cumsum(total) - total
    out = np.full(int(total.sum()), len(letters) - 1)
    out[spans(begin, n1)] = own
    out[spans(begin + n1 + gap, tail)] = spans(far + right.offsets[:-1] + skip, tail)
    return Merged(below[out], letters[out], q[out], total)


def reference_steps(cigar: str) -> tuple[np.ndarray, int]:
    """For each read base how far behind the alignment's start it lies (-1: inserted or clipped), and the reference length."""
    out, at = [], 0
    for n, op in re.findall(r"([0-9]+)([MIDNSHP=X])", cigar):
        n = int(n)
        if op in "M=X":
            out.append(np.arange(at, at + n))
            at += n
        elif op in "IS":
            out.append(np.full(n, -1))
        elif op in "DN":
            at += n
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), at


class Mate(NamedTuple):
    """One mate of every pair of a batch, base by base."""

    bases: Flat
    ref: np.ndarray
    quals: np.ndarray
    key: np.ndarray  # row and reference position of a base; -1 where it has none
    end: np.ndarray  # last reference position of each mate


def without(column: pa.Array, skip: np.ndarray) -> pa.Array:
    """The column with rows to skip as nulls. Rows are taken by number: ``if_else`` misreads text columns that are slices."""
    return column.take(pa.array(np.arange(len(column)), mask=skip))


def mate(start: np.ndarray, cigar: pa.Array, ref: pa.Array, bases: pa.Array, quals: pa.Array, skip: np.ndarray) -> Mate:
    """Reference letters and qualities stand under every base, so all three are equally long; rows to skip are empty."""
    b, r = flat(without(bases, skip)), flat(without(ref, skip))
    q = flat_numbers(without(quals, skip))
    known = {c: reference_steps(c) for c in without(cigar, skip).unique().to_pylist() if c is not None}
    steps = [(np.zeros(0, np.int64), 0) if s else known[c] for c, s in zip(cigar.to_pylist(), skip.tolist(), strict=True)]
    step = np.concatenate([s for s, _ in steps]) if steps else np.zeros(0, np.int64)
    if not (len(b.data) == len(r.data) == len(q) == len(step) and (b.length == [len(s) for s, _ in steps]).all() and (b.length == r.length).all()):
        raise ValueError("bases, reference, qualities and CIGAR of a read must be equally long")
    key = np.where(step >= 0, b.row * ROW + np.repeat(start, b.length) + step, -1)
    return Mate(b, r.data, q, key, start + np.array([n for _, n in steps], np.int64) - 1)


def _partners(key: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each base the place of the other mate's base at its position, -1 where there is none."""
    placed = np.flatnonzero(other >= 0)
    if not len(placed) or not len(key):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(other[placed], key), len(placed) - 1)
    return np.where((key >= 0) & (other[placed][at] == key), placed[at], -1)


def merge_mates(left: Mate, right: Mate, right_start: np.ndarray, first_is_left: np.ndarray, gap_extra: int = 2) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Merged reference, bases and qualities of every pair.

    The first end is laid down whole. Where the mates share a reference position and differ, the
    better quality wins, on ties the first end. Of the second end only what lies beyond the last
    shared position is added, insertions included. Mates that share no position are joined by N, as
    many as lie between them and ``gap_extra``; a base of the gap has quality 0.
    """
    n, far = len(first_is_left), len(left.bases.data)
    data = np.concatenate([left.bases.data, right.bases.data, np.frombuffer(b"N", np.uint8)])
    ref = np.concatenate([left.ref, right.ref, np.frombuffer(b"N", np.uint8)])
    quals = np.concatenate([left.quals, right.quals, [0]])
    to_right, to_left = _partners(left.key, right.key), _partners(right.key, left.key)
    partner = np.concatenate([np.where(to_right >= 0, to_right + far, -1), to_left])
    starts = left.bases.offsets[:-1], right.bases.offsets[:-1] + far
    lead, other = np.where(first_is_left, starts[0], starts[1]), np.where(first_is_left, starts[1], starts[0])
    lead_n = np.where(first_is_left, left.bases.length, right.bases.length)
    other_n = np.where(first_is_left, right.bases.length, left.bases.length)
    own = spans(lead, lead_n)
    row, across = np.repeat(np.arange(n), lead_n), partner[own]
    shared = across >= 0
    differ = shared & (_UPPER[data[own]] != _UPPER[data[across]]) & (quals[own] < quals[across])
    own = np.where(differ, across, own)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    np.minimum.at(low, row[shared], across[shared])
    np.maximum.at(high, row[shared], across[shared])
    meet = high >= 0
    gap = np.where(meet, 0, np.maximum(right_start - left.end - 1 + gap_extra, 0))
    head_n = np.where(first_is_left, 0, np.where(meet, low - other, other_n))
    tail_at = np.where(meet, high + 1, other)
    tail_n = np.where(first_is_left, other + other_n - tail_at, 0)
    total = head_n + gap + lead_n + tail_n
    begin = np.cumsum(total) - total
    out = np.full(int(total.sum()), len(data) - 1)
    out[spans(begin, head_n)] = spans(other, head_n)
    own_at = begin + head_n + np.where(first_is_left, 0, gap)
    out[spans(own_at, lead_n)] = own
    out[spans(begin + total - tail_n, tail_n)] = spans(tail_at, tail_n)
    offsets = pa.array(np.concatenate([[0], np.cumsum(total)]).astype(np.int32))
    return strings(ref[out], total), strings(data[out], total), pa.ListArray.from_arrays(offsets, pa.array(quals[out].astype(np.int32)))
