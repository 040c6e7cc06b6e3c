"""Vectorised tokens and shingles over Arrow string batches.

Texts are handled as UTF-8 bytes in chunks of about a megabyte. A word's hash is the sum of a
random 64-bit value per byte times a power of an odd number, taken from prefix sums, then mixed;
everything wraps modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0xD1342543DE82EF95
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the splitmix64 finaliser)."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd factor and of its inverse, 0 .. n - 1."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 2 * CHUNK)
        for name, factor in (("up", _ODD), ("down", _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


BYTE_VALUE = mix(np.arange(256, dtype=np.uint64) + np.uint64(7))
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, row offsets into them); null counts as empty."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; a run never crosses a row."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """A hash of the bytes of each span, independent of where it stands."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value[data] * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def words(data: np.ndarray, offsets: np.ndarray, value: np.ndarray = LOWER_VALUE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words and, for each row, where its words begin in them."""
    start, end = runs(NOT_SPACE[data], offsets)
    return span_hashes(data, start, end, value), np.searchsorted(start, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; a row of fewer than k words is one shingle, an empty one has none."""
    seed = np.uint64(k)
    whole = np.zeros(0, np.uint64)
    if len(hashes) >= k:
        whole = mix(hashes[:len(hashes) - k + 1] + seed)
        for j in range(1, k):
            whole = mix(whole * np.uint64(3) + hashes[j:len(hashes) - k + 1 + j])
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            own = np.sort(whole[a:b - k + 1])
            new = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=new[1:])
            out.append(own[new])
        elif b > a:
            h = mix(hashes[a:a + 1] + np.uint64(b - a))
            for j in range(a + 1, b):
                h = mix(h * np.uint64(3) + hashes[j:j + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
