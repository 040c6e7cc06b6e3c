"""BAM as a Spark data source: split scans, index look-ups, records decoded in Arrow batches.

The option ``region`` (or a pushed filter on ``chr``, ``pos`` and ``end_pos``) is planned from the BAI
index beside the file: only blocks that can hold such reads are opened. Without an index, or
without a region, the file is cut into byte ranges; each task finds the first record of its
range by itself, so planning reads a header at most. Columns of a batch are cut out of the record
bytes by whole-array operations; no Python object is made per read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fragweave.sources.storage import File, Region, exists, region_of

SPLIT = 32 << 20
BATCH = 4 << 20
AHEAD = 1 << 20
# Letters of 4-bit bases and of CIGAR operations, in code order; index bins by level.
BAM_BASES = "=ACMGRSVTWYHKDBN"
BAM_OPS = "MIDNSHP=X"
BIN_LEVELS = ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681))
META_BIN = 37450
_MAGIC = b"\x1f\x8b\x08\x04"
_HEAD = np.dtype([("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_cigar", "<u2"), ("flag", "<u2"),
                  ("l_seq", "<i4"), ("mref", "<i4"), ("mpos", "<i4"), ("isize", "<i4")])
_LETTERS = np.frombuffer(BAM_BASES.encode(), np.uint8)
_OPS = np.frombuffer(BAM_OPS.encode(), np.uint8)
_ON_REFERENCE = np.array([o in "MDN=X" for o in BAM_OPS])
#: Bytes of a tag's value by its type; text and arrays have their own.
_TAG_SIZE = np.zeros(256, np.int64)
for _kinds, _n in ("AcC", 1), ("sS", 2), ("iIf", 4):
    _TAG_SIZE[list(_kinds.encode())] = _n


# blocks

def block_at(f: File, pos: int) -> tuple[bytes, int] | None:
    """Uncompressed block at a file offset and the offset of the next one; None at the end."""
    head = f.at(pos, 18)
    if len(head) < 18:
        return None
    if head[:4] != _MAGIC or head[12:14] != b"BC":
        raise ValueError(f"no BGZF block at {pos}")
    size = struct.unpack_from("<H", head, 16)[0] + 1
    return zlib.decompress(f.at(pos + 18, size - 26), -15), pos + size


def next_block(f: File, pos: int, limit: int) -> int | None:
    """First file offset from ``pos`` on that starts a block whose successor starts one too."""
    while pos < limit:
        window = f.at(pos, 1 << 17)
        i = window.find(_MAGIC)
        while i >= 0:
            try:
                block = block_at(f, pos + i)
                if block is not None and f.at(block[1], 4) in (b"", _MAGIC):
                    return pos + i
            except (ValueError, zlib.error, struct.error):
                pass
            i = window.find(_MAGIC, i + 1)
        if len(window) < 1 << 17:
            return None
        pos += len(window) - 3
    return None


class Header:
    """Contig names, and the block and the offset in it where the first record begins."""

    def __init__(self, f: File):
        self._file, self._data, self._next, starts = f, b"", 0, []
        self._starts = starts
        if self._need(8)[:4] != b"BAM\1":
            raise ValueError(f"{f.path} is not a BAM file")
        p = 8 + struct.unpack_from("<i", self._data, 4)[0]
        n_ref = struct.unpack_from("<i", self._need(p + 4), p)[0]
        p += 4
        self.names = []
        for _ in range(n_ref):
            size = struct.unpack_from("<i", self._need(p + 4), p)[0]
            self.names.append(self._need(p + 8 + size)[p + 4:p + 3 + size].decode())
            p += 8 + size
        begin, self.block = next((b, at) for b, at in reversed(starts) if b <= p)
        self.inside = p - begin

    def _need(self, n: int) -> bytes:
        while len(self._data) < n:
            got = block_at(self._file, self._next)
            if got is None:
                raise ValueError("truncated BAM header")
            self._starts.append((len(self._data), self._next))
            self._data += got[0]
            self._next = got[1]
        return self._data


# index

class Index:
    """A BAI index: per contig the chunks of each bin and the first offset of each 16 kb window.

    Offsets are virtual: file offset of a block times 65,536 plus the offset in it.
    """

    def __init__(self, f: File):
        raw, p = f.at(0, f.size), 8
        if raw[:4] != b"BAI\1":
            raise ValueError(f"{f.path} is not a BAI index")
        self.bins: list[dict[int, np.ndarray]] = []
        self.windows: list[np.ndarray] = []
        for _ in range(struct.unpack_from("<i", raw, 4)[0]):
            bins = {}
            n_bin = struct.unpack_from("<i", raw, p)[0]
            p += 4
            for _ in range(n_bin):
                number, n = struct.unpack_from("<Ii", raw, p)
                bins[number] = np.frombuffer(raw, "<u8", 2 * n, p + 8).astype(np.int64).reshape(n, 2)
                p += 8 + 16 * n
            bins.pop(META_BIN, None)
            n = struct.unpack_from("<i", raw, p)[0]
            self.bins.append(bins)
            self.windows.append(np.frombuffer(raw, "<u8", n, p + 4).astype(np.int64))
            p += 4 + 8 * n

    def ranges(self, ref: int, lo: int | None, hi: int | None) -> list[tuple[int, int]]:
        """Merged virtual ranges that hold every read of a contig overlapping the closed 1-based range."""
        bins, windows = self.bins[ref], self.windows[ref]
        begin = max((lo or 1) - 1, 0)
        if hi is None:
            wanted = list(bins)
        elif hi <= begin:
            return []
        else:
            wanted = [0] + [b for shift, first in BIN_LEVELS for b in range(first + (begin >> shift), first + ((hi - 1) >> shift) + 1)]
        least = int(windows[min(begin >> 14, len(windows) - 1)]) if len(windows) else 0
        if not bins:
            return []
        chunks = np.concatenate([np.zeros((0, 2), np.int64), *[bins[b] for b in wanted if b in bins]])
        out: list[tuple[int, int]] = []
        for a, b in sorted(chunks[chunks[:, 1] > least].tolist()):
            a = max(a, least)
            if out and a >> 16 <= out[-1][1] >> 16:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return out

    def starts(self, ref: int) -> np.ndarray:
        """Virtual offsets at which records of a contig are known to begin, ascending."""
        return np.unique(np.concatenate([self.windows[ref], *[c[:, 0] for c in self.bins[ref].values()]]))


def cut(ranges: list[tuple[int, int]], starts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges cut at record starts into parts of about ``size`` compressed bytes."""
    for a, b in ranges:
        while (b >> 16) - (a >> 16) > size:
            k = np.searchsorted(starts, a + (size << 16))
            if k == len(starts) or starts[k] >= b:
                break
            yield a, int(starts[k])
            a = int(starts[k])
        yield a, b


# records

def _looks_like_record(data: bytes, p: int, n_ref: int) -> int | None:
    """Size of a plausible record at ``p``, else None; used to find the first record of a split."""
    if p + 36 > len(data):
        return None
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mref, mpos, _ = struct.unpack_from("<iiiBBHHHiiii", data, p)
    if not (-1 <= ref < n_ref and -1 <= mref < n_ref and pos >= -1 and mpos >= -1 and l_name >= 2 and l_seq >= 0):
        return None
    body = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    if size < body or size > (1 << 26):
        return None
    if p + 36 + l_name <= len(data):
        name = data[p + 36: p + 36 + l_name]
        if name[-1] != 0 or not all(33 <= c <= 126 for c in name[:-1]):
            return None
    return size + 4


def _first_record(data: bytes, n_ref: int) -> int | None:
    """Offset in ``data`` from which three plausible records follow, or fewer that end exactly with it."""
    for p in range(len(data)):
        q, chain = p, 0
        while chain < 3:
            size = _looks_like_record(data, q, n_ref)
            if size is None:
                break
            q, chain = q + size, chain + 1
            if q == len(data):
                return p
        if chain == 3:
            return p
    return None


def _whole(data: bytes, p: int, limit: int) -> int:
    """Where the last complete record ends of those that begin before ``limit``."""
    while p + 4 <= len(data) and p < limit:
        n = struct.unpack_from("<i", data, p)[0]
        if p + 4 + n > len(data):
            break
        p += 4 + n
    return p


def records_between(f: File, a: int, b: int) -> Iterator[bytes]:
    """Bytes of the whole records between two virtual offsets."""
    at, skip, data = a >> 16, a & 0xFFFF, b""
    while at < b >> 16 or (at == b >> 16 and b & 0xFFFF):
        got = block_at(f, at)
        if got is None:
            break
        data += got[0][skip:b & 0xFFFF if at == b >> 16 else None]
        at, skip = got[1], 0
        end = _whole(data, 0, len(data))
        yield data[:end]
        data = data[end:]


def records_of_split(f: File, start: int, end: int) -> Iterator[bytes]:
    """Bytes of the whole records that begin in a block that begins inside [start, end)."""
    head = Header(f)
    if start <= head.block:
        if end <= head.block:
            return
        at, skip = head.block, head.inside
    else:
        at, skip = next_block(f, start, end), None
        if at is None or at >= end:
            return
    data, owned = b"", 0
    while (got := block_at(f, at)) is not None:
        mine = at < end
        data += got[0]
        if mine:
            owned = len(data)
        at = got[1]
        if skip is None:
            # The head of the split may be the tail of a record owned by the one before. More
            # is read until the place of the first record is certain or the file ends.
            if mine and at < min(end, f.size) and len(data) < 1 << 18:
                continue
            probe, ahead, want = data, at, 1 << 18
            while True:
                while len(probe) < want and (more := block_at(f, ahead)) is not None:
                    probe += more[0]
                    ahead = more[1]
                skip = _first_record(probe, len(head.names))
                if skip is not None or len(probe) < want:
                    break
                want *= 4
            if skip is None or skip >= owned:
                return
        p = _whole(data, skip, owned)
        yield data[skip:p]
        if p >= owned and not mine:
            return
        data, owned, skip = data[p:], max(owned - p, 0), 0
        if not mine and owned == 0:
            return


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1 ... for each span, one after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


def _strings(chars: np.ndarray, length: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    valid = None if missing is None else pa.array(~missing).buffers()[1]
    return pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(chars)), valid)


def _cigars(raw: np.ndarray, count: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """CIGAR strings, and the reference length of each."""
    number, op = raw >> 4, raw & 15
    upto = np.concatenate([[0], np.cumsum(np.where(_ON_REFERENCE[np.minimum(op, 8)], number, 0), dtype=np.int64)])
    last = np.cumsum(count)
    span = upto[last] - upto[last - count]
    digits = np.ones(len(raw), np.int64)
    for k in range(1, 10):
        digits += number >= 10 ** k
    width = digits + 1
    ends = np.cumsum(width)
    chars = np.zeros(int(width.sum()), np.uint8)
    chars[ends - 1] = _OPS[np.minimum(op, 8)]
    for k in range(int(digits.max(initial=0))):
        some = digits > k
        chars[ends[some] - 2 - k] = 48 + number[some] // 10 ** k % 10
    total = np.concatenate([[0], ends])
    length = total[last] - total[last - count]
    none = np.flatnonzero(length == 0)
    if len(none):  # a star where there are no operations
        chars = np.insert(chars, np.concatenate([[0], np.cumsum(length)])[none], ord("*"))
        length[none] = 1
    return _strings(chars, length), span


def _text_tags(buf: np.ndarray, start: np.ndarray, end: np.ndarray, wanted: tuple[bytes, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, length) of the values of text tags, length -1 where absent; all records walk their tags side by side."""
    zeros = np.flatnonzero(buf == 0)
    found = [(np.zeros(len(start), np.int64), np.full(len(start), -1)) for _ in wanted]
    at, live = start.copy(), np.flatnonzero(start + 3 <= end)
    while len(live):
        p = at[live]
        kind = buf[p + 2]
        size = _TAG_SIZE[kind]
        text = (kind == ord("Z")) | (kind == ord("H"))
        stop = zeros[np.minimum(np.searchsorted(zeros, p + 3), len(zeros) - 1)] if len(zeros) else p
        for tag, (where, length) in zip(wanted, found, strict=True):
            mine = text & (buf[p] == tag[0]) & (buf[p + 1] == tag[1])
            where[live[mine]], length[live[mine]] = p[mine] + 3, stop[mine] - p[mine] - 3
        size = np.where(text, stop - p - 2, size)
        lists = np.flatnonzero(kind == ord("B"))
        if len(lists):
            q = p[lists]
            n = buf[q[:, None] + np.arange(4, 8)].copy().view("<i4")[:, 0]
            size[lists] = 5 + _TAG_SIZE[buf[q + 3]] * n
        if (size == 0).any():
            raise ValueError("unknown type of a BAM tag")
        at[live] = p + 3 + size
        live = live[at[live] + 3 <= end[live]]
    return found


def decode(raw: bytes, names: list[str]) -> pa.RecordBatch:
    """A batch of the schema of ``BamSource`` from the bytes of whole records."""
    offsets, p = [], 0
    while p < len(raw):
        offsets.append(p)
        p += 4 + struct.unpack_from("<i", raw, p)[0]
    buf, at = np.frombuffer(raw, np.uint8), np.array(offsets, np.int64) + 4
    end = np.append(at[1:] - 4, len(raw))
    h = buf[at[:, None] + np.arange(32)].copy().view(_HEAD)[:, 0]
    l_name, n_cigar, l_seq = (h[c].astype(np.int64) for c in ("l_name", "n_cigar", "l_seq"))
    cigar_at = at + 32 + l_name
    seq_at = cigar_at + 4 * n_cigar
    qual_at = seq_at + (l_seq + 1) // 2
    tag_at = qual_at + l_seq
    cigars, span = _cigars(buf[_spans(cigar_at, 4 * n_cigar)].copy().view("<u4").astype(np.int64), n_cigar)
    place = _spans(np.zeros(len(at), np.int64), l_seq)
    packed = buf[np.repeat(seq_at, l_seq) + place // 2]
    bases = _LETTERS[np.where(place % 2 == 0, packed >> 4, packed & 15)]
    quals = buf[np.repeat(qual_at, l_seq) + place].astype(np.int32)
    unknown = np.zeros(len(at), bool)
    some = l_seq > 0
    unknown[some] = buf[qual_at[some]] == 0xFF
    quals[np.repeat(unknown, l_seq)] = 0
    tags = [_strings(buf[_spans(where, np.maximum(length, 0))], np.maximum(length, 0), length < 0) for where, length in _text_tags(buf, tag_at, end, (b"MD", b"MC"))]
    contigs = pa.array([*names, "*"], pa.string()).take(pa.array(np.where(h["ref"] < 0, len(names), h["ref"])))
    number = lambda x: pa.array(x.astype(np.int32))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(l_seq)]).astype(np.int32)), pa.array(quals))
    columns = [_strings(buf[_spans(at + 32, l_name - 1)], l_name - 1), number(h["flag"]), contigs, number(h["pos"] + 1), number(h["mapq"]), cigars,
               number(h["mpos"] + 1), number(h["isize"]), _strings(bases, l_seq), lists, *tags, number(h["pos"] + span)]
    return pa.RecordBatch.from_arrays(columns, names=COLUMNS)


COLUMNS = ["read_name", "flag", "chr", "pos", "mapq", "cigar", "mate_pos", "insert_size", "bases", "quals", "md", "mc", "end_pos"]


@dataclass
class ByteRange(InputPartition):
    start: int
    end: int


@dataclass
class VirtualRanges(InputPartition):
    ranges: list[tuple[int, int]]


class BamReader(DataSourceReader):
    def __init__(self, path: str, index: str | None, split: int, region: str | None = None):
        self.source, self.split, self.region = path, split, Region.parsed(region)
        self.index = index or (path + ".bai")

    def partitions(self):
        # the index does not know reads without a place
        if self.region.names is not None and "*" not in self.region.names and exists(self.index):
            return self._from_index()
        with File(self.source) as f:
            return [ByteRange(a, min(a + self.split, f.size)) for a in range(0, f.size, self.split)] or [ByteRange(0, 0)]

    def _from_index(self):
        with File(self.source) as f, File(self.index) as i:
            names, index = Header(f).names, Index(i)
        parts = [r for ref, name in enumerate(names) if self.region.wants(name) and ref < len(index.bins)
                 for r in cut(index.ranges(ref, self.region.lo, self.region.hi), index.starts(ref), self.split)]
        out, size = [VirtualRanges([])], 0
        for a, b in parts:
            if size >= self.split:
                out.append(VirtualRanges([]))
                size = 0
            out[-1].ranges.append((a, b))
            size += (b >> 16) - (a >> 16) + (1 << 16)
        return out

    def read(self, part):
        with File(self.source, AHEAD if isinstance(part, ByteRange) else 0) as f:
            if isinstance(part, ByteRange):
                pieces = records_of_split(f, part.start, part.end) if part.end else iter(())
            else:
                pieces = (x for a, b in part.ranges for x in records_between(f, a, b))
            names, waiting, size = None, [], 0
            for piece in pieces:
                if piece:
                    waiting.append(piece)
                    size += len(piece)
                if size >= BATCH:
                    names = names or Header(f).names
                    yield decode(b"".join(waiting), names)
                    waiting, size = [], 0
            if waiting:
                yield decode(b"".join(waiting), names or Header(f).names)


class PushingBamReader(BamReader):
    """Takes filters from Spark; see ``binary`` for why this is not the default."""

    def pushFilters(self, filters):
        self.region = self.region.within(region_of(filters, "chr", "pos", "end_pos", slack=1))
        return filters


class BamSource(DataSource):
    """Aligned reads in the layout of ``read_sam``; options ``split`` (bytes a task), ``index`` (path of the BAI file), ``region``."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return ("read_name string, flag int, chr string, pos int, mapq int, cigar string, mate_pos int, insert_size int, bases string, "
                "quals array<int>, md string, mc string, end_pos int")

    def reader(self, schema):
        kind = PushingBamReader if self.options.get("push") == "true" else BamReader
        return kind(self.options["path"], self.options.get("index"), int(self.options.get("split", SPLIT)), self.options.get("region"))
