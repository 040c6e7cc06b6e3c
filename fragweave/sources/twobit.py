"""2bit genomes as a Spark data source of fixed chunks.

Planning reads the directory and the lengths of the contigs of the region asked for (option ``region``
or pushed filters on ``chr`` and ``chunk_start``); only its chunks become tasks. A task reads the packed bases of
its chunks and unpacks them four at a time through a table.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fragweave.sources.storage import File, Region, region_of

# Letters of 2-bit bases in code order, and the mark of a little-endian file.
TWOBIT_BASES = "TCAG"
MAGIC = 0x1A412743
_FOUR = np.array([[ord(TWOBIT_BASES[b >> s & 3]) for s in (6, 4, 2, 0)] for b in range(256)], np.uint8)


@dataclass
class ContigRange(InputPartition):
    name: str
    offset: int
    start: int
    end: int


def directory(f: File) -> list[tuple[str, int]]:
    """Contig names and where their records begin."""
    magic, _, count, _ = struct.unpack("<IIII", f.at(0, 16))
    if magic != MAGIC:
        raise ValueError("not a little-endian 2bit file")
    raw, p, out = f.at(16, count * 260), 0, []
    for _ in range(count):
        size = raw[p]
        out.append((raw[p + 1:p + 1 + size].decode(), struct.unpack_from("<I", raw, p + 1 + size)[0]))
        p += 5 + size
    return out


def unpacked(f: File, dna: int, a: int, b: int, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Bases a to b of a contig whose packed bases begin at ``dna``; unknown ones, in ascending blocks, are N."""
    packed = np.frombuffer(f.at(dna + a // 4, (b + 3) // 4 - a // 4), np.uint8)
    bases = _FOUR[packed].ravel()[a % 4:a % 4 + b - a]
    for k in range(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b))):
        bases[max(starts[k] - a, 0):min(ends[k] - a, b - a)] = ord("N")
    return bases.tobytes()


class TwoBitReader(DataSourceReader):
    def __init__(self, path: str, chunk: int, per_task: int, region: str | None = None):
        self.source, self.chunk, self.per_task, self.region = path, chunk, per_task, Region.parsed(region)

    def partitions(self):
        parts, step = [], self.chunk * self.per_task
        with File(self.source) as f:
            for name, offset in directory(f):
                if not self.region.wants(name):
                    continue
                size = struct.unpack("<I", f.at(offset, 4))[0]
                low = max(self.region.lo or 0, 0) // self.chunk * self.chunk
                high = size if self.region.hi is None else min(size, (self.region.hi // self.chunk + 1) * self.chunk)
                parts += [ContigRange(name, offset, a, min(a + step, high)) for a in range(low, high, step)]
        return parts or [ContigRange("", 0, 0, 0)]

    def read(self, part: ContigRange) -> Iterator[pa.RecordBatch]:
        if part.start >= part.end:
            return
        with File(self.source) as f:
            n = struct.unpack("<I", f.at(part.offset + 4, 4))[0]
            blocks = np.frombuffer(f.at(part.offset + 8, 8 * n), "<u4").astype(np.int64).reshape(2, n)
            starts, ends = blocks[0], blocks[0] + blocks[1]
            m = struct.unpack("<I", f.at(part.offset + 8 + 8 * n, 4))[0]
            dna = part.offset + 16 + 8 * n + 8 * m
            for a in range(part.start, part.end, self.chunk * 16):
                at = list(range(a, min(a + self.chunk * 16, part.end), self.chunk))
                bases = [unpacked(f, dna, x, min(x + self.chunk, part.end), starts, ends).decode("ascii") for x in at]
                yield pa.RecordBatch.from_arrays([pa.array([part.name] * len(at)), pa.array(at, pa.int64()), pa.array(bases)], names=["chr", "chunk_start", "bases"])


class PushingTwoBitReader(TwoBitReader):
    """Takes filters from Spark; see ``binary`` for why this is not the default."""

    def pushFilters(self, filters):
        self.region = self.region.within(region_of(filters, "chr", "chunk_start", "chunk_start"))
        return filters


class TwoBitSource(DataSource):
    """Genome chunks chr, chunk_start, bases (upper case); options ``chunk``, ``per_task`` and ``region`` (of chunk starts)."""

    @classmethod
    def name(cls) -> str:
        return "twobit"

    def schema(self) -> str:
        return "chr string, chunk_start long, bases string"

    def reader(self, schema):
        kind = PushingTwoBitReader if self.options.get("push") == "true" else TwoBitReader
        return kind(self.options["path"], int(self.options.get("chunk", 1 << 16)), int(self.options.get("per_task", 256)), self.options.get("region"))
