"""bigWig as a Spark data source of closed 1-based intervals.

Planning walks the file's R-tree and leaves out branches outside the region asked for (option ``region``
or pushed filters on ``chr``, ``lo`` and ``hi``); tasks get the blocks of the leaves and decode a block into columns at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fragweave.sources.storage import File, Region, region_of

# Mark of a little-endian file, size of the index header, layouts of the three kinds of sections.
MAGIC = 0x888FFC26
INDEX_HEADER = 48
_KINDS = {1: np.dtype([("lo", "<u4"), ("hi", "<u4"), ("v", "<f4")]), 2: np.dtype([("lo", "<u4"), ("v", "<f4")]), 3: np.dtype([("v", "<f4")])}
_LEAF = np.dtype([("c0", "<u4"), ("b0", "<u4"), ("c1", "<u4"), ("b1", "<u4"), ("offset", "<u8"), ("size", "<u8")])
_BRANCH = np.dtype([("c0", "<u4"), ("b0", "<u4"), ("c1", "<u4"), ("b1", "<u4"), ("offset", "<u8")])


@dataclass
class WigBlocks(InputPartition):
    names: dict[int, str]
    blocks: list[tuple[int, int]]
    packed: bool


def contig_names(f: File, tree: int) -> dict[int, str]:
    _, _, key, _, _, _ = struct.unpack("<IIIIQQ", f.at(tree, 32))
    out, todo = {}, [tree + 32]
    while todo:
        at = todo.pop()
        leaf, _, count = struct.unpack("<BBH", f.at(at, 4))
        raw = f.at(at + 4, count * (key + 8))
        for k in range(count):
            p = k * (key + 8)
            if leaf:
                out[struct.unpack_from("<I", raw, p + key)[0]] = raw[p:p + key].rstrip(b"\0").decode()
            else:
                todo.append(struct.unpack_from("<Q", raw, p + key)[0])
    return out


def blocks_of(f: File, index: int, wanted: list[int] | None, lo: int | None, hi: int | None) -> list[tuple[int, int]]:
    """(offset, size) of the data blocks that may hold a wanted contig's positions lo to hi (closed, 1-based), by offset."""

    def may_hold(node: np.ndarray) -> np.ndarray:
        if wanted is None:
            return np.ones(len(node), bool)
        hit = np.zeros(len(node), bool)
        for c in wanted:
            inside = (node["c0"] <= c) & (c <= node["c1"])
            if hi is not None:
                inside &= (node["c0"] < c) | (node["b0"] < hi)
            if lo is not None:
                inside &= (node["c1"] > c) | (node["b1"] >= lo)
            hit |= inside
        return hit

    out, todo = [], [index + INDEX_HEADER]
    while todo:
        at = todo.pop()
        leaf, _, count = struct.unpack("<BBH", f.at(at, 4))
        kind = _LEAF if leaf else _BRANCH
        node = np.frombuffer(f.at(at + 4, count * kind.itemsize), kind)
        node = node[may_hold(node)]
        if leaf:
            out += list(zip(node["offset"].tolist(), node["size"].tolist(), strict=True))
        else:
            todo += node["offset"].tolist()
    return sorted(out)


def intervals(raw: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Contig number, first and last positions and values of a data block."""
    contig, start, _, step, span, kind, _, count = struct.unpack_from("<IIIIIBBH", raw, 0)
    rows = np.frombuffer(raw, _KINDS[kind], count, 24)
    lo = rows["lo"].astype(np.int64) if kind < 3 else start + np.arange(count, dtype=np.int64) * step
    hi = rows["hi"].astype(np.int64) if kind == 1 else lo + span
    return contig, lo + 1, hi, rows["v"].astype(np.float64)


class BigWigReader(DataSourceReader):
    def __init__(self, path: str, per_task: int, region: str | None = None):
        self.source, self.per_task, self.region = path, per_task, Region.parsed(region)

    def partitions(self):
        with File(self.source) as f:
            magic, _, _, tree, _, index, _, _, _, _, buffer, _ = struct.unpack("<IHHQQQHHQQIQ", f.at(0, 64))
            if magic != MAGIC:
                raise ValueError("not a little-endian bigWig file")
            names = contig_names(f, tree)
            wanted = None if self.region.names is None else [c for c, name in names.items() if self.region.wants(name)]
            blocks = blocks_of(f, index, wanted, self.region.lo, self.region.hi)
        return [WigBlocks(names, blocks[i:i + self.per_task], buffer > 0) for i in range(0, len(blocks), self.per_task)] or [WigBlocks({}, [], False)]

    def read(self, part: WigBlocks) -> Iterator[pa.RecordBatch]:
        with File(self.source) as f:
            for offset, size in part.blocks:
                raw = f.at(offset, size)
                contig, lo, hi, value = intervals(zlib.decompress(raw) if part.packed else raw)
                name = pa.DictionaryArray.from_arrays(np.zeros(len(lo), np.int32), [part.names[contig]]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(lo), pa.array(hi), pa.array(value)], names=["chr", "lo", "hi", "value"])


class PushingBigWigReader(BigWigReader):
    """Takes filters from Spark; see ``binary`` for why this is not the default."""

    def pushFilters(self, filters):
        self.region = self.region.within(region_of(filters, "chr", "lo", "hi"))
        return filters


class BigWigSource(DataSource):
    """Closed 1-based intervals chr, lo, hi, value; options ``per_task`` (data blocks a partition) and ``region``."""

    @classmethod
    def name(cls) -> str:
        return "bigwig"

    def schema(self) -> str:
        return "chr string, lo long, hi long, value double"

    def reader(self, schema):
        kind = PushingBigWigReader if self.options.get("push") == "true" else BigWigReader
        return kind(self.options["path"], int(self.options.get("per_task", 2000)), self.options.get("region"))
