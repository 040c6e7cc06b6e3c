"""Random access to files in any store that Arrow knows (local, hdfs, s3, gs, abfs), and pushed-down regions.

Executors open files by themselves, so a path needs no copy on any machine; a plain path is local.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from pyarrow import fs
from pyspark.sql import datasource as ds


class File:
    """A file read at given offsets. ``total_read`` counts the bytes all files of this process gave.

    With ``ahead`` at least so many bytes are fetched at a time and served from memory, for scans.
    """

    total_read = 0

    def __init__(self, path: str, ahead: int = 0):
        if "://" in path and not path.startswith("file:"):
            store, inner = fs.FileSystem.from_uri(path)
        else:
            inner = path.removeprefix("file:")
            store, inner = fs.LocalFileSystem(), "/" + inner.lstrip("/") if inner.startswith("/") else inner
        self.path, self._file = path, store.open_input_file(inner)
        self.size, self._ahead, self._from, self._held = self._file.size(), ahead, 0, b""

    def at(self, pos: int, n: int) -> bytes:
        """Up to n bytes from an offset; fewer only at the end of the file."""
        n = max(0, min(n, self.size - pos))
        if not self._from <= pos <= pos + n <= self._from + len(self._held):
            self._from, self._held = pos, self._file.read_at(max(n, min(self._ahead, self.size - pos)), pos) if n else b""
            File.total_read += len(self._held)
        return self._held[pos - self._from:pos - self._from + n]

    def __enter__(self) -> File:
        return self

    def __exit__(self, *_: object) -> None:
        self._file.close()


def exists(path: str) -> bool:
    try:
        File(path)._file.close()
    except OSError:
        return False
    return True


class Region(NamedTuple):
    """Contigs asked for (None: all) and the closed range of positions, each end None where open."""

    names: frozenset[str] | None = None
    lo: int | None = None
    hi: int | None = None

    def wants(self, name: str) -> bool:
        return self.names is None or name in self.names

    def within(self, other: Region) -> Region:
        """What both regions hold."""
        names = other.names if self.names is None else self.names if other.names is None else self.names & other.names
        bounds = [[x for x in pair if x is not None] for pair in ((self.lo, other.lo), (self.hi, other.hi))]
        return Region(names, max(bounds[0], default=None), min(bounds[1], default=None))

    @classmethod
    def parsed(cls, text: str | None) -> Region:
        """From ``contig`` or ``contig:first-last`` (closed, 1-based); None or an empty text means everything."""
        if not text:
            return cls()
        found = re.fullmatch(r"(.+):(\d+)-(\d+)", text)
        return cls(frozenset([found[1]]), int(found[2]), int(found[3])) if found else cls(frozenset([text]))


def region_of(filters: Iterable[ds.Filter], chrom: str, first: str, last: str, slack: int = 0) -> Region:
    """The region that rows passing all the filters must overlap.

    ``first`` and ``last`` name a row's first and last position; a row may end ``slack`` before it
    begins. Filters of other shapes are left to Spark, which evaluates all of them again anyway.
    """
    names: frozenset[str] | None = None
    low: list[int] = []
    high: list[int] = []
    for f in filters:
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if column == chrom and isinstance(f, (ds.EqualTo, ds.EqualNullSafe, ds.In)):
            own = frozenset(f.value if isinstance(f, ds.In) else [f.value])
            names = own if names is None else names & own
        if column not in (first, last) or not isinstance(getattr(f, "value", None), int):
            continue
        x = f.value
        if isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.EqualTo)):
            low.append(x + isinstance(f, ds.GreaterThan) - (slack if column == first else 0))
        if isinstance(f, (ds.LessThan, ds.LessThanOrEqual, ds.EqualTo)):
            high.append(x - isinstance(f, ds.LessThan) + (slack if column == last else 0))
    return Region(names, max(low, default=None), min(high, default=None))
