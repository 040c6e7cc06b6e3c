"""VCF output: sorted lines in BGZF parts, a header part and a tabix index over all of them.

Every task compresses its own range of variants into a part file in blocks that hold whole lines, and
notes where each index bin's lines lie in it. The driver sees those notes only (no more than one
for each bin and part), turns offsets inside parts into offsets of the whole and writes header, index
and end mark. The parts in order of their names are one block-compressed VCF file.

A task that is repeated writes under another name; only the names that the finished tasks report are
moved into place.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragweave.session import durable
from fragweave.sources.bam import BIN_LEVELS

# Fixed values of the formats: the empty block that ends a file, the fields of a line, the index's description of VCF.
END_MARK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
FIELDS = ("#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")
FORMAT = "GT:AD:DP:GQ:PL"
TABIX_VCF = (2, 1, 2, 0, ord("#"), 0)
BLOCK = 0xFF00
WINDOW = 14  # bits of a position inside one window of the linear index


def block(data: bytes) -> bytes:
    """One BGZF block of at most BLOCK bytes."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocks(data: bytes) -> bytes:
    return b"".join(block(data[i:i + BLOCK]) for i in range(0, len(data), BLOCK))


def bin_of(begin: int, end: int) -> int:
    """The smallest index bin that holds the 0-based range [begin, end)."""
    for shift, first in reversed(BIN_LEVELS):
        if begin >> shift == (end - 1) >> shift:
            return first + (begin >> shift)
    return 0


class PartWriter:
    """Packs lines into blocks, and notes the virtual offsets of every bin and window of the part."""

    def __init__(self, out: pa.NativeFile):
        self.out, self.size, self.held = out, 0, b""
        self.waiting: list[tuple[str, int, int, int, int]] = []  # contig, range and place in the held bytes of lines not yet in a block
        self.notes: list[list] = []  # contig, bin, first and last virtual offset, first and last window, first position

    def add(self, contig: str, pos: int, ref_len: int, line: str) -> None:
        data = line.encode() + b"\n"
        if self.held and len(self.held) + len(data) > BLOCK:
            self.flush()
        start = len(self.held)
        self.held += data
        self.waiting.append((contig, pos - 1, pos - 1 + max(ref_len, 1), start, len(self.held)))
        if len(self.held) > BLOCK:  # one line longer than a block
            self.flush()

    def flush(self) -> None:
        at = []  # file offset of every block the held bytes go into
        for i in range(0, len(self.held), BLOCK):
            at.append(self.size)
            packed = block(self.held[i:i + BLOCK])
            self.out.write(packed)
            self.size += len(packed)
        place = lambda p: (at[p // BLOCK] << 16 | p % BLOCK) if p < len(self.held) else self.size << 16
        for contig, begin, end, a, b in self.waiting:
            note = [contig, bin_of(begin, end), place(a), place(b), begin >> WINDOW, (end - 1) >> WINDOW, begin]
            last = self.notes[-1] if self.notes else None
            # lines of one bin and window that follow each other are one chunk
            if last and last[:2] == note[:2] and last[3] == note[2] and last[4:6] == note[4:6]:
                last[3] = note[3]
            else:
                self.notes.append(note)
        self.held, self.waiting = b"", []


def index_of(contigs: list[str], notes: list[tuple]) -> bytes:
    """A tabix index from notes in file order, with offsets of the whole file."""
    names = b"".join(c.encode() + b"\0" for c in contigs)
    out = [b"TBI\1", struct.pack("<i6i", len(contigs), *TABIX_VCF), struct.pack("<i", len(names)), names]
    by_contig = {c: list(rows) for c, rows in groupby(notes, key=lambda r: r[0])}
    for c in contigs:
        bins: dict[int, list[list[int]]] = {}
        windows: dict[int, int] = {}
        for _, number, a, b, w0, w1 in by_contig[c]:
            chunks = bins.setdefault(number, [])
            if chunks and chunks[-1][1] == a:
                chunks[-1][1] = b
            else:
                chunks.append([a, b])
            for w in range(w0, w1 + 1):
                windows[w] = min(a, windows.get(w, a))
        out.append(struct.pack("<i", len(bins)))
        for number, chunks in sorted(bins.items()):
            out.append(struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *x) for x in chunks))
        n, last = max(windows) + 1, 0
        out.append(struct.pack("<i", n))
        for w in range(n):
            last = windows.get(w, last)
            out.append(struct.pack("<Q", last))
    return blocks(b"".join(out)) + END_MARK


def sample_field() -> Column:
    """A genotype as the text of one sample's field."""
    number = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return F.concat_ws(":", "gt", number("ad"), F.col("dp").cast("string"), F.col("gq").cast("string"), number("pl"))


def vcf_rows(genotypes: DataFrame, sample: str, samples: list[str]) -> DataFrame:
    """One line a variant (chr, pos, ref_len, line), samples in the order given, ./. where one has no genotype.

    A variant's genotypes are at most one a sample; of several rows of a sample the greatest field counts.
    """
    variant = ["chr", "pos", "ref", "alt"]
    each = genotypes.groupBy(*variant, F.col(sample).alias("_s")).agg(F.max(sample_field()).alias("_v"))
    t = each.groupBy(*variant).agg(F.map_from_entries(F.collect_list(F.struct("_s", "_v"))).alias("_m"))
    fields = F.transform(F.array(*[F.lit(s) for s in samples]), lambda s: F.coalesce(F.try_element_at("_m", s), F.lit("./.")))
    line = F.concat_ws("\t", "chr", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), F.lit("."), F.lit(FORMAT), F.array_join(fields, "\t"))
    return t.select("chr", "pos", "alt", F.length("ref").alias("ref_len"), line.alias("line"))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def header(samples: list[str], meta: list[str]) -> bytes:
    lines = ["##fileformat=VCFv4.2", *(f"##{m.removeprefix('##')}" for m in meta), "\t".join([*FIELDS, *samples])]
    return "".join(f"{x}\n" for x in lines).encode()


def write_vcf(genotypes: DataFrame, path: str, *, sample: str = "patient", meta: list[str] | None = None, parts: int | None = None) -> int:
    """Write merged genotypes (chr, pos, ref, alt, sample, gt, ad, pl, dp, gq) below ``path``; returns the number of part files.
    ``parts`` sets how many hold lines; by default their sizes follow Spark's settings.

    The columns of the header are the distinct samples, in order, so they are one line's worth of names.
    Rows without a contig, position or sample are left out. An empty table gives a header and an empty index.
    """
    genotypes = genotypes.where(F.col("chr").isNotNull() & F.col("pos").isNotNull() & F.col(sample).isNotNull()).withColumn(sample, F.col(sample).cast("string"))
    samples = [r[0] for r in genotypes.select(sample).distinct().orderBy(sample).collect()]  # the header line
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    rows = vcf_rows(genotypes, sample, samples).repartitionByRange(*([parts] if parts else []), "chr", "pos").sortWithinPartitions("chr", "pos", "ref_len", "alt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        store, root = _store(path)
        name = f"_part-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            writer = PartWriter(out)
            batch = first
            while batch is not None:
                for contig, pos, ref_len, line in zip(*(batch.column(c).to_pylist() for c in ("chr", "pos", "ref_len", "line")), strict=True):
                    writer.add(contig, pos, ref_len, line)
                batch = next(batches, None)
            writer.flush()
        notes = [[name, writer.size, k, *n] for k, n in enumerate(writer.notes)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*notes, strict=True)], names=names)

    names = ["part", "size", "nth", "chr", "bin", "first", "last", "window0", "window1", "pos"]
    schema = "part string, size bigint, nth bigint, chr string, bin bigint, first bigint, last bigint, window0 bigint, window1 bigint, pos bigint"
    done = durable(rows.select("chr", "pos", "ref_len", "line").mapInArrow(run, schema), "vcf-parts")
    # parts in the order of their first line; ranges do not overlap
    begin = Window.partitionBy("part")
    found = done.withColumn("_begin", F.min_by(F.struct("chr", "pos"), "nth").over(begin)).toPandas()  # one row a bin and part
    head = blocks(header(samples, meta or []))
    with store.open_output_stream(f"{root}/part-00000.vcf.gz", compression=None) as out:
        out.write(head)
    base, notes, contigs, k = len(head), [], [], 0
    order = sorted({(tuple(b), p, s) for b, p, s in zip(found["_begin"], found["part"], found["size"], strict=True)})
    for k, (_, part, size) in enumerate(order, 1):
        own = found[found["part"] == part].sort_values("nth")
        shift = base << 16
        notes += [(c, int(b), int(x) + shift, int(y) + shift, int(v), int(w)) for c, b, x, y, v, w in own[["chr", "bin", "first", "last", "window0", "window1"]].itertuples(index=False)]
        store.move(f"{root}/{part}", f"{root}/part-{k:05d}.vcf.gz")
        base += int(size)
    contigs = [c for c, _ in groupby(n[0] for n in notes)]
    with store.open_output_stream(f"{root}/part-{k + 1:05d}.vcf.gz", compression=None) as out:
        out.write(END_MARK)
    with store.open_output_stream(f"{root}/_index.tbi", compression=None) as out:
        out.write(index_of(contigs, notes))
    return k + 2
