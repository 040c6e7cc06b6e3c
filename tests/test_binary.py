"""Binary readers on files written here, read in many small splits."""

import random
import struct
import zlib

import pytest
from pyspark.sql import datasource as ds

from fragweave.sources import bam as bam_format
from fragweave.sources import binary as B
from fragweave.sources import storage

B.bam = bam_format


def bgzf(data, block):
    out = b""
    for i in [*range(0, len(data), block), None]:
        raw = b"" if i is None else data[i: i + block]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(raw) + c.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw))
    return out


def bam(names, reads, block):
    text = b"@HD\tVN:1.6\n"
    data = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(names))
    for n in names:
        data += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 10 ** 6)
    for name, flag, ref, pos, mapq, cigar, mpos, isize, bases, quals, md in reads:
        codes = [B.BAM_BASES.index(c) for c in bases] + [0]
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(bases), 2))
        tags = b"NMC\x01" + b"MDZ" + md.encode() + b"\0" + b"XBBS" + struct.pack("<iHH", 2, 1, 2)
        rec = struct.pack("<iiBBHHHiiii", names.index(ref), pos - 1, len(name) + 1, mapq, 0, len(cigar), flag, len(bases), names.index(ref), mpos - 1, isize)
        rec += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | B.BAM_OPS.index(o)) for n, o in cigar) + packed + bytes(quals) + tags
        data += struct.pack("<i", len(rec)) + rec
    return bgzf(data, block)


def make_reads(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        k = rng.randrange(30, 90)
        out.append((f"read{i}", rng.choice([99, 147, 83, 163]), rng.choice(["chr1", "chr2"]), rng.randrange(1, 9 * 10 ** 5), rng.randrange(60), [(3, "S"), (k - 3, "M"), (2, "D")],
                    rng.randrange(1, 9 * 10 ** 5), rng.randrange(-400, 400), "".join(rng.choice("ACGTN") for _ in range(k)), [rng.randrange(41) for _ in range(k)], str(k)))
    return out


@pytest.mark.parametrize("block,split", [(300, 1000), (5000, 2000), (64, 500), (65000, 10 ** 9)])
def test_bam_in_splits(spark, tmp_path, block, split):
    B.register_all(spark)
    reads = make_reads(400)
    (tmp_path / "a.bam").write_bytes(bam(["chr1", "chr2"], reads, block))
    df = spark.read.format("bam").option("split", split).load(str(tmp_path / "a.bam"))
    got = sorted(tuple(r) for r in df.collect())
    want = sorted((n, f, c, p, q, "".join(f"{k}{o}" for k, o in cg), mp, i, b, ql, md, None, p - 1 + sum(k for k, o in cg if o in "MD"))
                  for n, f, c, p, q, cg, mp, i, b, ql, md in reads)
    assert got == want


def test_twobit(spark, tmp_path):
    B.register_all(spark)
    rng = random.Random(2)
    seqs = {c: "".join(rng.choice("ACGT") for _ in range(n)) for c, n in (("chr1", 1003), ("chrX", 17))}
    seqs["chr1"] = seqs["chr1"][:60] + "N" * 30 + seqs["chr1"][90:]
    head, body, offset = b"", b"", 16 + sum(5 + len(c) for c in seqs)
    for c, s in seqs.items():
        packed = bytes(sum(B.TWOBIT_BASES.index(x if x != "N" else "T") << sh for x, sh in zip(s[i:i + 4].ljust(4, "T"), (6, 4, 2, 0))) for i in range(0, len(s), 4))
        n = [60, 30] if "N" in s else []
        rec = struct.pack("<I", len(s)) + (struct.pack("<III", 1, *n) if n else struct.pack("<I", 0)) + struct.pack("<III", 1, 5, 9) + struct.pack("<I", 0) + packed
        head += bytes([len(c)]) + c.encode() + struct.pack("<I", offset + len(body))
        body += rec
    (tmp_path / "g.2bit").write_bytes(struct.pack("<IIII", 0x1A412743, 0, 2, 0) + head + body)
    rows = spark.read.format("twobit").options(chunk=50, per_task=3).load(str(tmp_path / "g.2bit")).orderBy("chr", "chunk_start").collect()
    got = {}
    for r in rows:
        assert r["chunk_start"] == len(got.get(r["chr"], ""))
        got[r["chr"]] = got.get(r["chr"], "") + r["bases"]
    assert got == seqs


def test_bigwig(spark, tmp_path):
    B.register_all(spark)
    sections = [
        (0, struct.pack("<IIIIIBBH", 0, 10, 30, 0, 0, 1, 0, 2) + struct.pack("<IIf", 10, 20, 1.5) + struct.pack("<IIf", 25, 30, 2.5)),
        (0, struct.pack("<IIIIIBBH", 0, 100, 130, 0, 5, 2, 0, 2) + struct.pack("<If", 100, 3.0) + struct.pack("<If", 120, 4.0)),
        (1, struct.pack("<IIIIIBBH", 1, 0, 30, 10, 1, 3, 0, 3) + struct.pack("<fff", 1, 2, 3)),
    ]
    tree = struct.pack("<IIIIQQ", 0x78CA8C91, 2, 4, 8, 2, 0) + struct.pack("<BBH", 1, 0, 2) + b"chr1" + struct.pack("<II", 0, 1000) + b"chrX" + struct.pack("<II", 1, 500)
    data, spots, at = b"", [], 64 + len(tree)
    for c, raw in sections:
        z = zlib.compress(raw)
        spots.append((c, at + len(data), len(z)))
        data += z
    index_at = at + len(data)
    index = b"\0" * 48 + struct.pack("<BBH", 0, 0, 2)
    leaf1 = index_at + len(index) + 48
    leaves = [spots[:2], spots[2:]]
    blobs = [struct.pack("<BBH", 1, 0, len(x)) + b"".join(struct.pack("<IIIIQQ", c, 0, c, 0, o, n) for c, o, n in x) for x in leaves]
    index += struct.pack("<IIIIQ", 0, 0, 0, 0, leaf1) + struct.pack("<IIIIQ", 1, 0, 1, 0, leaf1 + len(blobs[0])) + b"".join(blobs)
    head = struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 0, 64, at, index_at, 0, 0, 0, 0, 4096, 0)
    (tmp_path / "t.bw").write_bytes(head + tree + data + index)
    got = sorted(tuple(r) for r in spark.read.format("bigwig").option("per_task", 1).load(str(tmp_path / "t.bw")).collect())
    assert got == [("chr1", 11, 20, 1.5), ("chr1", 26, 30, 2.5), ("chr1", 101, 105, 3.0), ("chr1", 121, 125, 4.0), ("chrX", 1, 1, 1.0), ("chrX", 11, 11, 2.0), ("chrX", 21, 21, 3.0)]


# filters and the files' own indexes

def sorted_bam_with_index(names, reads, block):
    """A coordinate-sorted BAM of many blocks and its index, written from the format's description."""
    reads = sorted(reads, key=lambda r: (names.index(r[2]), r[3]))
    head, whole = bam(names, [], 1 << 16), b""
    plain = b"".join(B.bam.block_at(Bytes(head), 0)[:1])
    starts, data = [], plain
    for r in reads:
        starts.append(len(data))
        data += b"".join(B.bam.block_at(Bytes(bam(names, [r], 1 << 16)), 0)[:1])[len(plain):]
    starts.append(len(data))
    where = {}
    for i in range(0, len(data), block):
        where[i // block] = len(whole)
        whole += bgzf(data[i:i + block], block)[:-28]
    end = len(whole)
    whole += bgzf(b"", block)[-28:]
    virtual = [where[p // block] << 16 | p % block if p < len(data) or len(data) % block else end << 16 for p in starts]
    index = b"BAI\1" + struct.pack("<i", len(names))
    for name in names:
        bins, windows = {}, {}
        for k, r in enumerate(reads):
            if r[2] == name:
                lo, hi = r[3] - 1, r[3] - 1 + sum(n for n, o in r[5] if o in "MDN=X")
                spot = next(first + (lo >> shift) for shift, first in reversed(((29, 0), *B.bam.BIN_LEVELS)) if lo >> shift == (hi - 1) >> shift)
                chunks = bins.setdefault(spot, [])
                if chunks and chunks[-1][1] == virtual[k]:
                    chunks[-1][1] = virtual[k + 1]
                else:
                    chunks.append([virtual[k], virtual[k + 1]])
                for w in range(lo >> 14, (hi - 1 >> 14) + 1):
                    windows.setdefault(w, virtual[k])
        index += struct.pack("<i", len(bins) + 1) + struct.pack("<IiQQQQ", B.bam.META_BIN, 2, 0, 0, 0, 0)
        for spot, chunks in bins.items():
            index += struct.pack("<Ii", spot, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        top = max(windows, default=-1) + 1
        last, line = 0, []
        for w in range(top):
            last = windows.get(w, last)
            line.append(last)
        index += struct.pack("<i", top) + b"".join(struct.pack("<Q", x) for x in line)
    return whole, index


class Bytes:
    """Bytes in place of a file."""

    def __init__(self, data):
        self.data, self.size, self.path = data, len(data), "bytes"

    def at(self, pos, n):
        return self.data[pos:pos + n]


def read_all(reader, filters):
    """Rows of a reader under filters, its partitions, and the bytes of files it has read."""
    kept = list(reader.pushFilters(filters))
    assert kept == filters  # Spark evaluates all of them again
    before = storage.File.total_read
    parts = reader.partitions()
    rows = [row for part in parts for batch in reader.read(part) for row in batch.to_pylist()]
    return rows, parts, storage.File.total_read - before


@pytest.fixture(scope="module")
def indexed(tmp_path_factory):
    root = tmp_path_factory.mktemp("bam")
    reads = make_reads(6000, seed=9)
    data, index = sorted_bam_with_index(["chr1", "chr2"], reads, 4000)
    (root / "a.bam").write_bytes(data)
    (root / "a.bam.bai").write_bytes(index)
    return str(root / "a.bam"), reads, len(data)


def overlapping(reads, name, lo, hi):
    return sorted(r[0] for r in reads if r[2] == name and r[3] <= hi and r[3] - 1 + sum(n for n, o in r[5] if o in "MD") >= lo)


@pytest.mark.parametrize("lo,hi", [(400_000, 410_000), (1, 5000), (890_000, 10 ** 6), (16_384, 16_385), (300_000, 299_000)])
def test_bam_range_opens_only_its_blocks(indexed, lo, hi):
    path, reads, size = indexed
    rows, _, used = read_all(B.PushingBamReader(path, None, 1 << 20), [ds.EqualTo(("chr",), "chr1"), ds.LessThanOrEqual(("pos",), hi), ds.GreaterThanOrEqual(("end_pos",), lo)])
    assert sorted(r["read_name"] for r in rows if r["chr"] == "chr1" and r["pos"] <= hi and r["end_pos"] >= lo) == overlapping(reads, "chr1", lo, hi)
    index = __import__("os").path.getsize(path + ".bai")
    assert used - index < 0.06 * size


def test_bam_contig_is_split_at_known_record_starts(indexed):
    path, reads, _ = indexed
    rows, parts, _ = read_all(B.PushingBamReader(path, None, 20_000), [ds.EqualTo(("chr",), "chr2")])
    assert len(parts) > 3
    assert sorted(r["read_name"] for r in rows if r["chr"] == "chr2") == overlapping(reads, "chr2", 1, 10 ** 9)


def test_bam_filters_in_spark(spark, indexed):
    path, reads, _ = indexed
    B.register_all(spark)
    df = spark.read.format("bam").load(path)
    got = B.reads_in(spark, path, "chr1", 200_000, 230_000)
    assert sorted(r[0] for r in got.select("read_name").collect()) == overlapping(reads, "chr1", 200_000, 230_000)
    assert df.where("chr = 'chr2' and mapq > 30 or pos = 5").count() == sum(r[2] == "chr2" and r[4] > 30 or r[3] == 5 for r in reads)
    assert df.where("chr = '*'").count() == 0 and df.where("chr = 'chr7'").count() == 0 and df.count() == len(reads)
    assert B.reads_in(spark, path, "chr1", 200_000, 230_000, index=path + ".none").count() == got.count()
    assert spark.read.format("bam").option("region", "chr2").load(path).where("chr = 'chr2'").count() == sum(r[2] == "chr2" for r in reads)


def test_bam_filters_pushed_by_spark(spark, indexed):
    """With the setting on, and one load for each query."""
    path, reads, _ = indexed
    B.register_all(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = spark.read.format("bam").option("push", "true").load(path).where("chr = 'chr1' and pos <= 230000 and end_pos >= 200000")
        assert got.count() == len(overlapping(reads, "chr1", 200_000, 230_000))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_bam_odd_records(tmp_path, spark):
    """No bases, no operations, missing qualities, long operations and a read without a place."""
    B.register_all(spark)
    reads = [("a", 0, "chr1", 5, 1, [], 1, 0, "", [], "5"), ("b", 0, "chr1", 9, 1, [(1234567, "N"), (1, "M")], 1, 0, "A", [255], "6"),
             ("c", 0, "chr1", 9, 1, [(10, "="), (2, "X"), (3, "P"), (99, "H")], 1, 0, "ACGTN", [1, 2, 3, 4, 5], "7")]
    (tmp_path / "o.bam").write_bytes(bam(["chr1"], reads, 70))
    rows = {r.read_name: r for r in spark.read.format("bam").load(str(tmp_path / "o.bam")).collect()}
    assert (rows["a"].cigar, rows["a"].bases, rows["a"].quals, rows["a"].md, rows["a"].end_pos) == ("*", "", [], "5", 4)
    assert (rows["b"].cigar, rows["b"].quals, rows["b"].end_pos) == ("1234567N1M", [0], 9 + 1234568 - 1)
    assert (rows["c"].cigar, rows["c"].quals, rows["c"].end_pos, rows["c"].mc) == ("10=2X3P99H", [1, 2, 3, 4, 5], 20, None)


def test_twobit_filters_read_only_the_contig(spark, tmp_path):
    rng = random.Random(3)
    seqs = {f"chr{k}": "".join(rng.choice("ACGT") for _ in range(40_000)) for k in range(20)}
    head, body, offset = b"", b"", 16 + sum(5 + len(c) for c in seqs)
    for c, s in seqs.items():
        packed = bytes(sum(B.TWOBIT_BASES.index(x) << sh for x, sh in zip(s[i:i + 4], (6, 4, 2, 0), strict=True)) for i in range(0, len(s), 4))
        head += bytes([len(c)]) + c.encode() + struct.pack("<I", offset + len(body))
        body += struct.pack("<IIII", len(s), 0, 0, 0) + packed
    path = str(tmp_path / "g.2bit")
    (tmp_path / "g.2bit").write_bytes(struct.pack("<IIII", 0x1A412743, 0, len(seqs), 0) + head + body)
    rows, _, used = read_all(B.PushingTwoBitReader(path, 1000, 2), [ds.EqualTo(("chr",), "chr7"), ds.GreaterThan(("chunk_start",), 11_000), ds.LessThan(("chunk_start",), 14_500)])
    assert [(r["chunk_start"], r["bases"]) for r in rows if 11_000 < r["chunk_start"] < 14_500] == [(a, seqs["chr7"][a:a + 1000]) for a in (12_000, 13_000, 14_000)]
    assert used < 7000  # the file has 200,000 bytes; the directory is read at once
    B.register_all(spark)
    assert [r.bases for r in B.chunks_in(spark, path, "chr3", 2500, 3001, chunk=1000, per_task=2).orderBy("chunk_start").collect()] == [seqs["chr3"][2000:3000], seqs["chr3"][3000:4000]]


def test_bigwig_filters_follow_the_tree(spark, tmp_path):
    """Forty blocks under eight leaves; a narrow range opens one block."""
    tree = struct.pack("<IIIIQQ", 0x78CA8C91, 2, 4, 8, 2, 0) + struct.pack("<BBH", 1, 0, 2) + b"chr1" + struct.pack("<II", 0, 10 ** 6) + b"chr2" + struct.pack("<II", 1, 10 ** 6)
    data, spots, at, want = b"", [], 64 + len(tree), []
    for c in (0, 1):
        for k in range(20):
            lo = [k * 1000 + 10 * j for j in range(50)]
            z = zlib.compress(struct.pack("<IIIIIBBH", c, lo[0], lo[-1] + 10, 0, 10, 2, 0, 50) + b"".join(struct.pack("<If", x, k + x) for x in lo))
            spots.append((c, lo[0], lo[-1] + 10, at + len(data), len(z)))
            want += [(f"chr{c + 1}", x + 1, x + 10, float(k + x)) for x in lo]
            data += z
    index_at = at + len(data)
    groups = [spots[i:i + 5] for i in range(0, 40, 5)]
    root = b"\0" * 48 + struct.pack("<BBH", 0, 0, 8)
    leaf_at, leaves = index_at + len(root) + 24 * 8, b""
    for g in groups:
        root += struct.pack("<IIIIQ", g[0][0], g[0][1], g[-1][0], g[-1][2], leaf_at + len(leaves))
        leaves += struct.pack("<BBH", 1, 0, 5) + b"".join(struct.pack("<IIIIQQ", c, a, c, b, o, n) for c, a, b, o, n in g)
    head = struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 0, 64, at, index_at, 0, 0, 0, 0, 4096, 0)
    path = str(tmp_path / "t.bw")
    (tmp_path / "t.bw").write_bytes(head + tree + data + root + leaves)
    inside = lambda r: r[0] == "chr2" and r[1] <= 7105 and r[2] >= 7050
    rows, parts, used = read_all(B.PushingBigWigReader(path, 1), [ds.EqualTo(("chr",), "chr2"), ds.LessThanOrEqual(("lo",), 7105), ds.GreaterThanOrEqual(("hi",), 7050)])
    assert len(parts) == 1 and len(rows) == 50 and used < len(data) / 10
    assert [tuple(r.values()) for r in rows if inside(tuple(r.values()))] == [r for r in want if inside(r)]
    B.register_all(spark)
    df = spark.read.format("bigwig").load(path)
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert sorted(map(tuple, B.values_in(spark, path, "chr2", 7050, 7105).collect())) == [r for r in want if inside(r)]
