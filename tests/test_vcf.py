"""VCF output read back as text, as one file, and through its index."""

import gzip
import random
import struct

from pyspark.sql import functions as F

from fragweave.sources import text as X
from fragweave.sources import vcf as V
from fragweave.sources.bam import BIN_LEVELS, block_at

KIND = "chr string, pos int, ref string, alt string, patient string, gt string, ad array<int>, pl array<int>, dp int, gq int"


class Bytes:
    def __init__(self, data):
        self.data, self.size, self.path = data, len(data), "bytes"

    def at(self, pos, n):
        return self.data[pos:pos + n]


def genotypes(n, seed=1):
    rng = random.Random(seed)
    spots = sorted({(rng.choice(["chr1", "chr2", "chrX"]), rng.randrange(1, 3_000_000), rng.choice(["A", "ACG"]), "T") for _ in range(n)})
    return [(*v, p, rng.choice(["0/0", "0/1", "1/1"]), [rng.randrange(50), rng.randrange(50)], [rng.randrange(9) for _ in range(3)], rng.randrange(90), rng.randrange(99))
            for v in spots for p in ("p1", "p10", "p2") if rng.random() < 0.8]


def joined(root):
    return b"".join(p.read_bytes() for p in sorted(root.glob("part-*.vcf.gz")))


def fetch(data, index, contig, lo, hi):
    """Lines that overlap a closed range, found as a reader of the format would."""
    raw, p = gzip.decompress(index), 36
    n_ref, names_len = struct.unpack_from("<i", raw, 4)[0], struct.unpack_from("<i", raw, 32)[0]
    names = raw[p:p + names_len].split(b"\0")[:-1]
    p += names_len
    wanted = {0} | {b for shift, first in BIN_LEVELS for b in range(first + (lo - 1 >> shift), first + (hi - 1 >> shift) + 1)}
    out = []
    for k in range(n_ref):
        chunks = []
        for _ in range(struct.unpack_from("<i", raw, p)[0]):
            number, m = struct.unpack_from("<Ii", raw, p + 4)
            if names[k].decode() == contig and number in wanted:
                chunks += [struct.unpack_from("<QQ", raw, p + 12 + 16 * j) for j in range(m)]
            p += 8 + 16 * m
        p += 4
        n = struct.unpack_from("<i", raw, p)[0]
        windows = struct.unpack_from(f"<{n}Q", raw, p + 4)
        p += 4 + 8 * n
        least = windows[min(lo - 1 >> 14, n - 1)] if n else 0
        for a, b in sorted(chunks):
            if b <= least:
                continue
            got, at, inside = b"", a >> 16, a & 0xFFFF
            while at < b >> 16 or (at == b >> 16 and b & 0xFFFF):
                block, after = block_at(Bytes(data), at)
                got += block[inside:b & 0xFFFF if at == b >> 16 else None]
                at, inside = after, 0
            out += [x for x in got.decode().splitlines() if int(x.split("\t")[1]) <= hi and int(x.split("\t")[1]) + len(x.split("\t")[3]) - 1 >= lo]
    return sorted(out)


def test_parts_are_one_sorted_file_that_reads_back(spark, tmp_path):
    rows = genotypes(4000)
    df = spark.createDataFrame(rows, KIND).repartition(5)
    n = V.write_vcf(df, str(tmp_path / "v"), meta=["source=test"], parts=4)
    parts = sorted(p.name for p in (tmp_path / "v").glob("part-*"))
    assert n == len(parts) >= 4 and not list((tmp_path / "v").glob("_part*"))
    text = gzip.decompress(joined(tmp_path / "v")).decode().splitlines()
    assert text[:3] == ["##fileformat=VCFv4.2", "##source=test", "\t".join([*V.FIELDS, "p1", "p10", "p2"])]
    spots = [(x.split("\t")[0], int(x.split("\t")[1])) for x in text[3:]]
    assert spots == sorted(spots) and len(spots) == len({r[:4] for r in rows})
    back = X.read_vcf(spark, str(tmp_path / "v")).where("called").select("chr", "pos", "ref", "alt", F.col("library").alias("patient"), "gt", "ad", "pl", "dp", "gq")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_index_finds_the_lines_of_a_range(spark, tmp_path):
    rows = genotypes(3000, seed=2) + [("chr2", 100, "A" * 70_000, "T", "p1", "0/1", [1, 2], [1, 2, 3], 3, 4)]
    V.write_vcf(spark.createDataFrame(rows, KIND).repartition(3), str(tmp_path / "v"), parts=3)
    data, index = joined(tmp_path / "v"), (tmp_path / "v" / "_index.tbi").read_bytes()
    lines = [x for x in gzip.decompress(data).decode().splitlines() if not x.startswith("#")]
    rng = random.Random(3)
    for _ in range(60):
        contig, lo = rng.choice(["chr1", "chr2", "chrX", "chr9"]), rng.randrange(1, 3_000_000)
        hi = lo + rng.choice([0, 10, 5000, 200_000])
        want = [x for x in lines if (f := x.split("\t"))[0] == contig and int(f[1]) <= hi and int(f[1]) + len(f[3]) - 1 >= lo]
        assert fetch(data, index, contig, lo, hi) == sorted(want)
    assert len(fetch(data, index, "chr2", 60_000, 60_000)) >= 1  # inside the long reference allele


def test_an_empty_table_has_a_header_and_rows_without_a_place_go(spark, tmp_path):
    assert V.write_vcf(spark.createDataFrame([], KIND), str(tmp_path / "e")) == 2
    assert gzip.decompress(joined(tmp_path / "e")).decode().splitlines()[-1] == "\t".join(V.FIELDS)
    odd = [("chr1", None, "A", "T", "p", "0/1", [1], [1], 1, 1), ("chr1", 5, "A", "T", None, "0/1", [1], [1], 1, 1), ("chr1", 7, "A", "T", "p", "0/1", None, [1], None, 1)]
    V.write_vcf(spark.createDataFrame(odd, KIND), str(tmp_path / "o"))
    assert gzip.decompress(joined(tmp_path / "o")).decode().splitlines()[-1].split("\t")[:5] == ["chr1", "7", ".", "A", "T"]
