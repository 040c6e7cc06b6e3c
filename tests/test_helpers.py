"""Track specifications, region tracks, coverage files, prediction files and small helpers."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from fragweave.functions import reads as R
from fragweave.functions import sequence as S
from fragweave.operators import merge as ME
from fragweave.sources import sinks as K
from fragweave.sources import text as X


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def small_bigwig(rows):
    """One contig, one block, one leaf; rows are 0-based half-open with a value."""
    tree = struct.pack("<IIIIQQ", 0x78CA8C91, 1, 4, 8, 1, 0) + struct.pack("<BBH", 1, 0, 1) + b"chr1" + struct.pack("<II", 0, 1000)
    raw = struct.pack("<IIIIIBBH", 0, rows[0][0], rows[-1][1], 0, 0, 1, 0, len(rows)) + b"".join(struct.pack("<IIf", *r) for r in rows)
    data, at = zlib.compress(raw), 64 + len(tree)
    index = b"\0" * 48 + struct.pack("<BBH", 1, 0, 1) + struct.pack("<IIIIQQ", 0, rows[0][0], 0, rows[-1][1], at, len(data))
    return struct.pack("<IHHQQQHHQQIQ", 0x888FFC26, 4, 0, 64, at, at + len(data), 0, 0, 0, 0, 4096, 0) + tree + data + index


def test_tracks_by_suffix(spark, tmp_path):
    put(tmp_path, "a.bedGraph", "track type=bedGraph\nchr1 0 10 1.5\n")
    put(tmp_path, "b.bed", "#c\nchr1\t4\t8\tn\t7.5\t+\nchr1\t4\t8\tn\t.\t+\nchr1\t9\t10\tn\n")
    (tmp_path / "c.bw").write_bytes(small_bigwig([(2, 5, 0.5), (7, 9, 2.0)]))
    specs = [f"g:100:{tmp_path}/a.bedGraph", f"s:-20:{tmp_path}/b.bed", f"w:50:{tmp_path}/c.bw"]
    got = {name: (sorted(map(tuple, df.collect())), ext) for name, (df, ext) in X.read_tracks(spark, specs).items()}
    assert got == {"g": ([("g", "chr1", 1, 10, 1.5)], 100), "s": ([("s", "chr1", 5, 8, 7.5)], -20), "w": ([("w", "chr1", 3, 5, 0.5), ("w", "chr1", 8, 9, 2.0)], 50)}
    kinds = X.tracks_by_kind(spark, specs)
    assert {k: sorted(v) for k, v in kinds.items()} == {"value_tracks": ["g", "s"], "base_tracks": ["w"]}


def test_region_tracks(spark, tmp_path):
    put(tmp_path, "x.bed", "chr1\t1\t5\tn\t0\t-\nchr2\t3\t4\n")
    got = X.read_region_tracks(spark, [f"genes:{tmp_path}/x.bed"])
    assert list(got) == ["genes"] and got["genes"].count() == 2


def test_prediction_file(spark, tmp_path):
    pred = spark.createDataFrame([("chr1", 5, 6, 50.0, 1, 2, 100.0, 2, 2)], "chr string, start_ int, end_ int, methy_perc_predict double, methy_count_predict long, total_count_predict long, "
                                 "methy_perc_obs double, methy_count_obs long, total_count_obs long")
    K.write_predictions(pred, str(tmp_path / "p"))
    rows = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "p"))
    assert rows.columns[:3] == ["chr", "start", "end"] and [float(x) for x in rows.first()[1:]] == [5, 6, 50, 1, 2, 100, 2, 2]


def test_parts_of_unequal_size_are_an_error(spark):
    two, three = spark.range(2), spark.range(3)
    ME.check_equal_counts({"a": two, "b": spark.range(5, 7)})
    with pytest.raises(ValueError, match="differ in rows"):
        ME.check_equal_counts({"a": two, "b": three})


def test_clipped_qualities_and_kmer_names(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], 1, 2), ([1, 2], 2, 3)], "q array<int>, l int, r int")
    assert [r[0] for r in df.select(R.clip_quals(F.col("q"), F.col("l"), F.col("r"))).collect()] == [[2, 3], []]
    names = S.kmer_universe(3)
    assert len(names) == 16 + 64 and names[0] == "AA" and names[-1] == "TTT"
