"""Nothing is cut from texts, fragments or broadcasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragweave.operators import matrix as M
from fragweave.operators import skew
from fragweave.plans import bindings as B


def test_other_letters_are_n(spark):
    df = spark.createDataFrame([("Aé b-ß1Z",), ("",), (None,), ("日本",)], "text string")
    got = [r[0] for r in df.select(B.letter_codes("text", ("ACGT" * 7)[:26])).collect()]
    assert got == ["ANCNC", "", None, "NN"]


def test_short_tiles_are_read_whole(spark, tmp_path):
    spark.createDataFrame([(1, "acg" * 10), (2, "a" * 170), (3, "b"), (4, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = B.read_mates(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.i, len(r.ref1), len(r.ref2), r.start2) for r in rows) == [
        (1, 0, 30, 30, 0), (2, 0, 70, 70, 90), (2, 1, 10, 10, 0), (3, 0, 1, 1, 0)]


def test_rejected_fragments_report_all_points(spark):
    rows = [("r", o, 0.5, 1.0, "m", "chr1", o, o + 1) for o in (10, 400, 3500, 3600)]
    points = spark.createDataFrame(rows, "read_name string, offset_ int, p double, z double, methy_stat string, chr string, start_ int, end_ int")
    r = M.fragments(points, ["z"], max_points=6, keep_rejected=True).first()
    assert (r.n, r.last_offset, r.accepted) == (4, 3600, False)
    assert M.fragments(points, ["z"], max_points=6).count() == 0


def test_hot_keys_get_as_many_salts_as_they_need(spark):
    rows = spark.range(3000).select((F.col("id") >= 1000).cast("int").alias("k"))
    fans = {r["k"]: r["_fan"] for r in skew.hot_keys(rows, ["k"], hot_rows=2).collect()}
    assert fans == {0: 501, 1: 1001}


def test_broadcasts_are_bounded_in_bytes(spark):
    df = spark.createDataFrame([("x" * 1000, [1, 2]), (None, None)], "a string, b array<int>")
    assert skew.is_small(df, 2) and not skew.is_small(df, 1) and not skew.is_small(df, 2, max_bytes=500)
    assert skew.is_small(df.where("false"), 0)
