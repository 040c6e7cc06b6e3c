"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the normalised text. A batch is
reduced to one row per digest, anti-joined with the index by sort-merge, and what is new is appended.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fragweave.llm.common import SPACE, look_up, new_path, written


def normalised(text: Column) -> Column:
    """White space runs become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


class DigestIndex:
    """A bucketed digest table below ``path``; opening the same path again continues it.

    The number of buckets is stored beside the index when it is begun; another one later is an error, as
    its files would not fit. Columns: digest, keep_id, batch.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = self._stored(buckets)
        self.name = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def _stored(self, asked: int | None) -> int:
        spec = f"{self.path.rstrip('/')}-buckets"
        try:
            known = self.spark.read.schema("buckets int").parquet(spec).first()[0]
        except AnalysisException:
            known = asked or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.spark.range(1).select(F.lit(known).alias("buckets")).coalesce(1).write.parquet(spec)
        if asked and asked != known:
            raise ValueError(f"the index at {self.path} has {known} buckets, not {asked}")
        return known

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, fresh: DataFrame) -> None:
        """``fresh`` holds digests that are not in the index; one file is added per bucket."""
        fresh.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicate one batch and append its new digests.

        Returns a row per row of ``docs``: doc_id, keep_id, group_size (rows of the batch with this
        text), kept, text_sha256. Of equal new texts the row with the smallest id stays, ids before
        nulls; of rows that also share the id, exactly one stays. Texts already in the index stay
        nowhere and name the id kept then. Other columns of ``docs`` play no part.

        ``batch`` names the batch. Digests that the index has from that batch count as new, so a batch
        that is ingested again under its name, after its driver was lost, gives its first result.
        """
        batch = batch or uuid.uuid4().hex
        seen = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))
        seen = written(seen.withColumn("row", F.monotonically_increasing_id()), "digests")
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        groups = seen.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
        old = self.rows()
        self.append(
            groups.join(old.hint("merge"), "digest", "left_anti")
            .select("digest", F.col("first.doc_id").alias("keep_id"), F.lit(batch).alias("batch")))
        known = groups.join(self.rows().hint("merge"), "digest")
        found = look_up(seen, known, "digest", "group_size", seen.count())
        return found.select(
            "doc_id", "keep_id", "group_size",
            ((F.col("batch") == batch) & (F.col("row") == F.col("first.row"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, index_path: str | None = None) -> DataFrame:
    """Deduplicate ``docs`` against the index at ``index_path``, or against an empty one of its own."""
    spark = docs.sparkSession
    return DigestIndex(spark, index_path or new_path(spark, "digest-index")).ingest(docs)
