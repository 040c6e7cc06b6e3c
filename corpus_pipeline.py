"""A corpus pipeline in five stages: toxicity, line dedup, near-duplicate documents, mixing, BPE.

Every stage is written as Parquet in the shared folder and read again as the documents of the next.
All stages but the last return the columns of documents; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fragweave.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from fragweave.llm.common import new_path, table
from fragweave.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labelled ones, scores as toxic go."""
    docs = docs.select(*COLUMNS)
    lexicon = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels"), "toxic"))
    return toxicity.score_documents(docs, lexicon, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the first; a document that loses its whole text goes too."""
    found = line_dedup.dedup_lines(docs.select(*COLUMNS)).where("n_dropped = 0 or text is null or text <> ''")
    return found.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar word shingles the one with the smallest doc_id stays.

    Shingles of five words and a similarity of 0.8. Of rows that share a doc_id one stays; rows
    without one stay all.
    """
    docs = docs.select(*COLUMNS)
    stays = jaccard_join.jaccard_components(docs, k=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    own = docs.where("doc_id is not null").join(stays.hint("merge"), "doc_id", "left_semi")
    same = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), F.xxhash64("lang", "source", "n_chars"))
    own = own.withColumn("_at", F.row_number().over(same)).where("_at = 1")
    return own.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    docs = docs.select(*COLUMNS)
    taken = mixing.mix(docs)
    key = F.struct("doc_id", "source", "size").alias("_key")
    nth = F.row_number().over(Window.partitionBy("_key").orderBy("_order"))
    taken = taken.select(key, F.col("copies"), F.lit(0).alias("_order")).withColumn("_nth", nth).select("_key", "_nth", "copies").where("copies > 0")
    own = docs.withColumn("size", mixing.size_of(F.col("text"))).select(*COLUMNS, key, F.xxhash64("text").alias("_order")).withColumn("_nth", nth)
    return own.join(taken.hint("merge"), ["_key", "_nth"]).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document of the mix."""
    return bpe.encode_documents(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokenise),
]

#: The stages learn, tilt and tokenise, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; the result is the last stage's table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
