"""One query per operator, over its whole table, and the SQL it is checked against where there is any."""

from __future__ import annotations

import os
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragweave.llm import bpe, chat, exact_dedup, fingerprint, jaccard_join, language_id, line_dedup, mixing, neighbours, periodic_runs, quality, token_alignment, toxicity
from fragweave.llm.common import fold_of, table


def vocabulary() -> str:
    """The tokenizer file; FRAGWEAVE_BPE names another one."""
    if path := os.environ.get("FRAGWEAVE_BPE"):
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(language_id.training_docs(docs))
    found = language_id.predict(docs, model)
    return found.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    vectors = quality.word_vectors(docs)
    net = quality.fit(toxicity.training_rows(docs, labels, "quality", rows=quality.FIT_ROWS), vectors)
    found = quality.score_documents(docs, vectors, net)
    return found.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared_with_edits(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.parsed(chat.formatted(chat.canonical(rows)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.col("formatted_chars").cast("bigint").alias("formatted_chars"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary(), full=False)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score_documents(docs, toxicity.fit(toxicity.training_rows(docs, labels, "toxic")))
    return found.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def tiled_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word numbers of a tenth of the documents: from word a on, the p words there repeat to the end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), order=tiled_order)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.get(F.array_sort("runs", lambda x, y: F.coalesce(
        F.nullif(F.signum(y["length"] - x["length"]), F.lit(0.0)), F.nullif(F.signum(x["start"] - y["start"]), F.lit(0.0)), F.signum(x["period"] - y["period"])).cast("int")), F.lit(0))
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), "runs", "collapsed").select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_alignment.align(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), full=False)
    return found.withColumnRenamed("groups", "groups_sha256")


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_mixing, op3_line_dedup, op4_quality, op5_fingerprint, op6_chat_format, op7_exact_dedup, op8_jaccard_join, op9_bpe, op10_toxicity,
    op11_periodic_runs, op12_token_alignment, op13_neighbours, pipeline)}

SPACE = r"[\x20\x09-\x0D]+"

ORACLE = {
    "op6_chat_format": r"""
with rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as role0 from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]', 'user' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant'),
said as (select *, replace(replace(text, '\', '\0'), '<|', '<\1|') as safe,
  replace(replace(replace(role, '\', '\0'), '<|', '<\1|'), chr(10), '\2') as safe_role from rows),
whole as (select conv_id, count(*) as n_turns,
  string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role0 nulls first, text) as turns,
  coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role0 nulls first, text), '') as loss,
  sum(8 + length(safe_role) + 1 + length(safe) + 7) as formatted_chars from said group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
  cast(formatted_chars as bigint) as formatted_chars from whole""",
    "op7_exact_dedup": r"""
with seen as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
grouped as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from seen group by 1)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from seen join grouped using (text_sha256)""",
}
