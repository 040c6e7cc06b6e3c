"""Document fingerprints by consistent weighted sampling.

A text is its words with their counts. For every sample k each word draws, from its hash alone, r and
c from Gamma(2, 1) and b from the unit interval; with t = floor(ln w / r + b) its key is
ln c - r (t - b + 1). The word with the least key is the sample, marked by the word and t. Two texts
agree in a sample with a probability equal to the generalised Jaccard similarity of their counts.
All of it is column expressions: rows of words, aggregated twice by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fragweave.llm.common import SPACE, written

SAMPLES = 32
NO_ID = -(1 << 63)
_U21, _U31, _U32 = (1 << 21) - 1, (1 << 31) - 1, (1 << 32) - 1


def _unit(bits: Column, width: int) -> Column:
    return (bits + 0.5) / float(1 << width)


def sample_key(term: Column, log_w: Column, k: int) -> Column:
    """The word's key for sample k in the upper bits and the mark of (word, t) in the lower 32."""
    h = F.xxhash64(term, F.lit(k))
    g = F.xxhash64(h, F.lit(7))
    r = -F.ln(_unit(h.bitwiseAND(_U21), 21) * _unit(F.shiftrightunsigned(h, 21).bitwiseAND(_U21), 21))
    b = _unit(F.shiftrightunsigned(h, 42).bitwiseAND(_U21), 21)
    log_c = F.ln(-F.ln(_unit(g.bitwiseAND(_U31), 31) * _unit(F.shiftrightunsigned(g, 31).bitwiseAND(_U31), 31)))
    t = F.floor(log_w / r + b)
    key = F.floor((log_c - r * (t - b + 1) + 200) * float(1 << 22))
    mark = h.bitwiseXOR(t * F.lit(0x9E3779B1)).bitwiseAND(_U32)
    return key * F.lit(1 << 32) + mark


def sampled(texts: DataFrame, by: list[str], sides: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """Samples of several texts per row of ``texts``, whose rows ``by`` names uniquely.

    ``sides`` maps result columns to the two text columns. A word with the same count in both is drawn
    once for both. Rows whose texts both have no word are missing; one such text has nulls.
    """
    (first, a), (second, b) = sides.items()
    said = texts.select(*by, F.expr(f"stack(2, 0, `{a}`, 1, `{b}`) as (_side, _text)"))
    words = said.select(*by, "_side", F.explode(F.split("_text", SPACE)).alias("_word")).where("_word <> ''")
    counts = words.groupBy(*by, F.xxhash64("_word").alias("_term")).agg(
        F.sum(1 - F.col("_side")).alias("_a"), F.sum("_side").alias("_b"))
    one = lambda side, w: F.struct(F.lit(side).alias("side"), F.col(w).alias("w"))
    which = (F.when(F.col("_a") == F.col("_b"), F.array(one(0, "_a"))).when(F.col("_b") == 0, F.array(one(1, "_a")))
             .when(F.col("_a") == 0, F.array(one(2, "_b"))).otherwise(F.array(one(1, "_a"), one(2, "_b"))))
    terms = counts.select(*by, "_term", F.inline(which)).select(*by, "side", "_term", F.ln("w").alias("_log"))
    keys = terms.groupBy(*by, "side").agg(*(F.min(sample_key(F.col("_term"), F.col("_log"), k)).alias(f"_{k}") for k in range(samples)))
    least = lambda k, side: F.min(F.when(F.col("side") != side, F.col(f"_{k}")))
    both = keys.groupBy(*by).agg(*(least(k, 2).alias(f"a{k}") for k in range(samples)), *(least(k, 1).alias(f"b{k}") for k in range(samples)))
    marks = lambda p: F.when(F.col(f"{p}0").isNotNull(), F.array(*(F.col(f"{p}{k}").bitwiseAND(_U32) for k in range(samples))))
    return both.select(*by, marks("a").alias(first), marks("b").alias(second))


def as_text(marks: Column) -> Column:
    """Eight hexadecimal digits a sample; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(marks, lambda m: F.lpad(F.lower(F.hex(m)), 8, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two texts without words are alike, one such text is unlike any other."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def followers(keys: DataFrame) -> DataFrame:
    """Give each row (id, h, n) its successor (id2, h2) in descending id, the last one the first.

    Rows are dealt by range; inside a range a window finds the successor, and the first row of the
    next range follows the last of this one. Only one row a range meets in one task.
    """
    spark = keys.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(keys.repartitionByRange(ranges, F.desc("id"), "h").withColumn("part", F.spark_partition_id()), "order")
    inside = Window.partitionBy("part").orderBy(F.desc("id"), "h")
    own = dealt.select("*", F.lead(F.struct("id", "h")).over(inside).alias("next"), F.row_number().over(inside).alias("at"))
    heads = own.where("at = 1").select("part", F.struct("id", "h").alias("head"))
    every = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(every), F.first("head").over(every)).alias("after"))
    after = F.coalesce("next", "after")
    return own.join(F.broadcast(heads), "part").select("id", "h", "n", "times", after["id"].alias("id2"), after["h"].alias("h2"))  # one row a range


def compared_with_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has the last third of the code points replaced by as many (or all) of the first
    ones of the next document in descending doc_id; after the last comes the first. Null texts are
    empty, null ids come last. Rows equal in id and text share one place in the order and appear as
    often as they occur; different texts of one id follow each other by hash.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("h", F.xxhash64("text"))
    order = written(followers(base.groupBy("id", "h").agg(F.min(F.length("text")).alias("n"), F.count(F.lit(1)).alias("times"))), "next")
    own = base.dropDuplicates(["id", "h"])
    # the beginning of each text, sent to the document before it
    asked = order.select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("id2").alias("id"), F.col("h2").alias("h"), F.floor(F.col("n") / 3).cast("int").alias("take"))
    heads = own.join(asked.hint("merge"), ["id", "h"]).select(F.col("_id").alias("id"), F.col("_h").alias("h"), F.expr("left(text, take)").alias("head"))
    n = F.length("text")
    edited = own.join(heads.hint("merge"), ["id", "h"]).select(
        "id", "h", "text", n.alias("n_chars"), F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), "head").alias("edited"))
    marks = sampled(edited, ["id", "h"], {"marks": "text", "edited_marks": "edited"}, samples)
    known = edited.select("id", "h", "n_chars", F.sha2("edited", 256).alias("edited_sha256")).join(marks.hint("merge"), ["id", "h"], "left")
    known = written(known, "fingerprints")
    after = known.select(F.col("id").alias("id2"), F.col("h").alias("h2"), F.col("marks").alias("next_marks"))
    found = known.join(order.select("id", "h", "times", "id2", "h2").hint("merge"), ["id", "h"]).join(after.hint("merge"), ["id2", "h2"])
    found = found.withColumn("_copy", F.explode(F.expr("sequence(1, cast(times as int))")))
    return found.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.col("n_chars").cast("bigint").alias("n_chars"), "edited_sha256",
        as_text(F.col("marks")).alias("fingerprint"), as_text(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"), likeness(F.col("marks"), F.col("next_marks")).alias("near_next"))
