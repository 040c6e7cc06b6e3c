"""Logical tables of the domain, read off the driver tables by fixed expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fragweave.session import fill_cluster

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
READ_LEN = 100


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Feature matrix rows from lineitem."""
    return table(spark, sf, "lineitem").selectExpr(
        "concat('chr', cast(l_suppkey % 22 + 1 as string)) as chr",
        "cast((l_partkey % 200) * 100 as int) as start_",
        "cast((l_partkey % 200) * 100 + 1 as int) as end_",
        "l_orderkey as read_name",
        "cast(l_quantity * 10 + 20 as int) as frag_len",
        "case when l_linestatus = 'F' then '-' else '+' end as strand",
        "case when l_returnflag = 'R' then 'u' else 'm' end as methy_stat",
        "l_extendedprice / 10000 as norm_cov",
        "cast(round(l_discount * 100) as int) as base_q",
        "cast(l_linenumber * 90 as int) as offset_",
        "cast(l_partkey % 97 + 1 as int) as dist_end",
        "round(l_tax * 1250, 2) as prior",
    )


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """Genomic regions from part."""
    return table(spark, sf, "part").selectExpr(
        "concat('chr', cast(p_partkey % 22 + 1 as string)) as r_chr",
        "cast((p_partkey * 37) % 20000 as int) as r_lo",
        "cast((p_partkey * 37) % 20000 + p_size * 10 as int) as r_hi",
        "case p_partkey % 3 when 0 then '+' when 1 then '-' else '.' end as r_strand",
        "p_size as r_size",
        "p_retailprice as r_value",
        "p_partkey as r_id",
    )


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """Point signal from events: one value per event at its minute."""
    return table(spark, sf, "events").selectExpr(
        "concat('chr', cast(user_id % 22 + 1 as string)) as s_chr",
        "cast(floor(unix_micros(cast(ts as timestamp)) / 60000000) - 28401120 as bigint) as s_pos",
        "value as s_value",
        "event_type as s_type",
        "event_id as s_id",
        "user_id as s_user",
    )


def sizes(spark: SparkSession) -> DataFrame:
    """Contig lengths that cover the matrix coordinates."""
    return spark.range(1, 23).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chr"), F.lit(20101).cast("long").alias("length"))


def letter_codes(text: str, codes: str) -> Column:
    """The letters of a text, A to Z replaced by ``codes`` and every other letter by N."""
    letters = F.translate(F.regexp_replace(text, "\\P{L}", ""), LETTERS + LETTERS.lower(), codes * 2)
    return F.regexp_replace(letters, "[^A-Z]", "N")


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Base sequences from document letters; a letter outside A to Z is an N."""
    seq = letter_codes("text", ("ACGT" * 7)[:26])
    return fill_cluster(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", seq.alias("seq"))


def qualities(text: str, step: int, plus: int = 0) -> Column:
    """(j * step + k + plus) % 41 of every letter j of a read; a piece of one literal array, as the numbers repeat."""
    c = F.col("k") + plus
    row = F.lit([j * step % 41 for j in range(41 + READ_LEN)])
    begin = (c * pow(step, -1, 41) % 41 + 1).cast("int")
    # Remainders of numbers below 0 change their sign on the way.
    other = F.transform(F.sequence(F.lit(0), F.length(text) - 1), lambda j: ((j * step + c) % 41).cast("int"))
    return F.when(c >= 0, F.slice(row, begin, F.length(text))).otherwise(other)


def aligned_reads(spark: SparkSession, sf: str) -> DataFrame:
    """The whole of every sequence cut into reads, with strands, ends, converted bases and qualities."""
    t = sequences(spark, sf).select("doc_id", F.posexplode(F.regexp_extract_all("seq", F.lit(f".{{1,{READ_LEN}}}"), F.lit(0))).alias("i", "ref"))
    k = F.col("doc_id") + F.col("i")
    t = t.select("doc_id", "i", "ref", k.alias("k"), (k % 2 == 1).alias("neg"), (F.col("i") % 4 >= 2).alias("second"))
    molecule = F.col("neg") != F.col("second")
    some = F.when(molecule, F.replace("ref", F.lit("CG"), F.lit("CA"))).otherwise(F.replace("ref", F.lit("CG"), F.lit("TG")))
    every = F.when(molecule, F.translate("ref", "G", "A")).otherwise(F.translate("ref", "C", "T"))
    bases = F.when(F.col("k") % 3 == 0, some).when(F.col("k") % 3 == 1, F.col("ref")).otherwise(every)
    return t.select("*", molecule.alias("molecule"), bases.alias("bases"), qualities("ref", 7).alias("quals"))


def read_mates(spark: SparkSession, sf: str) -> DataFrame:
    """Every sequence tiled into fragments of 160 bases read from both ends; both mates of a short tile read the whole of it."""
    t = sequences(spark, sf).select("doc_id", F.posexplode(F.regexp_extract_all("seq", F.lit(".{1,160}"), F.lit(0))).alias("i", "tile"))
    n = F.length("tile")
    size = F.when(n <= 90, n).when(F.col("i") % 5 == 0, F.lit(70)).otherwise(F.lit(READ_LEN))
    k = F.col("doc_id") + F.col("i")
    t = t.select("doc_id", "i", k.alias("k"), "tile", size.alias("size"), (F.col("i") % 3 != 0).alias("first_is_left"))
    start2 = F.when(F.length("tile") <= 90, F.lit(0)).when(F.col("i") % 5 == 0, F.lit(90)).otherwise(F.lit(60))
    ref1, ref2 = F.substring("tile", F.lit(1), F.col("size")), F.substring("tile", start2 + 1, F.col("size"))
    t = t.select("*", start2.alias("start2"), ref1.alias("ref1"), ref2.alias("ref2"))
    return t.select(
        "*", F.translate("ref1", "C", "T").alias("bases1"), F.replace("ref2", F.lit("CG"), F.lit("TG")).alias("bases2"),
        qualities("ref1", 7).alias("quals1"), qualities("ref2", 11, 3).alias("quals2"))


def gapped_mates(spark: SparkSession, sf: str) -> DataFrame:
    """The mates of every tile with deletions, insertions or soft clips, by turns, and the reference letter under each base."""
    t = read_mates(spark, sf)

    def gapped(ref: Column, bases: Column, kind: Column, at: int) -> tuple[Column, Column, Column]:
        n = F.length(ref)
        kind = F.when(n < at + 10, F.lit(0)).otherwise(kind)
        cut = lambda s, a, b: F.substring(s, F.lit(a), b) if not isinstance(b, int) else F.substring(s, F.lit(a), F.lit(b))
        pick = lambda plain, deleted, inserted, clipped: F.when(kind == 1, deleted).when(kind == 2, inserted).when(kind == 3, clipped).otherwise(plain)
        head = lambda s: cut(s, 1, at)
        new_ref = pick(ref, F.concat(head(ref), cut(ref, at + 4, n)), F.concat(head(ref), F.lit("--"), cut(ref, at + 1, n)), F.concat(F.lit("00"), ref))
        new_bases = pick(bases, F.concat(head(bases), cut(bases, at + 4, n)), F.concat(head(bases), F.lit("AC"), cut(bases, at + 1, n)), F.concat(F.lit("GG"), bases))
        whole = F.concat(n.cast("string"), F.lit("M"))
        cigar = pick(whole, F.concat(F.lit(f"{at}M3D"), (n - at - 3).cast("string"), F.lit("M")), F.concat(F.lit(f"{at}M2I"), (n - at).cast("string"), F.lit("M")),
                     F.concat(F.lit("2S"), whole))
        return new_ref, new_bases, cigar

    ref1, bases1, cigar1 = gapped(F.col("ref1"), F.col("bases1"), F.col("k") % 4, 20)
    ref2, bases2, cigar2 = gapped(F.col("ref2"), F.col("bases2"), F.floor(F.col("k") / 4) % 4, 15)
    q = lambda s, a, b: F.transform(F.sequence(F.lit(0), F.length(s) - 1), lambda j: ((j * a + F.col("k") + b) % 41).cast("int"))
    t = t.select("doc_id", "i", "k", "first_is_left", F.lit(0).alias("start1"), "start2", ref1.alias("ref1"), bases1.alias("bases1"), cigar1.alias("cigar1"),
                 ref2.alias("ref2"), bases2.alias("bases2"), cigar2.alias("cigar2"))
    return t.select("*", q("ref1", 7, 0).alias("quals1"), q("ref2", 11, 3).alias("quals2"))


def alignments(spark: SparkSession, sf: str) -> DataFrame:
    """Alignment records from lineitem: flags, positions, CIGAR strings."""
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as read_name",
        "l_linenumber as line",
        "cast(l_partkey as bigint) as partkey",
        "concat('chr', cast(l_suppkey % 22 + 1 as string)) as chr",
        "cast((l_partkey * 13) % 20000 + 1 as int) as pos",
        "cast((l_partkey * 13) % 20000 + 1 + (l_suppkey * 7) % 121 - 60 as int) as mate_pos",
        "cast((l_partkey * 31 + l_suppkey * 17 + l_linenumber * 3) % 2048 as int) as flag",
        "cast(l_quantity as int) as mapq",
        "cast(100 + l_quantity * 4 as int) as insert_size",
        "cast(100 as int) as read_len",
        "cast(l_partkey % 100 as int) as read_offset",
        "cast(round(l_discount * 400) as int) as qual",
        "substring('ACGT', cast(l_partkey % 4 as int) + 1, 1) as ref",
        "substring('ACGTN', cast((l_partkey + l_linenumber) % 5 as int) + 1, 1) as base",
        "concat(cast(l_linenumber as string), 'S', cast(cast(l_quantity as int) as string), 'M', cast(l_linenumber % 3 + 1 as string), 'I', "
        "cast(l_partkey % 20 + 1 as string), 'M', cast(l_suppkey % 5 + 1 as string), 'D', '10M') as cigar",
    )


def genotypes(spark: SparkSession, sf: str) -> DataFrame:
    """Per-library genotypes from orders; every order is a library of its customer."""
    return table(spark, sf, "orders").selectExpr(
        "cast(o_orderkey % 50 as int) as variant",
        "o_custkey as patient",
        "o_orderkey as library",
        "case o_orderstatus when 'F' then '0/0' when 'O' then '0/1' else './.' end as gt",
        "array(cast(o_orderkey % 17 as int), cast(o_orderkey % 11 as int)) as ad",
        "array(cast(o_orderkey % 7 as int), cast(o_orderkey % 5 as int), cast(o_orderkey % 3 as int)) as pl",
        "cast(o_orderkey % 17 + o_orderkey % 11 as int) as dp",
        "cast(floor(o_totalprice / 5000) as int) as gq",
        "o_orderstatus in ('F', 'O') as called",
    )


def letter_codes_sql(text: str, codes: str) -> str:
    """``letter_codes`` as DuckDB text."""
    return f"regexp_replace(translate(regexp_replace({text}, '\\P{{L}}', '', 'g'), '{LETTERS + LETTERS.lower()}', '{codes * 2}'), '[^A-Z]', 'N', 'g')"


# The same tables as DuckDB text, for the oracle.
SQL = {
    "matrix": """matrix as (select concat('chr', cast(l_suppkey % 22 + 1 as varchar)) as chr,
  cast((l_partkey % 200) * 100 as int) as start_, cast((l_partkey % 200) * 100 + 1 as int) as end_, l_orderkey as read_name,
  cast(l_quantity * 10 + 20 as int) as frag_len, case when l_linestatus = 'F' then '-' else '+' end as strand,
  case when l_returnflag = 'R' then 'u' else 'm' end as methy_stat, l_extendedprice / 10000 as norm_cov,
  cast(round(l_discount * 100) as int) as base_q, cast(l_linenumber * 90 as int) as offset_,
  cast(l_partkey % 97 + 1 as int) as dist_end, round(l_tax * 1250, 2) as prior from lineitem)""",
    "regions": """regions as (select concat('chr', cast(p_partkey % 22 + 1 as varchar)) as r_chr,
  cast((p_partkey * 37) % 20000 as int) as r_lo, cast((p_partkey * 37) % 20000 + p_size * 10 as int) as r_hi,
  case p_partkey % 3 when 0 then '+' when 1 then '-' else '.' end as r_strand, p_size as r_size, p_retailprice as r_value,
  p_partkey as r_id from part)""",
    "signal": """signal as (select concat('chr', cast(user_id % 22 + 1 as varchar)) as s_chr,
  cast(floor(epoch_us(ts) / 60000000) - 28401120 as bigint) as s_pos, value as s_value, event_type as s_type, event_id as s_id,
  user_id as s_user from events)""",
    "sizes": """sizes as (select concat('chr', cast(i as varchar)) as chr, cast(20101 as bigint) as length from range(1, 23) t(i))""",
    "sequences": f"sequences as (select doc_id, {letter_codes_sql('text', ('ACGT' * 7)[:26])} as seq from documents)",
    "reads": """slices as (select doc_id, regexp_extract_all(seq, '.{1,100}') as s from sequences),
reads0 as (select doc_id, unnest(range(len(s))) as i, unnest(s) as ref from slices),
reads1 as (select doc_id, i, ref, doc_id + i as k, (doc_id + i) % 2 = 1 as neg, i % 4 >= 2 as second from reads0),
reads as (select *, neg <> second as molecule,
  case when k % 3 = 1 then ref
       when k % 3 = 0 and (neg <> second) then replace(ref, 'CG', 'CA') when k % 3 = 0 then replace(ref, 'CG', 'TG')
       when (neg <> second) then translate(ref, 'G', 'A') else translate(ref, 'C', 'T') end as bases from reads1)""",
    "mates": """tiles as (select doc_id, regexp_extract_all(seq, '.{1,160}') as s from sequences),
mates0 as (select doc_id, unnest(range(len(s))) as i, unnest(s) as tile from tiles),
mates1 as (select doc_id, i, doc_id + i as k, tile, case when length(tile) <= 90 then length(tile) when i % 5 = 0 then 70 else 100 end as size, i % 3 <> 0 as first_is_left,
  case when length(tile) <= 90 then 0 when i % 5 = 0 then 90 else 60 end as start2 from mates0),
mates as (select *, substr(tile, 1, size) as ref1, substr(tile, start2 + 1, size) as ref2,
  translate(substr(tile, 1, size), 'C', 'T') as bases1, replace(substr(tile, start2 + 1, size), 'CG', 'TG') as bases2 from mates1)""",
    "alignments": """alignments as (select l_orderkey as read_name, l_linenumber as line, cast(l_partkey as bigint) as partkey,
  concat('chr', cast(l_suppkey % 22 + 1 as varchar)) as chr,
  cast((l_partkey * 13) % 20000 + 1 as int) as pos, cast((l_partkey * 13) % 20000 + 1 + (l_suppkey * 7) % 121 - 60 as int) as mate_pos,
  cast((l_partkey * 31 + l_suppkey * 17 + l_linenumber * 3) % 2048 as int) as flag, cast(l_quantity as int) as mapq,
  cast(100 + l_quantity * 4 as int) as insert_size, cast(100 as int) as read_len, cast(l_partkey % 100 as int) as read_offset,
  cast(round(l_discount * 400) as int) as qual, substring('ACGT', cast(l_partkey % 4 as int) + 1, 1) as ref,
  substring('ACGTN', cast((l_partkey + l_linenumber) % 5 as int) + 1, 1) as base,
  concat(cast(l_linenumber as varchar), 'S', cast(cast(l_quantity as int) as varchar), 'M', cast(l_linenumber % 3 + 1 as varchar), 'I',
    cast(l_partkey % 20 + 1 as varchar), 'M', cast(l_suppkey % 5 + 1 as varchar), 'D', '10M') as cigar from lineitem)""",
    "genotypes": """genotypes as (select cast(o_orderkey % 50 as int) as variant, o_custkey as patient, o_orderkey as library,
  case o_orderstatus when 'F' then '0/0' when 'O' then '0/1' else './.' end as gt,
  [cast(o_orderkey % 17 as int), cast(o_orderkey % 11 as int)] as ad,
  [cast(o_orderkey % 7 as int), cast(o_orderkey % 5 as int), cast(o_orderkey % 3 as int)] as pl,
  cast(o_orderkey % 17 + o_orderkey % 11 as int) as dp, cast(floor(o_totalprice / 5000) as int) as gq,
  o_orderstatus in ('F', 'O') as called from orders)""",
}


def ctes(*names: str) -> str:
    return ",\n".join(SQL[n] for n in names)
