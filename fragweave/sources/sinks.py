"""Writers. Spark writes one file per partition; order inside a sorted output runs over the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragweave.functions import sequence as S

# Column names of the matrix and prediction files.
MATRIX_HEADER = ["chr", "start", "end", "readName", "FragLen", "Frag_strand", "methy_stat", "Norm_Frag_cov", "baseQ", "Offset_frag",
                 "Dist_frag_end"]
PREDICTION = ["chr", "start_", "end_", "methy_perc_predict", "methy_count_predict", "total_count_predict", "methy_perc_obs",
              "methy_count_obs", "total_count_obs"]


def fixed(c: Column | str, digits: int) -> Column:
    """Number with a fixed count of decimals, ``NaN`` where missing."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isNull(), F.lit("NaN")).otherwise(F.format_string(f"%.{digits}f", col.cast("double")))


def na(c: Column | str, digits: int = 3) -> Column:
    """Number with a fixed count of decimals, ``NA`` where missing."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col.isNull(), F.lit("NA")).otherwise(F.format_string(f"%.{digits}f", col.cast("double")))


def matrix_lines(matrix: DataFrame, tracks: list[str]) -> DataFrame:
    """Feature matrix in output form: coverage with six decimals, tracks with three."""
    named = [F.col(c).alias(h) for c, h in zip(
        ["chr", "start_", "end_", "read_name", "frag_len", "strand", "methy_stat"], MATRIX_HEADER)]
    return matrix.select(
        *named, fixed("norm_cov", 6).alias("Norm_Frag_cov"), F.col("base_q").alias("baseQ"), F.col("offset_").alias("Offset_frag"),
        F.col("dist_end").alias("Dist_frag_end"), *[fixed(t, 3).alias(t) for t in tracks])


def write_tsv(df: DataFrame, path: str, *, header: bool = True, gzip: bool = True) -> None:
    df.write.option("sep", "\t").option("header", header).option("compression", "gzip" if gzip else "none").csv(path)


def write_matrix(matrix: DataFrame, path: str, tracks: list[str]) -> None:
    write_tsv(matrix_lines(matrix, tracks), path)


def write_predictions(pred: DataFrame, path: str) -> None:
    names = {"start_": "start", "end_": "end"}
    write_tsv(pred.select(*[F.col(c).alias(names.get(c, c)) for c in PREDICTION]), path)


def bedgraphs(pred: DataFrame) -> dict[str, DataFrame]:
    """Three tracks of a prediction: level, methylated count, coverage; contigs renamed, sorted."""
    t = pred.withColumn("chr", S.b37_name("chr"))
    value = {"methy": "methy_perc_predict", "methy_count": "methy_count_predict", "cov": "total_count_predict"}
    return {k: t.select("chr", "start_", "end_", F.col(v).alias("value")).orderBy("chr", "start_", "end_") for k, v in value.items()}


def write_fragment_reports(summary: DataFrame, path: str) -> None:
    """Fragment detail and its summaries by length and by methylation, each in order of its groups.

    ``summary`` is as from ``fragment_summary`` and is computed once: both summaries read the detail
    back, whose values are whole numbers and names, and add up in every task before they shuffle.
    """
    from fragweave.operators import fragments as FR

    write_tsv(summary, f"{path}/detail")
    detail = summary.sparkSession.read.schema(summary.schema).option("sep", "\t").option("header", True).csv(f"{path}/detail")
    write_tsv(FR.methylation_by_length(detail).orderBy("frag_len"), f"{path}/by_length")
    write_tsv(FR.length_by_methylation(detail).orderBy("methy_tenth"), f"{path}/by_methylation")


def write_tensors(numbered: DataFrame, tensor: DataFrame, path: str) -> None:
    """Window coordinates (from ``number_windows``) and position rows (from ``window_tensor``) as two Parquet tables.

    A window's rows have the numbers first_row to first_row + length - 1, so a block of windows is a
    range of rows; position files are cut and sorted by that number.
    """
    numbered.write.parquet(f"{path}/windows")
    tensor.repartitionByRange("row").sortWithinPartitions("row").write.parquet(f"{path}/positions")


def vcf_lines(genotypes: DataFrame, variant: list[str], patient: str) -> DataFrame:
    """Merged genotypes as sample fields GT:AD:DP:GQ:PL, one row per variant with a map of patients."""
    join = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    field = F.concat_ws(":", "gt", join("ad"), F.col("dp").cast("string"), F.col("gq").cast("string"), join("pl"))
    t = genotypes.select(*variant, F.col(patient).alias("_k"), field.alias("_v"))
    return t.groupBy(*variant).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("samples"))
