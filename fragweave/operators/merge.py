"""Merging of parts computed separately."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_parts(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts; every part must have the same columns."""
    want = parts[0].columns
    for p in parts[1:]:
        if sorted(p.columns) != sorted(want):
            raise ValueError(f"parts differ in columns: {want} and {p.columns}")
    return reduce(DataFrame.unionByName, parts)


def check_equal_counts(parts: dict[str, DataFrame]) -> None:
    """Raise unless the named tables of one part have the same number of rows."""
    sizes = {name: df.count() for name, df in parts.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"tables of one part differ in rows: {sizes}")


def merge_feature_stats(stats: DataFrame, key: list[str]) -> DataFrame:
    """Combine per-part statistics (n, minimum, maximum, mean, sd).

    Means are weighted by n. The deviation pools the within-part variances, sqrt(sum sd^2 n / N);
    differences between part means do not enter.
    """
    t = stats.groupBy(*key).agg(
        F.sum("n").alias("n"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"),
        F.sum(F.col("mean") * F.col("n")).alias("_m"), F.sum(F.col("sd") * F.col("sd") * F.col("n")).alias("_v"))
    n = F.col("n")
    return t.select(*key, "n", "minimum", "maximum", F.try_divide("_m", n).alias("mean"), F.sqrt(F.try_divide("_v", n)).alias("sd"))


def _entries(col: str) -> Column:
    return F.transform(col, lambda v, i: F.struct(F.lit(col).alias("_kind"), i.alias("_i"), v.cast("long").alias("_v")))


def merge_genotypes(calls: DataFrame, variant: list[str], patient: str, library: str) -> DataFrame:
    """One genotype per variant and patient from several libraries.

    ``calls`` also has gt, ad, pl (arrays), dp, gq; ``called`` tells real calls from no-calls.
    Calls of one genotype are added up. The best sum by quality wins, on ties the one of lower
    depth; the first library's own call takes part as it is and wins exact ties, so that a
    patient without any call keeps it.
    """
    key = [*variant, patient]
    seed = calls.groupBy(*key).agg(F.min(F.struct(library, "gt", "ad", "pl", "dp", "gq")).alias("_s"))
    called = calls.where(F.col("called"))
    scalars = called.groupBy(*key, "gt").agg(F.sum("dp").cast("long").alias("dp"), F.sum("gq").cast("long").alias("gq"))
    entries = called.select(*key, "gt", F.inline(F.concat(_entries("ad"), _entries("pl"))))
    # Array entries are summed one by one; what is collected is as long as one array.
    summed = entries.groupBy(*key, "gt", "_kind", "_i").agg(F.sum("_v").alias("_v"))
    arrays = summed.groupBy(*key, "gt").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_kind") == k, F.struct("_i", "_v")))), lambda x: x["_v"]).alias(k)
        for k in ("ad", "pl")])
    rank = lambda pri: F.struct(F.col("gq"), (-F.col("dp")).alias("nd"), F.lit(pri).alias("seed"), "gt", "ad", "pl", "dp")
    sums = scalars.join(arrays, [*key, "gt"], "left").select(*key, rank(0).alias("_r"))
    own = seed.select(*key, "_s.gt", "_s.ad", "_s.pl", F.col("_s.dp").cast("long").alias("dp"), F.col("_s.gq").cast("long").alias("gq"))
    own = own.withColumns({c: F.transform(c, lambda v: v.cast("long")) for c in ("ad", "pl")}).select(*key, rank(1).alias("_r"))
    best = sums.unionByName(own).groupBy(*key).agg(F.max("_r").alias("_r"))
    return best.select(*key, "_r.gt", "_r.ad", "_r.pl", "_r.dp", "_r.gq")


def patient_libraries(sheet: DataFrame, patient: str, library: str, known: DataFrame) -> DataFrame:
    """Sample sheet rows with both ids set and a library the variant table knows (column ``library``)."""
    ok = (F.col(patient) != "NA") & (F.col(library) != "NA")
    return sheet.where(ok).join(known.select(F.col("library").alias(library)).distinct(), library, "left_semi").select(patient, library).distinct()
