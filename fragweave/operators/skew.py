"""Keeping hot keys out of single tasks.

A key may hold a third of all rows. Aggregations are safe because Spark combines before it
shuffles; joins are not, so they spread the rows of hot keys over several salts and copy the
matching rows of the other side once per salt. Keys are called hot by counting, never by
sampling, and get as many salts as their rows need. The list holds the ``HOT_LIMIT`` largest, so any
key outside it holds less than 1 / HOT_LIMIT of the rows: no more than one of so many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType

HOT_ROWS = 2_000_000
HOT_LIMIT = 10_000
TASK_PAIRS = 16_000_000
SALT_ROWS = 64
BROADCAST_BYTES = 256 << 20
SALT = "_salt"
_FAN = "_fan"
_COUNT = object()


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, weight: str | None = None) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows and the number of salts each one needs."""
    size = F.sum(weight) if weight else F.count(F.lit(1))
    counted = (
        rows.groupBy(*keys)
        .agg(size.alias("_n"))
        .where(F.col("_n") > hot_rows)
        .orderBy(F.desc("_n"))
        .limit(HOT_LIMIT)
        .select(*keys, (F.ceil(F.col("_n") / hot_rows) + 1).cast("int").alias(_FAN))
    )
    found = counted.collect()  # at most HOT_LIMIT small rows
    if not found:
        return None
    return rows.sparkSession.createDataFrame(found, counted.schema)


def _bytes(df: DataFrame) -> Column:
    """Size of a row: texts and nested values by their length, other values by 8 bytes."""
    fixed = (NumericType, DateType, TimestampType, BooleanType)
    wide = [F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0)) for f in df.schema.fields if not isinstance(f.dataType, fixed)]
    return reduce(lambda a, b: a + b, wide, F.lit(8 * len(df.columns))).cast("bigint")


def is_small(df: DataFrame, max_rows: int, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes, by an aggregation that combines in every task."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(_bytes(df))).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def sized(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast when counted to be small, else keep Spark from broadcasting on an estimate.

    Estimates do not know how many rows an explode adds, hence the count.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df.hint("merge")


def spread(big: DataFrame, other: DataFrame, keys: Sequence[str], hot: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Add a salt to both sides so that an equi-join on (keys, salt) equals one on keys."""
    if hot is None:
        return big.withColumn(SALT, F.lit(0)), other.withColumn(SALT, F.lit(0))
    hot = F.broadcast(hot)
    row_hash = F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in big.columns])
    left = (
        big.join(hot, list(keys), "left")
        .withColumn(SALT, F.when(F.col(_FAN).isNull(), F.lit(0)).otherwise(F.pmod(row_hash, F.col(_FAN)).cast("int")))
        .drop(_FAN)
    )
    right = (
        other.join(hot, list(keys), "left")
        .withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_FAN), F.lit(1)) - 1)))
        .drop(_FAN)
    )
    return left, right


def attach(rows: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "left", hot_rows: int = HOT_ROWS,
           hot: DataFrame | None | object = _COUNT) -> DataFrame:
    """Join every row to the one ``dim`` row of its key (``left``, ``inner``, ``left_semi``, ``left_anti``).

    ``hot`` takes a result of ``hot_keys`` where the caller has already counted.
    """
    if hot is _COUNT:
        hot = hot_keys(rows, keys, hot_rows)
    if hot is None:
        return rows.join(dim, list(keys), how)
    left, right = spread(rows, dim, keys, hot)
    return left.join(right, [*keys, SALT], how).drop(SALT)


def attach_all(rows: DataFrame, counted: DataFrame, found: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS,
               broadcast_rows: int = 0) -> DataFrame:
    """Join every row to all ``found`` rows of its key, in tasks of about ``TASK_PAIRS`` results.

    ``counted`` holds the keys of ``rows`` and how many rows each has (``_n``). Spark cuts shuffles into tasks by
    the bytes that go in, which say nothing of the pairs that come out. The pairs of every key are therefore counted
    first; their sum gives the number of tasks, and keys with too many rows or pairs for one task are salted. Such a salt
    has about ``SALT_ROWS`` rows of its key or more, so copies of ``found`` rows stay few beside the pairs.
    """
    keys = list(keys)
    matches = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), F.sum(_bytes(found)).alias("_size"))
    n, m = F.col("_n"), F.coalesce(F.col("_m"), F.lit(0))
    by_pairs = (n * F.least(m / TASK_PAIRS, F.lit(1 / SALT_ROWS)) * hot_rows).cast("bigint")
    weighed = counted.join(matches, keys, "left").withColumns({"_pairs": n * m, "_weight": F.greatest(n, by_pairs)})
    totals = weighed.agg(F.sum("_m"), F.sum("_size"), F.sum("_pairs"), F.max("_weight")).first()
    n_found, size, pairs, most = (x or 0 for x in totals)
    spark = rows.sparkSession
    tasks = -(-pairs // TASK_PAIRS)
    many = tasks > spark.sparkContext.defaultParallelism
    if not many and n_found <= broadcast_rows and size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(found), keys)  # the rows are not shuffled, so no key can be too hot
    if most > hot_rows:
        rows, found = spread(rows, found, keys, hot_keys(weighed, keys, hot_rows, weight="_weight"))
        keys = [*keys, SALT]
    if many:  # a number of partitions that is asked for is not lowered at run time
        tasks = min(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), HOT_LIMIT)
        rows, found = rows.repartition(tasks, *keys), found.repartition(tasks, *keys)
    return rows.join(found.hint("merge"), keys).drop(SALT)
