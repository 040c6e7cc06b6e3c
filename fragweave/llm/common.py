"""Shared folder, written tables and skew-safe look-ups used by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import fragweave.llm

# Functions run in Python workers travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(fragweave.llm)

#: White space as the contracts of the operators define it.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary one; on a cluster that is an error, since
    executors could not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fragweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def _let_go(spark: SparkSession) -> None:
    """Let Spark delete shuffle files whose plans nothing holds any more; it does when the driver's JVM collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Cut lineage by a Parquet table in the shared folder; it survives the loss of any executor."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    _let_go(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shipped(spark: SparkSession, value: object) -> Callable[[], object]:
    """Broadcast an object of this package's own classes; call the result in a worker to have it back.

    A broadcast pickles classes by name, which needs the package on every executor, so the object
    travels as bytes that hold its class. A worker rebuilds it once and keeps it with the broadcast.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def value_of() -> object:
        if not hasattr(sent, "rebuilt"):
            sent.rebuilt = cloudpickle.loads(sent.value)
        return sent.rebuilt

    return value_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; 0 for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))


def look_up(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of rows to the one row of their key in ``groups``, whose ``size`` counts the rows.

    A key can hold more than 1/share of all rows only share times, so such keys fit a broadcast of
    at most ``share`` rows; every other key is small enough for one task of a sort-merge join.
    """
    is_hot = F.col(size) * share > F.lit(total)
    hot, rest = groups.where(is_hot), groups.where(~is_hot)
    keys = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(keys, key, "left_anti").join(rest.hint("merge"), key))
