"""Session helpers shared by the operators, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "fragweave", cpus: str | int = "*") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session you are given."""
    n = os.cpu_count() if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # Local files are small: let them split below the default cost of opening one.
        .config("spark.sql.files.openCostInBytes", str(512 << 10))
        .config("spark.sql.files.minPartitionNum", str(2 * n))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster. Where none is, a local session gets a temporary one and a cluster an
    error, since its executors could not read each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="fragweave-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def durable(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing a columnar table to the shared checkpoint folder.

    Iterative jobs scan the result many times, so a pruned, splittable Parquet table that
    survives the loss of any executor is preferred to cached blocks.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/fragweave-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fill_cluster(df: DataFrame) -> DataFrame:
    """Spread rows over all cores when a scan has few splits per core; otherwise do nothing.

    Meant for heavy per-row work on few files, where splits can even be empty because a file has
    fewer row groups than splits. A scan of a large table has many splits per core and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 4 * cores else df
