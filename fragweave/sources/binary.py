"""Readers of the binary genome formats, registered as Spark data sources.

``register_all(spark)``, then ``spark.read.format("bam").load(path)``. Planning reads headers and
indexes at most; every task opens the file on its own, so a file is read in parallel and a lost task
is simply repeated. A region given as an option, as the functions below do, is looked up in the
file's own index.

With the option ``push`` and spark.sql.python.filterPushdown.enabled the sources also take filters from
Spark. Neither is on by default: Spark 4.1 keeps pushed filters with the loaded DataFrame, so that a
second query on it, filtered otherwise, sees the first one's rows; one load then serves one query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragweave.sources.bam import BAM_BASES, BAM_OPS, BamReader, BamSource, PushingBamReader  # noqa: F401
from fragweave.sources.bigwig import BigWigReader, BigWigSource, PushingBigWigReader  # noqa: F401
from fragweave.sources.twobit import TWOBIT_BASES, PushingTwoBitReader, TwoBitReader, TwoBitSource  # noqa: F401



def register_all(spark: SparkSession) -> None:
    for source in (BamSource, TwoBitSource, BigWigSource):
        spark.dataSource.register(source)


def reads_in(spark: SparkSession, path: str, chrom: str, lo: int, hi: int, **options: object) -> DataFrame:
    """Reads of a BAM file that overlap the closed range; only the index's blocks for it are opened."""
    reads = spark.read.format("bam").options(region=f"{chrom}:{lo}-{hi}", **options).load(path)
    return reads.where((F.col("chr") == chrom) & (F.col("pos") <= hi) & (F.col("end_pos") >= lo))


def values_in(spark: SparkSession, path: str, chrom: str, lo: int, hi: int, **options: object) -> DataFrame:
    """Intervals of a bigWig file that overlap the closed range."""
    track = spark.read.format("bigwig").options(region=f"{chrom}:{lo}-{hi}", **options).load(path)
    return track.where((F.col("chr") == chrom) & (F.col("lo") <= hi) & (F.col("hi") >= lo))


def chunks_in(spark: SparkSession, path: str, chrom: str, start: int, end: int, *, chunk: int = 1 << 16, **options: object) -> DataFrame:
    """Chunks of a 2bit file that hold 0-based positions start to end - 1."""
    first = max(start // chunk * chunk, 0)
    genome = spark.read.format("twobit").options(region=f"{chrom}:{first}-{end - 1}", chunk=chunk, **options).load(path)
    return genome.where((F.col("chr") == chrom) & (F.col("chunk_start") > start - chunk) & (F.col("chunk_start") < end))
