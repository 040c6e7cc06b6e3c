"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fragweave.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): label is the smallest node it is connected to.

    Each round takes the least label among a node's neighbours and then the label of that label, so
    rounds grow with the logarithm of the longest path. Rounds are written tables.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node").hint("merge"), "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("_far"))
        step = step.join(jump.hint("merge"), "label", "left").select("node", "old", F.least("label", F.coalesce("_far", "label")).alias("label"))
        step = written(step, "labels")
        labels = step.select("node", "label")
        if step.where("label < old").isEmpty():
            return labels
