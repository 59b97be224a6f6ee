"""Connected components of an edge table by the least node id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component of every node of the edges (a, b); the component is its least node.

    Each round takes the least label of all neighbours and then the label's own label, so labels
    travel twice as far each time; every round is written, and counts stay on the executors.
    """
    edges = edges.where("a <> b").select("a", "b").distinct()
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("node"), "label"), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = stored(least.join(jump, "next", "left").select("node", F.col("label").alias("was"), F.least("next", F.coalesce("far", "next")).alias("label")), "cc-labels")
        labels = moved.select("node", "label")
        if moved.where("was <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
