"""Transitive closures of edge tables, safe on cycles."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut lineage: written to the cluster's shared folder and read back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, keys: list[str] | None = None, of: DataFrame | None = None) -> DataFrame:
    """keys, ancestor, node, depth: all pairs with their least distance, each node with itself.

    ``edges``: keys, parent, child. ``of``: keys, ancestor, the only ancestors that are wanted (all,
    where it is None). Semi-naive: each round joins only what the last one added, and anti-joins
    what is known, so that cycles end; rounds go on until nothing is new.
    """
    keys = keys or []
    ends = edges.select(*keys, F.col("parent").alias("node")).unionByName(edges.select(*keys, F.col("child").alias("node"))).distinct()
    starts = ends.select(*keys, F.col("node").alias("ancestor"), "node", F.lit(0).alias("depth"))
    known = saved(starts if of is None else starts.join(of.select(*keys, "ancestor").distinct(), [*keys, "ancestor"], "left_semi"), "closure")
    step = edges.select(*keys, F.col("parent").alias("node"), F.col("child").alias("next")).distinct()
    delta = known
    for depth in count(1):
        more = delta.join(step, [*keys, "node"]).select(*keys, "ancestor", F.col("next").alias("node")).distinct()
        delta = saved(more.join(known, [*keys, "ancestor", "node"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if delta.isEmpty():
            return known
        known = known.unionByName(delta)


def bag_closure(edges: DataFrame, most_depth: int) -> DataFrame:
    """ancestor, node, depth with one row per path; depth is bounded as paths may be many."""
    level = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("depth"))
    found, step = level, edges.select(F.col("parent").alias("node"), F.col("child").alias("next"))
    for depth in range(2, most_depth + 1):
        level = level.join(step, "node").select("ancestor", F.col("next").alias("node"), F.lit(depth).alias("depth"))
        found = found.unionByName(level)
    return found
