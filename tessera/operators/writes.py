"""Writes as functions that return the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upserted(table: DataFrame, changes: DataFrame, key: list[str], recreate: bool = True) -> DataFrame:
    """Rows of ``changes`` update those of equal key or are added; without ``recreate`` an
    existing row is never overwritten. Columns that ``changes`` lacks keep their value."""
    if not recreate:
        return table.unionByName(changes.join(table.select(*key), key, "left_anti"), allowMissingColumns=True)
    rest = [c for c in table.columns if c not in key]
    news = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c in rest], F.lit(True).alias("_hit"))
    both = table.withColumn("_had", F.lit(True)).join(news, key, "full")
    value = lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns else F.col(c)
    return both.select(*[F.col(c) if c in key else value(c) for c in table.columns])


def allocated(dictionary: DataFrame, names: DataFrame) -> DataFrame:
    """Give new names the next bits after the highest; beyond 2**62 is an error."""
    new = names.select("name").distinct().join(dictionary.select("name"), "name", "left_anti")
    # A dictionary has 63 entries at most, so one window over its new names is bounded.
    at = F.row_number().over(W.orderBy("name")) - 1
    top = dictionary.agg(F.coalesce(F.max("bit"), F.lit(0)).alias("top"))
    exponent = F.when(F.col("top") == 0, 0).otherwise(F.round(F.log2(F.col("top").cast("double"))).cast("int") + 1) + F.col("at")
    bits = new.withColumn("at", at).crossJoin(F.broadcast(top)).withColumn("e", exponent)
    bit = F.when(F.col("e") > 62, F.raise_error(F.lit("no bit is left in the dictionary"))).otherwise(F.pow(F.lit(2.0), F.col("e")).cast("bigint"))
    return dictionary.select("name", "bit").unionByName(bits.select("name", bit.alias("bit")))


def advanced(table: DataFrame, stages: DataFrame, key: str) -> DataFrame:
    """Stages only move forward."""
    s = stages.select(key, F.col("stage").alias("_to"))
    return table.join(s, key, "left").withColumn("stage", F.greatest("stage", F.coalesce("_to", "stage"))).drop("_to")


def used(table: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """Count a use where a request loaded exactly one question. loaded: request and key."""
    one = loaded.groupBy("request").agg(F.count("*").alias("n"), F.first(key).alias(key)).where("n = 1")
    counts = one.groupBy(key).agg(F.count("*").alias("_more"), F.max("request").alias("last_request"))
    return table.join(counts, key, "left").withColumn("used_count", F.col("used_count") + F.coalesce("_more", F.lit(0))).drop("_more")


def reached_stage(paths: list) -> F.Column:
    """The last role in order that has a path, stopping at the first gap; 0 if none."""
    stage = F.lit(len(paths))
    for k in range(len(paths) - 1, -1, -1):
        stage = F.when(paths[k].isNull(), k).otherwise(stage)
    return stage
