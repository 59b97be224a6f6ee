"""The stage machine as a stream: each batch of events moves questions forward, never back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import writes


def moves(events: DataFrame) -> DataFrame:
    """id and stage that each event of a question asks for."""
    stage = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    return events.groupBy((F.col("user_id") * 10 + F.col("event_id") % 10).alias("id")).agg(F.max(stage).alias("stage"))


def run(spark: SparkSession, path: str, out: str, checkpoint: str) -> DataFrame:
    """Process all events that are there, batch by batch, and return the table of stages. Each
    batch writes a new version of the table, so a batch that runs twice gives the same rows."""
    schema = spark.read.parquet(path).schema

    def apply(batch: DataFrame, number: int) -> None:
        asked = moves(batch)
        before = None if number == 0 else spark.read.parquet(f"{out}/v={number - 1}")
        if before is None:
            after = asked
        else:
            known = writes.advanced(before, asked, "id")
            after = known.unionByName(asked.join(before.select("id"), "id", "left_anti"))
        after.write.mode("overwrite").parquet(f"{out}/v={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    last = (query.lastProgress or {}).get("batchId", 0)
    return spark.read.parquet(f"{out}/v={last}")


def windowed(spark: SparkSession, path: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events of a kind per window, as a stream with a watermark."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
