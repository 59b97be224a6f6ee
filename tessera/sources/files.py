"""File lists: by size, first of each, batches, directories, task lists, upserts from JDBC rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.closure import saved

#: Bytes of files that Python holds at once; a larger file is alone.
PIECE_BYTES = 8 << 20


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a directory with their length; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")


def sized(rows: DataFrame, column: str, least: int, most_bytes: int, *, skip: int, most: int, order: str) -> DataFrame:
    return rows.where(F.col(column).between(least, most_bytes)).orderBy(order).offset(skip).limit(most)


def first_of_each(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(order))).where("_n = 1").drop("_n")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their number from 0 in a total order: ranges are sorted apart and saved, and the
    counts of the ranges, one row each, give their offsets."""
    ranges = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "ranges")
    counts = ranges.groupBy("_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("_p").orderBy("_i")) - 1
    return ranges.withColumn("_k", inside).join(F.broadcast(counts.select("_p", before.alias("_b"))), "_p").withColumn(name, F.col("_b") + F.col("_k")).drop("_p", "_i", "_k", "_b")


def batched(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Number batches of ``size`` rows in order."""
    return numbered(rows, order, "batch").withColumn("batch", F.floor(F.col("batch") / size).cast("bigint"))


def task_list(lines: DataFrame) -> DataFrame:
    """name and concept of lines ``name TAB concepts by blanks``."""
    cut = F.split("value", "\t")
    return lines.select(F.get(cut, 0).alias("name"), F.explode(F.split(F.get(cut, 1), " +")).alias("concept"))


def zipped(rows: DataFrame, key: str) -> DataFrame:
    """``key`` and ``archive``, a zip of the key's files (name string, content binary), in order of
    names. An archive is one value, so its files meet in one task; a null content is an empty file,
    rows without a name are left out, and of equal names each stays an entry. No rows, no archives."""

    def packed(key_of: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, content in sorted(((n, bytes(c) if c is not None else b"") for n, c in zip(frame["name"], frame["content"], strict=True))):
                archive.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({key: [key_of[0]], "archive": [out.getvalue()]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.where("name is not null").select(key, "name", "content").groupBy(key).applyInPandas(packed, f"`{key}` {kind}, archive binary")


def unzipped(archives: DataFrame, key: str) -> DataFrame:
    """key, name, content of every entry of every archive, in pieces of few bytes; null archives have none."""

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, data in zip(frame[key], frame["archive"], strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as archive:
                    held, size = [], 0
                    for info in archive.infolist():
                        if held and size + info.file_size > PIECE_BYTES:
                            yield pd.DataFrame(held, columns=[key, "name", "content"])
                            held, size = [], 0
                        held.append((k, info.filename, archive.read(info)))
                        size += info.file_size
                    yield pd.DataFrame(held, columns=[key, "name", "content"])

    kind = archives.schema[key].dataType.simpleString()
    return archives.where("archive is not null").select(key, "archive").mapInPandas(entries, f"`{key}` {kind}, name string, content binary")
