"""Helpers the training-data operators share: tables, shared storage, checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its measured size stays under this many bytes.
BROADCAST_BYTES = 32 << 20
#: White space that separates words: space and the controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Rows and bytes of text that Python handles at once; a longer text is alone.
PIECE_ROWS = 512
PIECE_BYTES = 1 << 20
#: Settings of a step whose result is stored: shuffle files go when the query that wrote them has
#: ended, and Arrow batches are small, since buffers outside of the heap are kept for the next ones.
STEP_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(PIECE_BYTES),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, as in tests."""
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one that goes
    with the process, in local mode only; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with other settings, for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    with settings(spark, STEP_SETTINGS):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freed() -> None:
    """Give free memory back to the system: a Python worker lives on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def small(batches: Iterator[pa.RecordBatch], rows: int = PIECE_ROWS, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of few rows and bytes, so that what Python makes of a batch of texts
    stays small; a row of more bytes is a piece of its own. At a task's end memory is given back,
    which Arrow's memory is with the other, if it comes from the same allocator."""
    pa.set_memory_pool(pa.system_memory_pool())
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = min(start + rows, max(start + 1, int(np.searchsorted(total, before + most, "right"))))
            yield batch.slice(start, end - start)
            start = end
    freed()


def stored_bytes(df: DataFrame) -> int:
    """Catalyst's size of a stored table, which for files is their length."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits(df: DataFrame, expand: int = 3) -> bool:
    """Whether a stored table, ``expand`` times its file size in memory, may be broadcast."""
    return stored_bytes(df) * expand <= BROADCAST_BYTES


def checked(df: DataFrame, expand: int = 3) -> DataFrame:
    """Hint a broadcast for a stored table within the bound; leave a larger one to a shuffle join."""
    return F.broadcast(df) if fits(df, expand) else df


def words_of(text: Column) -> Column:
    """The words of a text, in order; null counts as no text."""
    solid = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(solid == "", F.array().cast("array<string>")).otherwise(F.split(solid, WORD_GAP))


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")
