"""Intermediate tables, free column names and driver-side limits shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Where the session names none, a private one serves
    a local session; anywhere else that would lose data, so it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: lost executors cost a re-read, not a recomputation.  Meanwhile Arrow
    batches to Python workers hold BATCH_BYTES at most: executor and worker both hold a batch of every task, outside of the heap."""
    path = f"{shared_folder(df.sparkSession)}/llm-{label}-{uuid.uuid4().hex}"
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(BATCH_CONF)
    conf.set(BATCH_CONF, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        conf.set(BATCH_CONF, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have yet."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name = "_" + name
    return name


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Marks a stored table for broadcast if it has at most `rows` rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lean(run):
    """A kernel for mapInArrow like `run`, after whose task the worker, which other stages use again, gives back what it has freed."""
    def kernel(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass
    return kernel
