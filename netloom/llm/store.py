"""Tables, and the shared folder in which long plans are cut."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that Spark hands to a Python worker at once, but for a longer row; texts can be long.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or in local mode, where it
    is unset, as in tests, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "netloom-shared")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Bounds what one Arrow batch can hold; a session's own smaller bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def _lean(batches: Iterator, f: Callable[[Iterator], Iterator]) -> Iterator:
    try:
        yield from f(batches)
    finally:  # a worker waits for other tasks, and what it keeps then is missing elsewhere
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, f: Callable[[Iterator], Iterator], schema) -> DataFrame:
    """df.mapInArrow(f, schema) by workers that give memory back at the end of a task."""
    return df.mapInArrow(partial(_lean, f=f), schema)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place below the shared folder; the files of one application are together."""
    return f"{shared_dir(spark)}/netloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage ends there, and a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that cut() wrote and nothing reads any more."""
    _delete(df.sparkSession, df.cut_path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that are done; it does so once the driver has
    collected its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Deletes what this application has cut so far."""
    _delete(spark, f"{shared_dir(spark)}/netloom/{spark.sparkContext.applicationId}")
