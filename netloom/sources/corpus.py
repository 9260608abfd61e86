"""Flow tables as CSV, results as CSV and JSON, and a stamp of the run's environment."""

from __future__ import annotations

import json
import os
import platform

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from netloom.functions.exprs import micros, number, uniform

# Meta columns of flow tables and formats of their timestamps.
META = ["Flow ID", "Src IP", "Dst IP", "Timestamp", "Label"]
FORMATS = ["yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy hh:mm:ss a", "dd/MM/yyyy HH:mm", "dd/MM/yyyy HH:mm:ss"]


def schema(header: list[str]) -> StructType:
    """Strings for meta columns and doubles for the rest; nothing is inferred."""
    return StructType([StructField(h.strip(), StringType() if h.strip() in META else DoubleType()) for h in header])


def parse_time(c: Column | str) -> Column:
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in FORMATS))


def read_flows(spark: SparkSession, path: str, header: list[str], columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """A flow table with trimmed labels and parsed times; only `columns` are read."""
    df = spark.read.schema(schema(header)).option("header", True).option("enforceSchema", True).csv(path)
    df = df.select(*(f"`{c}`" for c in columns)) if columns else df
    if "Label" in df.columns:
        df = df.withColumn("Label", F.trim("Label"))
    if "Timestamp" in df.columns:
        df = df.withColumn("Timestamp", parse_time("Timestamp"))
    return df.limit(limit) if limit else df


def subsampled(df: DataFrame, benign_keep: float, key: list[str], seed: int = 0, benign: str = "BENIGN") -> tuple[DataFrame, DataFrame]:
    """(rows, counts): all attacks and a hash-chosen share of benign rows, without those that
    lack a label or a time; counts says how many were dropped for that. No sort: windows are
    by time and not by position."""
    bad = F.col("Label").isNull() | (F.col("Label") == "") | F.col("Timestamp").isNull()
    kept = df.where(~bad).where((F.col("Label") != benign) | (uniform(seed, *(F.col(c) for c in key)) < benign_keep))
    return kept, df.agg(F.count("*").alias("rows"), F.count_if(bad).alias("dropped"))


def matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as finite doubles."""
    return df.select(*(number(F.col(f"`{c}`")).alias(c) for c in columns))


def binary_labels(df: DataFrame, benign: str = "BENIGN") -> DataFrame:
    return df.withColumn("y", (F.col("Label") != benign).cast("int"))


def one_in(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """One row in n, by a hash of the key: the same rows on any cluster."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(n)) == 0)


def as_flows(df: DataFrame) -> DataFrame:
    """us, src, dst, dport, fwd_pkts, fwd_bytes, label for the window operators."""
    return df.select(micros("Timestamp").alias("us"), F.col("Src IP").alias("src"), F.col("Dst IP").alias("dst"), F.col("`Dst Port`").cast("int").alias("dport"), number(F.col("`Total Fwd Packet`")).alias("fwd_pkts"), number(F.col("`Total Length of Fwd Packet`")).alias("fwd_bytes"), F.col("Label").alias("label"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def environment(spark: SparkSession) -> dict:
    import numpy
    import pandas
    import pyarrow

    return {"spark": spark.version, "python": platform.python_version(), "numpy": numpy.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__, "cpus": os.cpu_count(), "master": spark.sparkContext.master, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}


def stamped(spark: SparkSession, payload: dict) -> str:
    """A verdict as JSON with the run's environment."""
    return json.dumps(payload | {"environment": environment(spark)}, sort_keys=True)
