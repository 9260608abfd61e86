"""Count-min counts as a table, and how work would spread over shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.exprs import portable


def _cells(rows: DataFrame, key: str, depth: int, width: int) -> DataFrame:
    """Each row once for every line of the sketch, with its cell there."""
    lines = F.array(*(F.struct(F.lit(d).alias("line"), F.floor(portable(d, F.col(key)) * width).cast("int").alias("cell")) for d in range(depth)))
    return rows.withColumn("at", F.explode(lines)).select("*", "at.*").drop("at")


def count_min(rows: DataFrame, key: str, weight: Column | None = None, depth: int = 4, width: int = 2048) -> DataFrame:
    """(line, cell, n): a count-min sketch of at most depth * width rows; two of them are merged
    by adding their cells."""
    given = rows.select(key, (F.lit(1) if weight is None else weight).alias("w")).groupBy(key).agg(F.sum("w").alias("w"))
    return _cells(given, key, depth, width).groupBy("line", "cell").agg(F.sum("w").alias("n"))


def merged(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("line", "cell").agg(F.sum("n").alias("n"))


def estimates(sketch: DataFrame, keys: DataFrame, key: str, depth: int = 4, width: int = 2048) -> DataFrame:
    """(key, estimate), never under the count; a key that was not counted may have one, too."""
    asked = _cells(keys.select(key).distinct(), key, depth, width)
    found = asked.join(F.broadcast(sketch), ["line", "cell"], "left")  # depth * width rows at most
    return found.groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def shard_of(shards: int, *key: str) -> Column:
    return F.floor(portable(0, *(F.col(k) for k in key)) * shards).cast("int")


def shard_balance(rows: DataFrame, shards: int, *key: str) -> DataFrame:
    """(shard, n, over_mean): rows of each shard of the keys, and them over the mean of all shards."""
    n = rows.groupBy(shard_of(shards, *key).alias("shard")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard")).join(F.broadcast(n), "shard", "left").fillna(0, ["n"])
    mean = every.agg(F.avg("n").alias("mean"))
    return every.crossJoin(F.broadcast(mean)).select("shard", "n", F.when(F.col("mean") > 0, F.col("n") / F.col("mean")).otherwise(0.0).alias("over_mean"))
