"""Per-host aggregates of tumbling windows over flows: sixteen features, exact.

Flows are summed by (window, src, dst) before they shuffle, and both sides of a cell are made of
these sums; distinct ports are one more grouping. Gaps between arrivals need order: they are
taken within slices of a window, and a window's slices are put together from their first and
last times, so a flooding source is many tasks and few rows meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from netloom.functions.exprs import entropy_of_counts, ratio, window_id
from netloom.schema import HOST_FEATURES

#: Windows after which a past volume weighs half.
HALF_LIFE = 5.0
ALPHA = 1 - 0.5 ** (1 / HALF_LIFE)


#: Slices of a window in which gaps are taken.
SLICES = 4


def windowed(flows: DataFrame, seconds: float, t0: int | None = None) -> DataFrame:
    """`flows` with `window`, counted from t0 or the first flow's time, and `slice`, a quarter
    of it. The first time is looked up at once (a minimum of one column), so that plans have it
    as a constant."""
    if t0 is None:
        t0 = flows.agg(F.min("us")).first()[0] or 0
    return flows.withColumns({"window": window_id(F.col("us"), t0, seconds), "slice": window_id(F.col("us"), t0, seconds / SLICES)})


def pairs(wf: DataFrame) -> DataFrame:
    """(window, src, dst, n, p, b): the flows, packets and bytes of each pair of hosts."""
    return wf.groupBy("window", "src", "dst").agg(F.count("*").alias("n"), F.sum("fwd_pkts").alias("p"), F.sum("fwd_bytes").alias("b"))


def gaps(wf: DataFrame) -> DataFrame:
    """(window, src, iat_mean, iat_cv) of the times between a source's flows in a window."""
    times = Window.partitionBy("window", "src", "slice").orderBy("us")
    inner = wf.select("window", "src", "slice", "us").withColumn("gap", (F.col("us") - F.lag("us").over(times)) / 1e6)
    part = inner.groupBy("window", "src", "slice").agg(F.count("gap").alias("g"), F.avg("gap").alias("m"), F.var_pop("gap").alias("v"), F.min("us").alias("first"), F.max("us").alias("last"))
    cell = Window.partitionBy("window", "src")
    part = part.withColumn("between", (F.col("first") - F.lag("last").over(cell.orderBy("slice"))) / 1e6)
    count = F.sum(F.col("g") + F.when(F.col("between").isNull(), 0).otherwise(1)).over(cell)
    part = part.withColumn("count", count).withColumn("mean", (F.max("last").over(cell) - F.min("first").over(cell)) / 1e6 / F.nullif(F.col("count"), F.lit(0)))
    squares = F.sum(F.coalesce(F.col("g") * (F.col("v") + F.pow(F.col("m") - F.col("mean"), F.lit(2.0))), F.lit(0.0)) + F.coalesce(F.pow(F.col("between") - F.col("mean"), F.lit(2.0)), F.lit(0.0)))
    out = part.groupBy("window", "src").agg(F.max("count").alias("count"), F.max("mean").alias("mean"), squares.alias("squares"))
    cv = F.when((F.col("count") >= 2) & (F.col("mean") > 1e-9), F.sqrt(F.col("squares") / F.nullif(F.col("count"), F.lit(0))) / F.col("mean")).otherwise(0.0)
    return out.select("window", "src", F.coalesce("mean", F.lit(0.0)).alias("iat_mean"), cv.alias("iat_cv"))


def ports(wf: DataFrame) -> DataFrame:
    """(window, src, dport), each once."""
    return wf.select("window", "src", "dport").where("dport is not null").distinct()


def src_cells(wf: DataFrame) -> DataFrame:
    """One row a (window, src) with its counts, sums, gaps and peer concentration."""
    sums = pairs(wf).groupBy("window", "src").agg(
        F.sum("n").alias("n_flows"),
        F.sum("p").alias("fwd_pkts"),
        F.sum("b").alias("fwd_bytes"),
        F.count("*").alias("n_peers"),
        (F.max("n") / F.sum("n")).alias("peer_concentration"),
    )
    n_ports = ports(wf).groupBy("window", "src").agg(F.count("*").alias("n_dports"))
    out = sums.join(n_ports, ["window", "src"], "left").withColumn("n_dports", F.coalesce("n_dports", F.lit(0))).join(gaps(wf), ["window", "src"])
    return out.withColumn("fanout_per_flow", ratio(F.col("n_peers").cast("double"), F.col("n_flows").cast("double")))


def dst_cells(wf: DataFrame) -> DataFrame:
    """One row a (window, dst) with its counts, sums and source entropy."""
    out = pairs(wf).groupBy("window", "dst").agg(
        F.sum("n").alias("n_flows"),
        F.count("*").alias("n_srcs"),
        F.sum("p").alias("fwd_pkts"),
        F.sum("b").alias("fwd_bytes"),
        entropy_of_counts(F.col("n").cast("double")).alias("src_entropy"),
    )
    return out.withColumn("flows_per_src", ratio(F.col("n_flows").cast("double"), F.col("n_srcs").cast("double")))


def _folded(batches: Iterator[pa.RecordBatch], decayed: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first two columns, a host and a window, with what the host's earlier
    values of the third come to. Holds one number a host, one host at a time."""
    host = last = value = None
    for batch in batches:
        past = []
        for h, w, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if h != host:
                host, last, value = h, None, None
            past.append(value or 0.0)
            if decayed:
                value = past[-1] * (0.5 ** ((w - last) / HALF_LIFE) if last is not None else 1.0) + x
                last = w
            else:
                value = x if value is None else (1 - ALPHA) * value + ALPHA * x
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(past, pa.float64())], [*batch.schema.names, "baseline"])


def with_baseline(cells: DataFrame, decayed: bool = False, host: str = "src", x: str = "fwd_bytes") -> DataFrame:
    """`cells` with bytes_vs_baseline: x over a host's exponentially weighted mean over its
    earlier windows, or its decayed sum, plus 1. A recurrence has no aggregate; a host has one
    row a window, so few rows are sorted and folded however many flows there are."""
    rest = [c for c in cells.columns if c not in (host, "window")]
    rows = cells.select(host, "window", F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias("_x"), *rest)
    schema = StructType([*rows.schema.fields, StructField("baseline", DoubleType())])
    rows = rows.repartition(host).sortWithinPartitions(host, "window").mapInArrow(partial(_folded, decayed=decayed), schema)
    return rows.withColumn("bytes_vs_baseline", F.col("_x") / (F.col("baseline") + 1)).drop("_x", "baseline")


def prefixed(cells: DataFrame, host: str, side: str) -> DataFrame:
    return cells.select("window", host, *(F.col(c).cast("double").alias(f"hw_{side}_{c}") for c in cells.columns if c not in ("window", host)))


def enriched_flows(wf: DataFrame) -> DataFrame:
    """Every flow with the sixteen features of its source's and its destination's cell."""
    out = wf.drop("slice").join(prefixed(with_baseline(src_cells(wf)), "src", "src"), ["window", "src"], "left").join(prefixed(dst_cells(wf), "dst", "dst"), ["window", "dst"], "left")
    return out.fillna(0.0, HOST_FEATURES)


def reattached(wf: DataFrame, cells: DataFrame, side: str) -> DataFrame:
    """Flows with the columns of `cells` (window, `side`, ...) of their window and host; 0 where there is no cell."""
    more = [c for c in cells.columns if c not in ("window", side)]
    return wf.drop("slice").join(cells, ["window", side], "left").fillna(0, more)


def host_cells(wf: DataFrame, decayed: bool = True) -> DataFrame:
    """One row a (window, host) with all sixteen features; what a host has no part in is 0."""
    src = prefixed(with_baseline(src_cells(wf), decayed), "src", "src").withColumnRenamed("src", "host")
    dst = prefixed(dst_cells(wf), "dst", "dst").withColumnRenamed("dst", "host")
    return src.join(dst, ["window", "host"], "full_outer").select("window", "host", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in HOST_FEATURES))


def unpivot_cells(wf: DataFrame) -> DataFrame:
    """The features without order of both sides of a (window, host): sums of pairs count for
    either end, and a row a port stands beside them, so one aggregation makes all."""
    end = lambda host, role: F.struct(F.col(host).alias("host"), F.lit(role).alias("role"))
    both = pairs(wf).select("window", F.explode(F.array(end("src", "src"), end("dst", "dst"))).alias("end"), "n", "p", "b").select("window", "end.*", "n", "p", "b")
    port = ports(wf).select("window", F.col("src").alias("host"), F.lit("port").alias("role"))
    one = both.unionByName(port, allowMissingColumns=True)
    src, dst = F.col("role") == "src", F.col("role") == "dst"

    def total(side: Column, c: str) -> Column:
        return F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0)).cast("double")

    def entropy(side: Column) -> Column:
        n = F.when(side, F.col("n").cast("double"))
        return F.coalesce(F.greatest(F.lit(0.0), F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)) + 0.0, F.lit(0.0))

    return one.groupBy("window", "host").agg(
        total(src, "n").alias("hw_src_n_flows"),
        F.count(F.when(src, 1)).cast("double").alias("hw_src_n_peers"),
        F.count(F.when(F.col("role") == "port", 1)).cast("double").alias("hw_src_n_dports"),
        total(src, "p").alias("hw_src_fwd_pkts"),
        total(src, "b").alias("hw_src_fwd_bytes"),
        (F.coalesce(F.max(F.when(src, F.col("n"))), F.lit(0)) / F.greatest(total(src, "n"), F.lit(1.0))).alias("hw_src_peer_concentration"),
        total(dst, "n").alias("hw_dst_n_flows"),
        F.count(F.when(dst, 1)).cast("double").alias("hw_dst_n_srcs"),
        total(dst, "p").alias("hw_dst_fwd_pkts"),
        total(dst, "b").alias("hw_dst_fwd_bytes"),
        entropy(dst).alias("hw_dst_src_entropy"),
    )
