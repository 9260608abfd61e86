"""Queries that run streams over the tables with availableNow and return what they emitted."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions.exprs import micros
from netloom.operators.sessions import Timeouts, assemble
from netloom.plans import traffic
from netloom.schema import ACK, FIN, PSH, RST, SYN
from netloom.sources import tables as T
from netloom.streaming import host_stream as HS
from netloom.streaming import sessions_stream as SS

QUERIES, ORACLE = {}, {}
DAY_US = 86_400_000_000


def _stream(spark, sf_dir, name):
    path = f"{sf_dir}/{name}.parquet"
    # a table may be one file, which streams only take by a pattern
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/{name}.parque[t]")


WIDTH_US = 30 * DAY_US
CELLS = ["hw_src_n_flows", "hw_src_n_peers", "hw_src_n_dports", "hw_src_fwd_pkts", "hw_src_fwd_bytes", "hw_src_peer_concentration", "hw_dst_n_flows", "hw_dst_n_srcs", "hw_dst_fwd_pkts", "hw_dst_fwd_bytes", "hw_dst_src_entropy"]


def _flows(rows):
    flows = rows.select(micros("l_shipdate").alias("us"), F.col("l_suppkey").cast("string").alias("src"), (F.col("l_partkey") % 50).cast("string").alias("dst"), F.col("l_linenumber").alias("dport"), F.col("l_quantity").alias("fwd_pkts"), F.col("l_extendedprice").alias("fwd_bytes"))
    return HS.with_time(flows)


def stream_host_window(spark, sf_dir):
    """Host cells of 30-day windows over the flow table, replayed as a stream in order of time, with
    those open at its end. No flow may be late."""
    folder, flows, counts = HS.run_folder(spark, "host-window", sf_dir), _flows(T.read(spark, sf_dir, "lineitem")), {}
    stream = HS.replayed(flows, f"{folder}/in")
    out = HS.run_available(HS.host_cells(stream, "30 days"), f"{folder}/out", f"{folder}/state", counts)
    if counts["late"]:
        raise RuntimeError(f"{counts['late']} rows of an ordered replay came late")
    for done in ("in", "state"):
        HS.discard(spark, f"{folder}/{done}")
    out = HS.flushed_cells(out, flows, "30 days", WIDTH_US / 1e6)
    return out.select(F.floor(F.unix_micros("window_start") / WIDTH_US).cast("long").alias("window"), "host", *(F.round(c, 4).alias(c) for c in CELLS))


def stream_session(spark, sf_dir):
    """Idle sessions of a user and event type over the event table as a stream, with those open at its end."""
    idle = 6 * 3_600_000_000

    def packets(rows):
        us = micros("ts")
        return rows.select(us.alias("us"), F.timestamp_micros(us).alias("ts"), F.col("user_id").cast("string").alias("src_ip"), F.col("event_type").alias("dst_ip"), F.col("value").alias("size"))

    def sessions(rows):
        return HS.idle_sessions(rows, "6 hours").select("src_ip", "dst_ip", F.unix_micros("start").alias("start_us"), (F.unix_micros("end") - idle).alias("last_us"), "n_pkts", "n_bytes")

    folder = HS.run_folder(spark, "session", sf_dir)
    out = HS.run_available(sessions(packets(_stream(spark, sf_dir, "events"))), f"{folder}/out", f"{folder}/state")
    out = HS.flushed_sessions(out, packets(T.read(spark, sf_dir, "events")), ["src_ip", "dst_ip"], "last_us", sessions)
    return out.withColumn("n_bytes", F.round("n_bytes", 4))


def stream_session_full(spark, sf_dir):
    """The four-rule assembler over the event table as a stream, with flows open at its end."""
    kind = F.col("event_type")
    flags = F.when(kind == "error", RST).when(kind == "purchase", FIN | ACK).when(kind == "signup", SYN).otherwise(PSH | ACK)
    timeouts = Timeouts(6 * 3_600_000_000, 3 * DAY_US, 3_600_000_000)
    key = ["src_ip", "dst_ip", "src_port", "dst_port", "proto"]

    def packets(rows):
        rows = rows.withColumn("us", micros("ts"))
        return rows.select(F.col("event_id").alias("index"), "us", F.timestamp_micros("us").alias("ts"), F.col("user_id").cast("string").alias("src_ip"), kind.alias("dst_ip"), F.lit(0).alias("src_port"), F.lit(80).alias("dst_port"), F.lit("tcp").alias("proto"), F.col("value").alias("size"), flags.alias("flags"))

    def rest(rows):
        out = assemble(rows, timeouts)
        return out.withColumnsRenamed({"src": "src_ip", "dst": "dst_ip"}).select("src_ip", "dst_ip", F.lit(0).alias("src_port"), F.lit(80).alias("dst_port"), F.lit("tcp").alias("proto"), "start_us", "last_us", "n_pkts", "n_bytes")

    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = HS.run_folder(spark, "session-full", sf_dir)
    flows = SS.assemble_stream(packets(_stream(spark, sf_dir, "events")), timeouts)
    try:
        out = HS.run_available(flows, f"{folder}/out", f"{folder}/state")
    finally:
        spark.conf.set(provider, before)
    out = out.select(*key, "start_us", "last_us", "n_pkts", "n_bytes")
    out = HS.flushed_sessions(out, packets(T.read(spark, sf_dir, "events")), key, "last_us", rest)
    return out.select(F.col("src_ip").alias("src"), F.col("dst_ip").alias("dst"), "start_us", "last_us", "n_pkts", F.round("n_bytes", 4).alias("n_bytes"))


QUERIES |= {f.__name__: f for f in (stream_host_window, stream_session, stream_session_full)}
# a stream and what it held open at its end are what the batch gives
ORACLE |= {
    "stream_host_window": traffic.ORACLE["role_unpivot_cells"].replace("FROM flows, origin)", "FROM flows, (SELECT 0 AS t0))", 1),
    "stream_session": traffic.ORACLE["session_idle"].replace("CAST(session AS BIGINT) AS session, ", "", 1).replace("FROM n GROUP BY ALL", "FROM n GROUP BY src_ip, dst_ip, session", 1),
    "stream_session_full": traffic.ORACLE["session_full"],
}
