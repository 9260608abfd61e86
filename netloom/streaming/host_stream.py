"""Host-window cells and idle sessions over streams.

A stream has no exact distinct count, but a chain of two windowed aggregations does: first
(window, src, dst), then (window, host) over both ends of these pairs. State is one row a pair,
and both levels are closed by the same watermark. A table at rest is replayed in order of time,
some rows a micro-batch, so that windows close on the way and state holds those that are open.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.exprs import entropy_of_counts


#: Rows of a file of a replay, and files of a micro-batch.
FILE_ROWS, BATCH_FILES = 250_000, 8


def with_time(flows: DataFrame) -> DataFrame:
    """`flows` with `ts`, a timestamp with zone, from `us`: watermarks refuse others."""
    return flows.withColumn("ts", F.timestamp_micros("us"))


def unpivoted(pairs: DataFrame, roles: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """A row a pair for each of the roles that its ends can have; ports go with the source."""
    other = {"src": "dst", "dst": "src"}
    end = lambda host, peer, role: F.struct(F.col(host).alias("host"), F.col(peer).alias("peer"), F.lit(role).alias("role"))
    rows = pairs.select("w", "n", "p", "b", "ports", F.explode(F.array(*(end(r, other[r], r) for r in roles))).alias("end"))
    return rows.select("w", "n", "p", "b", F.when(F.col("end.role") == "src", F.col("ports")).alias("ports"), "end.*")


def host_cells(flows: DataFrame, width: str, lateness: str = "15 seconds", start: str = "0 seconds", roles: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """One row a closed (window, host): counts, sums, peers, concentration and source entropy.

    Flows later than the watermark are dropped, and Spark's progress counts them. In a batch
    the same plan gives all windows: that is the flush of a finished input."""
    rows = flows.select("ts", "src", "dst", "dport", "fwd_pkts", "fwd_bytes")
    if flows.isStreaming:
        rows = rows.withWatermark("ts", lateness)
    by_pair = rows.groupBy(F.window("ts", width, startTime=start).alias("w"), "src", "dst").agg(F.count("*").alias("n"), F.sum("fwd_pkts").alias("p"), F.sum("fwd_bytes").alias("b"), F.collect_set("dport").alias("ports"))
    by_peer = unpivoted(by_pair, roles)
    src, dst = F.col("role") == "src", F.col("role") == "dst"
    total = lambda side, c: F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0)).cast("double")
    n_dst = F.when(dst, F.col("n").cast("double"))
    # the second window is the first one's, by its time, so one watermark closes both
    out = by_peer.groupBy(F.window(F.window_time("w"), width, startTime=start).alias("w"), "host").agg(
        total(src, "n").alias("hw_src_n_flows"),
        F.count(F.when(src, 1)).cast("double").alias("hw_src_n_peers"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(src, F.col("ports")))))).cast("double").alias("hw_src_n_dports"),
        total(src, "p").alias("hw_src_fwd_pkts"),
        total(src, "b").alias("hw_src_fwd_bytes"),
        (F.coalesce(F.max(F.when(src, F.col("n"))), F.lit(0)) / F.greatest(total(src, "n"), F.lit(1.0))).alias("hw_src_peer_concentration"),
        total(dst, "n").alias("hw_dst_n_flows"),
        F.count(F.when(dst, 1)).cast("double").alias("hw_dst_n_srcs"),
        total(dst, "p").alias("hw_dst_fwd_pkts"),
        total(dst, "b").alias("hw_dst_fwd_bytes"),
        F.coalesce(entropy_of_counts(n_dst), F.lit(0.0)).alias("hw_dst_src_entropy"),
    )
    return out.withColumn("window_start", F.col("w.start")).drop("w")


def idle_sessions(packets: DataFrame, idle: str, lateness: str = "15 seconds") -> DataFrame:
    """Sessions of a (src_ip, dst_ip) by idle time, closed by the watermark."""
    rows = packets.withWatermark("ts", lateness) if packets.isStreaming else packets
    out = rows.groupBy(F.session_window("ts", idle).alias("w"), "src_ip", "dst_ip").agg(F.count("*").alias("n_pkts"), F.sum("size").alias("n_bytes"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "src_ip", "dst_ip", "n_pkts", "n_bytes")


def run_available(stream: DataFrame, path: str, checkpoint: str, counts: dict | None = None) -> DataFrame:
    """Runs a stream over all that is there, appends to Parquet at `path`, and reads it; `counts`
    takes what progress() gives."""
    spark, key = stream.sparkSession, "spark.sql.streaming.minBatchesToRetain"
    before = spark.conf.get(key)
    spark.conf.set(key, "2")  # a checkpoint serves this one run
    try:
        query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    finally:
        spark.conf.set(key, before)
    while not query.awaitTermination(10):
        spark._jvm.System.gc()  # shuffle files of past micro-batches go once the driver has collected its garbage
    if counts is not None:
        counts |= progress(query)
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def replayed(flows: DataFrame, path: str, file_rows: int = FILE_ROWS, batch_files: int = BATCH_FILES) -> DataFrame:
    """`flows` (ts, ...) as a stream in order of time: written to `path` in files of time ranges,
    of which a micro-batch takes so many. Rows of one time may be in two files and come in two
    micro-batches; none is late, as its window ends after that time.

    A stream takes files by the time of their last change, which is set to their order; where a
    file system does not keep it, all files are one micro-batch."""
    spark = flows.sparkSession
    files = max(1, -(-flows.count() // file_rows))
    flows.repartitionByRange(files, "ts").write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listed = lambda: sorted((x for x in fs.listStatus(folder) if x.getPath().getName().startswith("part-")), key=lambda x: x.getPath().getName())
    found = listed()
    first = min(x.getModificationTime() for x in found) // 1000 * 1000
    for i, x in enumerate(found):
        fs.setTimes(x.getPath(), first + 1000 * i, -1)
    reader = spark.readStream.schema(flows.schema)
    if [x.getModificationTime() for x in listed()] == [first + 1000 * i for i in range(len(found))]:
        batches = -(-files // batch_files)
        reader = reader.option("maxFilesPerTrigger", -(-len(found) // batches))
    return reader.parquet(path)


def progress(query) -> dict:
    """Rows in, rows too late for the watermark, and rows of state that are held at the end, of
    the micro-batches that Spark still knows of."""
    batches = [json.loads(p.json) if hasattr(p, "json") else p for p in query.recentProgress]
    states = [s for p in batches for s in p.get("stateOperators", [])]
    last = [s for p in batches[-1:] for s in p.get("stateOperators", [])]
    return {
        "batches": len(batches),
        "rows": sum(p.get("numInputRows", 0) for p in batches),
        "late": sum(s.get("numRowsDroppedByWatermark", 0) for s in states),
        "state_rows": sum(s.get("numRowsTotal", 0) for s in last),
    }


def flushed_cells(emitted: DataFrame, flows: DataFrame, width: str, seconds: float) -> DataFrame:
    """What a stream of host cells emitted, and the windows that it held open when its input
    ended: those after the last one emitted, by the same plan over their flows alone."""
    last = emitted.agg(F.max(F.unix_micros("window_start"))).first()[0]
    tail = flows if last is None else flows.where(F.unix_micros("ts") >= last + int(seconds * 1e6))
    return emitted.unionByName(host_cells(tail, width))


def flushed_sessions(emitted: DataFrame, packets: DataFrame, key: list[str], ends: str, rest) -> DataFrame:
    """Emitted sessions, and those of the packets of each key that come after its last one:
    `rest` makes sessions of packets, `ends` names an emitted session's end in microseconds."""
    known = emitted.groupBy(*key).agg(F.max(ends).alias("_end"))
    after = packets.join(known, key, "left").where("_end is null or us > _end").drop("_end")
    return emitted.unionByName(rest(after).select(*emitted.columns))


def discard(spark, path: str) -> None:
    """Deletes what a finished stream read or kept and nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run_folder(spark, name: str, key: str) -> str:
    """A fresh folder in the shared place of the session; a local one in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "netloom-streams")
    tag = hashlib.sha256(f"{spark.sparkContext.applicationId}{key}{os.urandom(8).hex()}".encode()).hexdigest()[:16]
    return f"{base.rstrip('/')}/streams/{name}-{tag}"
