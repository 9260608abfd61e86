import random

from pyspark.sql import functions as F

from netloom.operators.sessions import Timeouts, assemble
from netloom.schema import ACK, FIN, PSH, RST
from netloom.streaming import host_stream as HS
from netloom.streaming import sessions_stream as SS

S = 1_000_000


def files(spark, rows, schema, folder, n=4):
    """Rows in order of time, one file a micro-batch."""
    step = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.read.parquet(f"{folder}/in"), spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_stream_is_the_batch_but_for_open_windows(spark, tmp_path):
    r = random.Random(1)
    rows = sorted((int(r.uniform(0, 600) * S), f"a{r.randint(0, 6)}", f"b{r.randint(0, 9)}", r.randint(1, 50), 1.0, 10.0) for _ in range(1500))
    batch, stream = files(spark, rows, "us long, src string, dst string, dport int, fwd_pkts double, fwd_bytes double", tmp_path)
    whole = HS.host_cells(HS.with_time(batch), "60 seconds")
    got = HS.run_available(HS.host_cells(HS.with_time(stream), "60 seconds"), f"{tmp_path}/out", f"{tmp_path}/state")
    key = lambda df: {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*whole.columns).collect()}
    a, b = key(got), key(whole)
    assert a <= b and 0.7 < len(a) / len(b) < 1


def test_assembler_over_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(2)
    rows = sorted((int(r.uniform(0, 400) * S), r.choice("abcd"), r.choice([PSH | ACK] * 6 + [FIN | ACK, RST])) for _ in range(400))
    rows = [(i, us, src, "x", 1, 80, "tcp", 10.0, f) for i, (us, src, f) in enumerate(rows)]
    schema = "index long, us long, src_ip string, dst_ip string, src_port int, dst_port int, proto string, size double, flags int"
    batch, stream = files(spark, rows, schema, tmp_path)
    out = SS.assemble_stream(stream.withColumn("ts", F.timestamp_micros("us")), Timeouts())
    got = HS.run_available(out, f"{tmp_path}/out", f"{tmp_path}/state")
    key = lambda df, c: {(r[c], r["start_us"], r["last_us"], r["n_pkts"], r["close_reason"]) for r in df.collect()}
    a, b = key(got, "src_ip"), key(assemble(batch), "src")
    assert a <= b and len(a) > 0.8 * len(b)


def test_sessions_over_a_stream(spark, tmp_path):
    rows = [(i * 10 * S + (i // 5) * 60 * S, "a", "b", 1.0) for i in range(20)]
    batch, stream = files(spark, rows, "us long, src_ip string, dst_ip string, size double", tmp_path, 2)
    got = HS.run_available(HS.idle_sessions(HS.with_time(stream), "30 seconds"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert [r["n_pkts"] for r in got.orderBy("start").collect()] == [5, 5, 5]
    assert [r["n_pkts"] for r in HS.idle_sessions(HS.with_time(batch), "30 seconds").orderBy("start").collect()] == [5] * 4


def test_replay_closes_windows_on_the_way(spark, tmp_path):
    r = random.Random(3)
    # in no order of time, and many flows at the same second
    rows = [(r.randint(0, 1200) * S, f"a{r.randint(0, 6)}", f"b{r.randint(0, 9)}", r.randint(1, 50), 1.0, 10.0) for _ in range(4000)]
    flows = HS.with_time(spark.createDataFrame(rows, "us long, src string, dst string, dport int, fwd_pkts double, fwd_bytes double").repartition(5))
    whole = HS.host_cells(flows, "60 seconds")
    counts = {}
    stream = HS.replayed(flows, f"{tmp_path}/in", file_rows=250, batch_files=2)
    got = HS.run_available(HS.host_cells(stream, "60 seconds"), f"{tmp_path}/out", f"{tmp_path}/state", counts)
    assert counts["batches"] >= 8 and counts["late"] == 0 and counts["rows"] == len(rows)
    # what is held at the end are cells and pairs of the last windows alone
    assert counts["state_rows"] < 0.2 * whole.count() * 10
    got = HS.flushed_cells(got, flows, "60 seconds", 60)
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*whole.columns).collect())
    assert key(got) == key(whole)


def test_state_has_a_row_for_each_pair(spark, tmp_path):
    rows = [(i * S, f"a{i % 5}", f"b{i % 3}", 80, 1.0, 10.0) for i in range(50)]
    flows = HS.with_time(spark.createDataFrame(rows, "us long, src string, dst string, dport int, fwd_pkts double, fwd_bytes double"))
    counts = {}
    HS.run_available(HS.host_cells(HS.replayed(flows, f"{tmp_path}/in"), "60 seconds"), f"{tmp_path}/out", f"{tmp_path}/state", counts)
    assert counts["state_rows"] == 15  # both ends of a pair are made of one row
