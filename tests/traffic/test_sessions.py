import random

import pytest

from netloom.operators.sessions import Timeouts, assemble, idle_sessions
from netloom.schema import ACK, FIN, PSH, RST

S = 1_000_000
SCHEMA = "index long, us long, src_ip string, dst_ip string, src_port int, dst_port int, proto string, size double, flags int"


def packets(spark, rows, proto="tcp"):
    return spark.createDataFrame([(i, int(t * S), a, b, 1234, 80, proto, 100.0, f) for i, (t, a, b, f) in enumerate(rows)], SCHEMA).repartition(3)


def flows(spark, rows, proto="tcp", **kw):
    out = assemble(packets(spark, rows, proto), Timeouts(**{k: int(v * S) for k, v in kw.items()})).collect()
    return sorted((r["src"], r["start_us"] / S, r["n_pkts"], r["close_reason"], r["emit_us"] / S) for r in out)


D = PSH | ACK


def test_start_time_and_idle(spark):
    assert flows(spark, [(100, "a", "b", D), (101, "a", "b", D), (102, "a", "b", D), (200, "c", "b", D)]) == [("a", 100, 3, "idle", 117), ("c", 200, 1, "idle", 215)]
    assert flows(spark, [(0, "a", "b", D), (15, "a", "b", D), (29.9, "a", "b", D)]) == [("a", 0, 1, "idle", 15), ("a", 15, 2, "idle", 44.9)]


def test_active(spark):
    got = flows(spark, [(i, "a", "b", D) for i in range(45)], active=20)
    assert [(x[1], x[2], x[3]) for x in got] == [(0, 20, "active"), (20, 20, "active"), (40, 5, "idle")]


def test_reset_and_fin(spark):
    assert flows(spark, [(0, "a", "b", D), (1, "a", "b", RST), (1.5, "a", "b", D)]) == [("a", 0, 2, "rst", 1), ("a", 1.5, 1, "idle", 16.5)]
    assert flows(spark, [(0, "a", "b", D), (1, "a", "b", FIN | ACK), (2, "a", "b", ACK), (3, "a", "b", D)]) == [("a", 0, 3, "fin", 3), ("a", 3, 1, "idle", 18)]
    assert [x[3] for x in flows(spark, [(0, "a", "b", FIN), (1, "a", "b", RST)], proto="udp")] == ["idle"]


def test_packets_are_kept(spark):
    r = random.Random(1)
    rows = [(r.uniform(0, 300), r.choice("abcd"), r.choice("xy"), r.choice([D, D, D, FIN, RST])) for _ in range(2000)]
    out = assemble(packets(spark, rows)).collect()
    assert sum(x["n_pkts"] for x in out) == 2000 and sum(x["n_bytes"] for x in out) == 200_000
    assert assemble(packets(spark, rows).limit(0)).collect() == []


def test_idle_alone_is_the_fold_without_other_rules(spark):
    r = random.Random(2)
    df = packets(spark, [(r.uniform(0, 900), r.choice("ab"), "x", D) for _ in range(400)])
    a = sorted((x["src"], x["start_us"], x["n_pkts"]) for x in assemble(df, Timeouts(active=10**15)).collect())
    b = sorted((x["src_ip"], x["start_us"], x["n_pkts"]) for x in idle_sessions(df, 15 * S, ["src_ip", "dst_ip"]).collect())
    assert a == b
