"""Flow assembly: packets of one key become flows by four rules.

A flow ends with RST (that packet included), two seconds after FIN, 120 seconds after its
start, or 15 seconds after its last packet. Where the next cut depends on the last one there
is no window function for it: a fold runs over each key's packets in order of time, a batch
of rows at a time. Idle timeouts alone are a running sum, without Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.ordered import numbered, running

from netloom.schema import FIN, RST

KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "proto"]
SESSIONS = "src string, dst string, sport int, dport int, proto string, start_us long, last_us long, emit_us long, n_pkts long, n_bytes double, close_reason string"


@dataclass(frozen=True)
class Timeouts:
    """Microseconds."""

    idle: int = 15_000_000
    active: int = 120_000_000
    grace: int = 2_000_000


def closes(us: int, start: int, last: int, fin: int | None, t: Timeouts) -> tuple[int, str] | None:
    """When and why an open flow ended before a packet at `us`; of rules that are due, FIN
    counts before active and active before idle."""
    if fin is not None and fin <= us - t.grace:
        return fin + t.grace, "fin"
    if start <= us - t.active:
        return start + t.active, "active"
    if last <= us - t.idle:
        return last + t.idle, "idle"
    return None


class Fold:
    """The open flow of one key."""

    def __init__(self, timeouts: Timeouts):
        self.t = timeouts
        self.open = False

    def close(self, at: int, why: str) -> tuple:
        self.open = False
        return (self.start, self.last, at, self.n, self.bytes, why)

    def push(self, us: int, size: float, flags: int, tcp: bool) -> Iterator[tuple]:
        if self.open and (end := closes(us, self.start, self.last, self.fin, self.t)):
            yield self.close(*end)
        if not self.open:
            self.open, self.start, self.n, self.bytes, self.fin = True, us, 0, 0.0, None
        self.last, self.n, self.bytes = us, self.n + 1, self.bytes + size
        if tcp and flags & RST:
            yield self.close(us, "rst")
        elif tcp and flags & FIN and self.fin is None:
            self.fin = us

    def flush(self) -> Iterator[tuple]:
        """At the end of the input: what is open ends by the rule that is due first."""
        if self.open:
            due = [(self.fin + self.t.grace, 0, "fin")] if self.fin is not None else []
            at, _, why = min([*due, (self.start + self.t.active, 1, "active"), (self.last + self.t.idle, 2, "idle")])
            yield self.close(at, why)


def _assemble(batches: Iterator[pa.RecordBatch], timeouts: Timeouts) -> Iterator[pa.RecordBatch]:
    fold, key = Fold(timeouts), None
    out: list[tuple] = []
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
    names = [x.split()[0] for x in SESSIONS.split(", ")]

    def batch_out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        for *k, us, size, flags in zip(*cols, strict=True):
            if k != key:
                out += [(*key, *r) for r in fold.flush()] if key is not None else []
                fold, key = Fold(timeouts), k
            out += [(*k, *r) for r in fold.push(us, size or 0.0, flags or 0, k[4] == "tcp")]
        if len(out) >= 1 << 14:
            yield batch_out()
            out = []
    if key is not None:
        out += [(*key, *r) for r in fold.flush()]
    yield batch_out()


def assemble(packets: DataFrame, timeouts: Timeouts = Timeouts()) -> DataFrame:
    """Flows of `packets` (KEY, us, size, flags, index). One shuffle by key, sorted within: the
    fold holds one open flow, not a key's packets."""
    rows = packets.select(*KEY, "us", F.col("size").cast("double").alias("size"), "flags", "index")
    ordered = rows.repartition(*KEY).sortWithinPartitions(*KEY, "us", "index").drop("index")
    return ordered.mapInArrow(partial(_assemble, timeouts=timeouts), SESSIONS)


def idle_sessions(packets: DataFrame, idle_us: int, key: list[str]) -> DataFrame:
    """Sessions by idle time alone: a gap of `idle_us` or more begins a new one."""
    w = Window.partitionBy(*key).orderBy("us", "index")
    new = F.coalesce((F.col("us") - F.lag("us").over(w) >= idle_us).cast("int"), F.lit(1))
    rows = packets.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*key, "session").agg(F.min("us").alias("start_us"), F.max("us").alias("last_us"), F.count("*").alias("n_pkts"), F.sum("size").alias("n_bytes"))


def lateness(sessions: DataFrame, t0: int, window_us: int, allowed: list[int]) -> DataFrame:
    """For each allowed lateness: how many flows come after their window has closed. A flow is
    seen when it is emitted and belongs to the window of its start; a window w is closed once a
    start over (w + 1) windows and the lateness has been seen. The running maximum of what
    was seen is over the whole stream; it is taken in buckets of emission times."""
    ticks = sessions.groupBy("emit_us").agg(F.max("start_us").alias("top"))
    upto = running(ticks, "emit_us", {"upto": ("max", F.col("top"))})
    # what was seen before a time: the maximum up to the time before it
    at = numbered(upto, "emit_us")
    seen = at.select("emit_us", "number").join(at.select((F.col("number") + 1).alias("number"), F.col("upto").alias("seen")), "number", "left").drop("number")
    rows = sessions.join(seen, "emit_us")
    w = F.floor((F.col("start_us") - t0) / window_us)
    rows = rows.withColumn("allowed", F.explode(F.array(*map(F.lit, allowed))))
    late = F.coalesce(F.col("seen") - t0 > (w + 1) * window_us + F.col("allowed"), F.lit(False))
    return rows.groupBy("allowed").agg(F.count("*").alias("n"), F.count_if(late).alias("dropped"))
