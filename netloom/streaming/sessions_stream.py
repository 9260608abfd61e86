"""The four-rule flow assembler over a stream: state per key, closed by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from netloom.operators.sessions import KEY, Fold, Timeouts

OUT = "src_ip string, dst_ip string, src_port int, dst_port int, proto string, start_us long, last_us long, emit_us long, n_pkts long, n_bytes double, close_reason string, ts timestamp"
_STATE = "open boolean, start long, last long, fin long, n long, bytes double"


class Assembler(StatefulProcessor):
    """Packets of a micro-batch are folded in order of time; what the watermark has passed is
    closed by a timer at the earliest time that a rule can be due."""

    def __init__(self, timeouts: Timeouts):
        self.timeouts = timeouts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("flow", _STATE)

    def _load(self) -> Fold:
        fold = Fold(self.timeouts)
        if self.state.exists():
            fold.open, fold.start, fold.last, fold.fin, fold.n, fold.bytes = self.state.get()
        return fold

    def _keep(self, fold: Fold) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if not fold.open:
            self.state.clear()
            return
        self.state.update((True, fold.start, fold.last, fold.fin, fold.n, fold.bytes))
        due = min(fold.start + self.timeouts.active, fold.last + self.timeouts.idle, *([fold.fin + self.timeouts.grace] if fold.fin is not None else []))
        self.handle.registerTimer(-(-due // 1000))

    def _rows(self, key, closed: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in OUT.split(", ")]
        return pd.DataFrame([(*key, *r, pd.Timestamp(r[0], unit="us")) for r in closed], columns=names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fold, closed = self._load(), []
        pdf = pd.concat(list(rows)).sort_values(["us", "index"])
        for us, size, flags in zip(pdf["us"], pdf["size"], pdf["flags"], strict=True):
            closed += fold.push(int(us), float(size), int(flags), key[4] == "tcp")
        self._keep(fold)
        yield self._rows(key, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fold = self._load()
        closed = list(fold.flush())
        self._keep(fold)
        yield self._rows(key, closed)

    def close(self) -> None:
        pass


def assemble_stream(packets: DataFrame, timeouts: Timeouts = Timeouts(), lateness: str = "15 seconds") -> DataFrame:
    """Flows of a packet stream (KEY, us, ts, size, flags, index); needs the RocksDB state store."""
    grouped = packets.withWatermark("ts", lateness).groupBy(*KEY)
    fields = [c.split() for c in OUT.split(", ")]
    return grouped.transformWithStateInPandas(statefulProcessor=Assembler(timeouts), outputStructType=", ".join(" ".join(f) for f in fields), outputMode="Append", timeMode="EventTime")


def late_flows(flows: DataFrame) -> DataFrame:
    """Flows that are emitted later than they begin, with by how much, in seconds."""
    return flows.select("*", ((F.col("emit_us") - F.col("start_us")) / 1e6).alias("behind_s"))

