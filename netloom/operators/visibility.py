"""What an observation point can see, as predicates and projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions.exprs import portable
from netloom.schema import FORWARD

# Columns of flow tables by what a sensor must see to make them.
META_COLUMNS = ["Flow ID", "Src IP", "Dst IP", "Timestamp", "Label"]
FORWARD_COLUMNS = [
    "Src Port", "Dst Port", "Protocol", "Total Fwd Packet", "Total Length of Fwd Packet", "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min", "Fwd PSH Flags", "Fwd URG Flags", "Fwd RST Flags", "Fwd Header Length", "Fwd Packets/s", "Fwd Segment Size Avg",
    "Fwd Bytes/Bulk Avg", "Fwd Packet/Bulk Avg", "Fwd Bulk Rate Avg", "Subflow Fwd Packets", "Subflow Fwd Bytes", "FWD Init Win Bytes", "Fwd Act Data Pkts", "Fwd Seg Size Min", "Fwd TCP Retrans. Count",
    "Fwd Segment Payload Length Total", "Fwd Segment Payload Length Max", "Fwd Segment Payload Length Min", "Fwd Segment Payload Length Mean", "Fwd Segment Payload Length Std", "Fwd Segment Header Length Min",
]
BACKWARD_COLUMNS = [
    "Total Bwd packets", "Total Length of Bwd Packet", "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean", "Bwd Packet Length Std", "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std",
    "Bwd IAT Max", "Bwd IAT Min", "Bwd PSH Flags", "Bwd URG Flags", "Bwd RST Flags", "Bwd Header Length", "Bwd Packets/s", "Bwd Segment Size Avg", "Bwd Bytes/Bulk Avg", "Bwd Packet/Bulk Avg",
    "Bwd Bulk Rate Avg", "Subflow Bwd Packets", "Subflow Bwd Bytes", "Bwd Init Win Bytes", "Bwd Act Data Pkts", "Bwd Seg Size Min", "Bwd TCP Retrans. Count", "Bwd Segment Payload Length Total",
    "Bwd Segment Payload Length Max", "Bwd Segment Payload Length Min", "Bwd Segment Payload Length Mean", "Bwd Segment Payload Length Std", "Bwd Segment Header Length Min", "Down/Up Ratio",
]
BOTH_COLUMNS = [
    "Flow Duration", "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min", "Packet Length Min", "Packet Length Max", "Packet Length Mean", "Packet Length Std",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count", "ACK Flag Count", "URG Flag Count", "CWR Flag Count", "ECE Flag Count", "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min", "Total TCP Retrans. Count", "Total Connection Flow Time", "Segment Payload Length Max", "Segment Payload Length Min", "Segment Payload Length Mean",
    "Segment Payload Length Std", "ICMP Code", "ICMP Type",
]
SEES = {"full": [*FORWARD_COLUMNS, *BACKWARD_COLUMNS, *BOTH_COLUMNS], "oneway": FORWARD_COLUMNS}

FLOW_KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "proto"]


@dataclass(frozen=True)
class Profile:
    """one_way keeps forward packets only; sampling N keeps one flow in N, whole; enrichment
    says whether outside knowledge of peers may be used."""

    name: str
    one_way: bool
    sampling: int = 1
    enrichment: bool = False

    def predicate(self, seed: int = 7) -> Column:
        out = F.lit(True)
        if self.one_way:
            out = out & (F.col("direction") == FORWARD)
        if self.sampling > 1:
            # one decision for a flow, the same on every executor and in either direction
            out = out & (portable(seed, flow_text(flow_key())) * self.sampling < 1)
        return out

    def apply(self, packets: DataFrame, seed: int = 7) -> DataFrame:
        return packets.where(self.predicate(seed))


LADDER = [Profile("FULL_ENRICHED", False, 1, True), Profile("DIODE_FULL", False), Profile("DIODE_ONEWAY", True), Profile("DIODE_ONEWAY_SAMPLED", True, 16)]


def profile(name: str) -> Profile:
    found = {p.name: p for p in LADDER}
    if name not in found:
        raise KeyError(name)
    return found[name]


def flow_key() -> Column:
    """The five-tuple from its initiator's side: reversed packets have their ends swapped."""
    keys = ["src", "dst", "sport", "dport", "proto"]
    own = F.struct(*(F.col(c).alias(k) for c, k in zip(FLOW_KEY, keys, strict=True)))
    turned = F.struct(*(F.col(c).alias(k) for c, k in zip(["dst_ip", "src_ip", "dst_port", "src_port", "proto"], keys, strict=True)))
    return F.when(F.col("direction") == FORWARD, own).otherwise(turned)


def flow_text(key: Column) -> Column:
    return F.format_string("%s:%d->%s:%d/%s", key["src"], key["sport"], key["dst"], key["dport"], key["proto"])


def reputation(peers: DataFrame, listed: DataFrame, recall: float = 0.55, false_share: float = 0.03, seed: int = 11) -> DataFrame:
    """(peer, reputation) as a service outside gives it: of `listed` peers it knows a share
    `recall`, and it takes a small share of others for bad. What it says of a peer hangs on the
    peer alone."""
    u, v = portable(seed, F.col("peer")), portable(seed + 1, F.col("peer"))
    known = listed.select("peer").distinct().withColumn("listed", F.lit(True))
    rep = F.when(F.col("listed") & (v < recall), 0.6 + 0.4 * u).when(F.col("listed").isNull() & (v < false_share), 0.5 + 0.4 * u).otherwise(0.0)
    return peers.join(known, "peer", "left").select("peer", rep.alias("reputation"))


def family(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(c for c in df.columns if c.startswith(prefix)))


def column_class(column: str) -> str:
    """meta, forward, backward, both, or other for a column of a flow table."""
    kinds = {"meta": META_COLUMNS, "forward": FORWARD_COLUMNS, "backward": BACKWARD_COLUMNS, "both": BOTH_COLUMNS}
    return next((k for k, own in kinds.items() if column in own), "other")


def observable(df: DataFrame, visibility: str) -> DataFrame:
    """The feature columns of a flow table that a sensor of that visibility, full or oneway, can
    make, in their fixed order: 103 or 35, those that the table has."""
    if visibility not in SEES:
        raise ValueError("visibility must be full or oneway")
    return df.select(*(F.col(f"`{c}`") for c in SEES[visibility] if c in df.columns))


def rebased(flows: DataFrame, us: str = "us") -> DataFrame:
    """`flows` with times counted from the first one."""
    return flows.withColumn(us, F.col(us) - (flows.agg(F.min(us)).first()[0] or 0))


def ablate(df: DataFrame, keep: list[str], columns: list[str]) -> DataFrame:
    """All columns, those of `columns` that aren't kept as 0.0."""
    return df.select(*(F.lit(0.0).alias(c) if c in columns and c not in keep else F.col(c) for c in df.columns))


def shrink(df: DataFrame, drop: list[str]) -> DataFrame:
    """Without `drop`, doubles as floats and longs as ints where all of a column fit."""
    df = df.drop(*drop)
    longs = [c for c, k in df.dtypes if k == "bigint"]
    most = df.agg(*(F.max(F.abs(F.col(f"`{c}`"))).alias(f"_{i}") for i, c in enumerate(longs))).first() if longs else []
    fit = {c for c, x in zip(longs, most, strict=True) if x is None or x < 1 << 31}
    return df.select(*(F.col(f"`{c}`").cast("float" if k == "double" else "int" if c in fit else k).alias(c) for c, k in df.dtypes))
