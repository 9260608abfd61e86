"""Labelled synthetic packets and generated names, by hashes of row numbers: any part of
them is the same on any executor, and size is a parameter."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.exprs import uniform
from netloom.schema import ACK, FIN, PACKET, PSH, SYN

# Fixed values.
TLDS = ["com", "net", "org", "info", "biz"]
LETTERS = "abcdefghijklmnopqrstuvwxyz"
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"
NOUNS = ["river", "stone", "table", "window", "garden", "market", "winter", "summer", "bridge", "forest", "letter", "mirror"]
VERBS = ["take", "make", "give", "find", "keep", "hold", "turn", "show", "move", "live"]


@dataclass(frozen=True)
class Behaviour:
    """sessions of `low` to `high` packets, `gap` seconds apart with a share of jitter."""

    name: str
    label: str
    sessions: int
    low: int
    high: int
    gap: float
    jitter: float
    size: int
    dst_port: int
    proto: str = "tcp"
    many_sources: bool = False
    many_ports: bool = False
    replies: bool = False
    name_kind: str = ""
    fingerprint: bool = False


# Eleven behaviours with how many sessions of them there are by default.
BEHAVIOURS = [
    Behaviour("web", "benign", 900, 8, 60, 0.35, 0.9, 600, 443, replies=True, fingerprint=True),
    Behaviour("dns", "benign", 40, 10, 60, 12.0, 0.9, 80, 53, "udp", name_kind="host"),
    Behaviour("telemetry", "benign", 22, 5, 60, 60.0, 0.1, 300, 443, fingerprint=True),
    Behaviour("bulk", "benign", 45, 400, 1600, 0.01, 0.5, 1500, 443, replies=True),
    Behaviour("syn_flood", "ddos", 22, 2250, 6000, 0.004, 0.5, 60, 80, many_sources=True),
    Behaviour("amplification", "ddos", 16, 1200, 4000, 0.008, 0.5, 3000, 123, "udp", many_sources=True),
    Behaviour("beacon", "beacon", 30, 20, 120, 45.0, 0.06, 220, 443, fingerprint=True),
    Behaviour("dga", "dga", 26, 60, 400, 1.5, 0.9, 90, 53, "udp", name_kind="dga"),
    Behaviour("scan", "scan", 14, 300, 1500, 0.01, 0.5, 60, 0, many_ports=True),
    Behaviour("exfil", "exfil", 26, 600, 2500, 0.02, 0.9, 1500, 443),
    Behaviour("encrypted", "encrypted", 28, 40, 200, 0.25, 0.1, 180, 8443, replies=True, fingerprint=True),
]


def pick(seed: int, options: list[str], *key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), F.floor(uniform(seed, *key) * len(options)).cast("int") + 1)


def word(seed: int, alphabet: str, length: Column, *key: Column) -> Column:
    """`length` symbols, each by its own hash."""
    places = F.sequence(F.lit(1), F.greatest(length.cast("int"), F.lit(1)))
    return F.array_join(F.transform(places, lambda i: F.substring(F.lit(alphabet), F.floor(uniform(seed, *key, i) * len(alphabet)).cast("int") + 1, F.lit(1))), "")


def between(seed: int, low: int, high: int, *key: Column) -> Column:
    return (F.floor(uniform(seed, *key) * (high - low + 1)) + low).cast("int")


def dga_names(spark: SparkSession, family: str, n: int, seed: int = 0) -> DataFrame:
    """(id, family, qname) of n names in one of six shapes."""
    i = F.col("id")
    tld = F.concat(F.lit("."), pick(seed + 9, TLDS, i))
    shapes = {
        "uniform": F.concat(word(seed, LETTERS + "0123456789", between(seed + 1, 12, 24, i), i), tld),
        "short": F.concat(word(seed, LETTERS, between(seed + 1, 8, 11, i), i), tld),
        "long": F.concat(word(seed, LETTERS, between(seed + 1, 7, 21, i), i), tld),
        "rewritten": F.concat(word(seed, LETTERS, F.lit(4), i), F.substring(pick(seed + 2, [x + y for x in NOUNS for y in NOUNS[:4]], i), F.lit(5), F.lit(99)), tld),
        "two_words": F.concat(pick(seed, NOUNS, i), pick(seed + 1, NOUNS, i), tld),
        "phrase": F.concat(pick(seed, VERBS, i), pick(seed + 1, NOUNS, i), pick(seed + 2, VERBS, i), tld),
    }
    if family not in shapes:
        raise KeyError(family)
    return spark.range(n).select("id", F.lit(family).alias("family"), shapes[family].alias("qname"))


def tunnel_name(seed: int, *key: Column) -> Column:
    """A payload of 40 to 60 symbols split after 31, under a fixed zone."""
    text = word(seed, BASE32, between(seed + 1, 40, 60, *key), *key)
    return F.concat(F.substring(text, F.lit(1), F.lit(31)), F.lit("."), F.substring(text, F.lit(32), F.lit(99)), F.lit(".t.example.com"))


def _behaviour(spark: SparkSession, b: Behaviour, number: int, scale: float, duration_s: float, seed: int) -> DataFrame:
    seed = seed * 1000 + number * 37
    s = F.col("session")
    sessions = spark.range(max(1, round(b.sessions * scale))).select(F.col("id").alias("session")).select("session", between(seed, b.low, b.high, s).alias("n"), (uniform(seed + 1, s) * duration_s * 0.8).alias("start"))
    rows = sessions.select("session", "n", "start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    k = F.col("k")
    host = lambda prefix, o, *key: F.format_string(prefix + ".%d", between(seed + o, 5, 250, *key))
    src = F.format_string("%d.%d.%d.%d", *(between(seed + 20 + j, 1, 254, s, k) for j in range(4))) if b.many_sources else host("10.0.0", 2, s)
    reply = (k % 2 == 1) if b.replies else F.lit(False)
    dst = host("10.0.1" if b.label != "benign" else "93.184.216", 3, s)
    dport = between(seed + 4, 1, 65535, s, k) if b.many_ports else F.lit(b.dst_port)
    sport = between(seed + 5, 1024, 65535, s)
    ts = F.col("start") + (k + (uniform(seed + 6, s, k) - 0.5) * b.jitter) * b.gap + 1.0
    flags = F.lit(0) if b.proto == "udp" else F.when(F.lit(b.many_sources or b.many_ports), SYN).when(k == 0, SYN).when(k == F.col("n") - 1, FIN | ACK).otherwise(PSH | ACK)
    name = {"host": F.concat(pick(seed + 7, NOUNS, s, k), F.lit(".example."), pick(seed + 8, TLDS, s)), "dga": F.when(uniform(seed + 10, s) < 0.4, tunnel_name(seed + 11, s, k)).otherwise(F.concat(word(seed + 12, LETTERS + "0123456789", between(seed + 13, 12, 24, s, k), s, k), F.lit("."), pick(seed + 14, TLDS, s, k)))}.get(b.name_kind, F.lit(None).cast("string"))
    print_ = F.when(k == 0, F.md5(F.concat(F.lit(b.name if b.label != "benign" else "client"), (s % 5).cast("string")).cast("binary"))) if b.fingerprint else F.lit(None).cast("string")
    ends = lambda a, z: F.when(reply, z).otherwise(a)
    return rows.select(
        F.timestamp_micros((ts * 1e6).cast("long")).alias("ts"), ends(src, dst).alias("src_ip"), ends(dst, src).alias("dst_ip"), ends(sport, dport).cast("int").alias("src_port"), ends(dport, sport).cast("int").alias("dst_port"),
        F.lit(b.proto).alias("proto"), F.lit(b.size).cast("long").alias("size"), flags.cast("int").alias("flags"), F.lit(64).alias("ttl"), F.when(reply, -1).otherwise(1).alias("direction"), name.alias("dns_qname"), print_.alias("tls_fp"), F.lit(b.label).alias("label"),
        F.xxhash64(F.lit(number), s, k).alias("index"),
    )


def packets(spark: SparkSession, scale: float = 0.05, duration_s: float = 900.0, seed: int = 41) -> DataFrame:
    """Packets of all behaviours; `index` is unique for each packet but in no order."""
    frames = [_behaviour(spark, b, i, scale, duration_s, seed) for i, b in enumerate(BEHAVIOURS)]
    return reduce(DataFrame.unionByName, frames).select(*PACKET.fieldNames())
