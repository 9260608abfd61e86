"""Wide per-host cells over packets: both ends of a packet count, in windows of fixed time.

Packets are summed by (window, host, peer) first, so a host with very many packets is summed
before it meets in one place; distinct ports and TTLs are rows of their own beside these sums.
Names, fingerprints and sizes are those of a cell's first packets by time. The features come as
two families: what needs the way back (bi_), and what one direction shows (uni_).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions.exprs import entropy_of_counts, has_flag, ratio
from netloom.schema import ACK, FIN, FORWARD, RST, SYN

#: Packets of a cell whose times and sizes are sampled, the first by time.
SAMPLE = 512


def ends(packets: DataFrame, window_us: int, prefix: str = "") -> DataFrame:
    """Two rows a packet (window, host, peer, is_src, ...), of hosts with the prefix only."""
    end = lambda host, peer, src: F.struct(F.col(host).alias("host"), F.col(peer).alias("peer"), F.lit(src).alias("is_src"))
    rows = packets.withColumn("window", F.floor(F.col("us") / window_us).cast("long")).withColumn("end", F.explode(F.array(end("src_ip", "dst_ip", True), end("dst_ip", "src_ip", False))))
    rows = rows.select("*", "end.*").drop("end")
    return rows.where(F.col("host").startswith(prefix)) if prefix else rows


def _sum(test: Column, x: Column | int = 1) -> Column:
    return F.coalesce(F.sum(F.when(test, x if isinstance(x, Column) else F.lit(x))), F.lit(0)).cast("double")


SUMS = ["fwd_pkts", "fwd_bytes", "bwd_pkts", "bwd_bytes", "out_pkts", "out_bytes", "in_pkts", "in_bytes", "syn", "ack", "rst", "fin"]


def by_peer(e: DataFrame) -> DataFrame:
    """(window, host, peer, n, ...): counts and sums of each pair of a cell's host and a peer."""
    fwd, src, flags = F.col("direction") == FORWARD, F.col("is_src"), F.col("flags")
    size = F.col("size").cast("double")
    tests = [(fwd, 1), (fwd, size), (~fwd, 1), (~fwd, size), (src, 1), (src, size), (~src, 1), (~src, size), *((has_flag(flags, b), 1) for b in (SYN, ACK, RST, FIN))]
    return e.groupBy("window", "host", "peer").agg(F.count("*").alias("n"), *(_sum(t, x).alias(c) for c, (t, x) in zip(SUMS, tests, strict=True)))


def cells(packets: DataFrame, window_us: int, prefix: str = "", reputation: DataFrame | None = None) -> DataFrame:
    """Counts, rates, flags, peers, entropy, sizes, gaps, names, fingerprints and the volume
    against the past of each (window, host). `reputation` (peer, reputation) is what an
    enriched profile knows of peers; without it their columns are 0."""
    e = ends(packets, window_us, prefix)
    peers = by_peer(e)
    if reputation is not None:
        known = reputation.select(F.col("peer").alias("p"), F.col("reputation").cast("double").alias("reputation"))
        peers = peers.join(known, F.col("peer") == F.col("p"), "left").drop("p")
    else:
        peers = peers.withColumn("reputation", F.lit(0.0))
    peers = peers.withColumns({"kind": F.lit("peer"), "reputation": F.coalesce("reputation", F.lit(0.0))})
    once = lambda rows, c, kind: rows.where(F.col(c).isNotNull()).select("window", "host", c).distinct().select("window", "host", F.lit(kind).alias("kind"))
    rows = peers.unionByName(once(e.where("is_src"), "dst_port", "port"), True).unionByName(once(e, "ttl", "ttl"), True)
    n_in = F.when(F.col("in_pkts") > 0, F.col("in_pkts"))
    of = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).cast("double")
    cell = rows.groupBy("window", "host").agg(
        *(F.sum(c).alias(c) for c in SUMS),
        of("peer").alias("n_peers"),
        (F.max("n") / F.sum("n")).alias("peer_concentration"),
        of("port").alias("n_dports"),
        F.least(of("ttl"), F.lit(64.0)).alias("ttl_diversity"),
        F.coalesce(F.greatest(F.lit(0.0), F.log2(F.sum(n_in)) - F.sum(n_in * F.log2(n_in)) / F.sum(n_in)) + 0.0, F.lit(0.0)).alias("src_entropy"),
        F.max("reputation").alias("peer_rep_max"),
        F.avg("reputation").alias("peer_rep_mean"),
        F.avg((F.col("reputation") > 0.5).cast("double")).alias("peer_rep_flagged"),
    )
    cell = cell.join(samples(e), ["window", "host"])
    for more in (names_of_cell(e), fingerprints_of_cell(e, packets)):
        cell = cell.join(more, ["window", "host"], "left").fillna(0.0, [c for c in more.columns if c not in ("window", "host")])
    past = decayed_out_bytes(packets).select(F.col("src_ip").alias("host"), "baseline")
    cell = cell.join(past, "host", "left")
    total = F.col("fwd_pkts") + F.col("bwd_pkts")
    seconds = window_us / 1e6
    return cell.withColumns(
        {
            "bwd_fwd_pkt_ratio": ratio(F.col("bwd_pkts"), F.col("fwd_pkts")),
            "bwd_fwd_byte_ratio": ratio(F.col("bwd_bytes"), F.col("fwd_bytes")),
            "amplification": ratio(F.col("bwd_bytes"), F.col("fwd_bytes")),
            "out_in_byte_ratio": ratio(F.col("out_bytes"), F.col("in_bytes")),
            "syn_without_ack": F.greatest(F.lit(0.0), F.col("syn") - F.col("ack")) / F.greatest(F.lit(1.0), F.col("syn")),
            "rst_rate": ratio(F.col("rst"), total),
            "fin_rate": ratio(F.col("fin"), total),
            "syn_rate": F.col("syn") / seconds,
            "dns_rate": F.col("dns_count") / seconds,
            "fanout_per_pkt": ratio(F.col("n_peers"), F.col("out_pkts")),
            "out_vs_baseline": F.col("out_bytes") / (F.coalesce("baseline", F.lit(0.0)) + 1),
        }
    ).drop("baseline")


#: Columns of both families, of those that need the way back or an outside service, and of the other.
SHARED = [
    "fwd_pkts", "fwd_bytes", "out_pkts", "out_bytes", "in_pkts", "in_bytes", "src_entropy", "n_peers", "n_dports", "peer_concentration", "fanout_per_pkt",
    "ttl_diversity", "iat_cv", "size_cv", "mean_size", "qname_entropy", "qname_max_label", "dns_rate", "tls_fp_rarity", "out_vs_baseline", "syn_rate",
]
BI_ONLY = [
    "bwd_pkts", "bwd_bytes", "bwd_fwd_pkt_ratio", "bwd_fwd_byte_ratio", "out_in_byte_ratio", "amplification", "syn_without_ack", "rst_rate", "fin_rate",
    "std_size", "mean_iat", "dns_count", "dns_qname_len", "peer_rep_max", "peer_rep_mean", "peer_rep_flagged",
]
UNI_ONLY = {"src_total": "in_pkts", "iat_mean": "mean_iat", "iat_min": "min_iat", "qname_len": "dns_qname_len", "tls_count": "tls_count"}


def families(cell: DataFrame) -> DataFrame:
    """(window, host, bi_..., uni_...): the 63 features of both families."""
    bi = [F.col(c).cast("double").alias(f"bi_{c}") for c in [*SHARED, *BI_ONLY]]
    uni = [F.col(c).cast("double").alias(f"uni_{n}") for n, c in [*zip(SHARED, SHARED, strict=True), *UNI_ONLY.items()]]
    return cell.select("window", "host", *bi, *uni)


def samples(e: DataFrame) -> DataFrame:
    """Sizes and gaps over the first SAMPLE packets of each cell. The limit on the rank is taken
    before the shuffle and after it, so a flooded cell sends a sample from each task."""
    w = Window.partitionBy("window", "host").orderBy("us", "index", "is_src")
    rows = e.select("window", "host", "us", "index", "is_src", F.col("size").cast("double").alias("size")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= SAMPLE)
    rows = rows.withColumn("gap", (F.col("us") - F.lag("us").over(w)) / 1e6)
    out = rows.groupBy("window", "host").agg(F.avg("size").alias("mean_size"), F.stddev_pop("size").alias("std_size"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_iat"), F.coalesce(F.min("gap"), F.lit(0.0)).alias("min_iat"), F.count("gap").alias("gaps"), F.stddev_pop("gap").alias("std_gap"))
    return out.select(
        "window", "host", "mean_size", "std_size", "mean_iat", "min_iat",
        F.when(F.col("mean_size") > 1e-9, F.col("std_size") / F.col("mean_size")).otherwise(0.0).alias("size_cv"),
        F.when((F.col("gaps") >= 3) & (F.col("mean_iat") > 1e-9), F.col("std_gap") / F.col("mean_iat")).otherwise(0.0).alias("iat_cv"),
    )


def majority_label(e: DataFrame) -> DataFrame:
    """(window, host, label): the commonest label that isn't benign, first seen of equal ones; else benign."""
    n = e.groupBy("window", "host", "label").agg(F.count("*").alias("n"), F.min("index").alias("first"))
    odd = F.col("label") != "benign"
    best = F.max_by(F.when(odd, F.col("label")), F.when(odd, F.struct(F.col("n"), -F.col("first"))))
    return n.groupBy("window", "host").agg(F.coalesce(best, F.lit("benign")).alias("label"))


def label_sets(e: DataFrame) -> DataFrame:
    """(window, host, labels): sorted set of labels that aren't benign."""
    return e.groupBy("window", "host").agg(F.array_sort(F.collect_set(F.when(F.col("label") != "benign", F.col("label")))).alias("labels"))


def label_pairs(sets: DataFrame, top: int = 5) -> DataFrame:
    """The commonest pairs of labels in one cell."""
    pair = F.flatten(F.transform("labels", lambda a: F.transform(F.filter("labels", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "a", "b").limit(top)


def decayed_out_bytes(packets: DataFrame, half_life_s: float = 300.0) -> DataFrame:
    """(src_ip, baseline): a source's volume, decayed to its last packet; it looks at the whole
    stream. Volumes are decayed to the end of a bucket of eight half-lives and summed there,
    so a source's packets never meet."""
    width = int(8e6 * half_life_s)
    bucket = F.floor(F.col("us") / width).cast("long")
    half = lambda us: F.pow(F.lit(0.5), us / 1e6 / half_life_s)
    parts = packets.select("src_ip", "us", "size", bucket.alias("bucket"))
    parts = parts.groupBy("src_ip", "bucket").agg(F.max("us").alias("last"), F.sum(F.col("size") * half((F.col("bucket") + 1) * width - F.col("us"))).alias("volume"))
    last = F.max("last").over(Window.partitionBy("src_ip"))
    parts = parts.select("src_ip", (F.col("volume") * half(last - (F.col("bucket") + 1) * width)).alias("volume"))
    return parts.groupBy("src_ip").agg(F.sum("volume").alias("baseline"))


def _first(e: DataFrame, column: str) -> DataFrame:
    """(window, host, column) of the first SAMPLE packets of each cell that have the column."""
    w = Window.partitionBy("window", "host").orderBy("us", "index", "is_src")
    rows = e.where(F.col(column).isNotNull() & (F.col(column) != "")).select("window", "host", "us", "index", "is_src", column)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= SAMPLE).select("window", "host", column)


def names_of_cell(e: DataFrame) -> DataFrame:
    """(window, host, dns_count, dns_qname_len, qname_max_label, qname_entropy) of a cell's first
    names by time; the entropy is that of the UTF-8 bytes of all of them together."""
    rows = _first(e, "dns_qname")
    label = F.max(F.array_max(F.transform(F.split("dns_qname", r"\."), F.length)))
    out = rows.groupBy("window", "host").agg(F.count("*").cast("double").alias("dns_count"), F.avg(F.length("dns_qname")).alias("dns_qname_len"), label.cast("double").alias("qname_max_label"))
    one = F.regexp_extract_all(F.hex(F.encode("dns_qname", "UTF-8")), F.lit("(..)"))
    counts = rows.select("window", "host", F.explode(one).alias("byte")).groupBy("window", "host", "byte").agg(F.count("*").cast("double").alias("n"))
    entropy = counts.groupBy("window", "host").agg(entropy_of_counts(F.col("n")).alias("qname_entropy"))
    return out.join(entropy, ["window", "host"])


def fingerprints_of_cell(e: DataFrame, packets: DataFrame) -> DataFrame:
    """(window, host, tls_count, tls_fp_rarity) of a cell's first fingerprints by time: how many,
    and their mean rarity, one less a fingerprint's share of all packets that have one."""
    seen = packets.where("tls_fp is not null and tls_fp <> ''").groupBy(F.col("tls_fp").alias("fp")).agg(F.count("*").alias("all"))
    seen = seen.crossJoin(F.broadcast(seen.agg(F.sum("all").alias("total")))).select("fp", (1 - F.col("all") / F.col("total")).alias("rarity"))  # one row
    rows = _first(e, "tls_fp").groupBy("window", "host", "tls_fp").agg(F.count("*").alias("n"))
    rows = rows.join(seen, F.col("tls_fp") == F.col("fp"))
    return rows.groupBy("window", "host").agg(F.sum("n").cast("double").alias("tls_count"), (F.sum(F.col("n") * F.col("rarity")) / F.sum("n")).alias("tls_fp_rarity"))
