"""Flow, packet, name, probability and alert views of general tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.exprs import micros
from netloom.schema import ACK, FIN, PSH, RST, SYN

DAY = 86_400.0
#: Width of flow windows over the line items, and of packet windows over the events.
FLOW_WINDOW, PACKET_WINDOW = 30 * DAY, DAY


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """us, src, dst, dport, fwd_pkts, fwd_bytes, label: line items as flows between suppliers and part groups."""
    return read(spark, sf_dir, "lineitem").select(
        micros("l_shipdate").alias("us"),
        F.col("l_suppkey").cast("string").alias("src"),
        (F.col("l_partkey") % 50).cast("string").alias("dst"),
        F.col("l_linenumber").alias("dport"),
        F.col("l_quantity").alias("fwd_pkts"),
        F.col("l_extendedprice").alias("fwd_bytes"),
        F.when(F.col("l_returnflag") == "R", "scan").when(F.col("l_linestatus") == "F", "exfil").otherwise("benign").alias("label"),
    )


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as packets: a user sends to an event type; direction -1 for every third one."""
    kind = F.col("event_type")
    flags = F.when(kind == "error", RST).when(kind == "purchase", FIN | ACK).when(kind == "signup", SYN).otherwise(PSH | ACK)
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("index"),
        micros("ts").alias("us"),
        F.col("user_id").cast("string").alias("src_ip"),
        kind.alias("dst_ip"),
        F.lit(0).alias("src_port"),
        F.get_json_object("props", "$.k").cast("int").alias("dst_port"),
        F.lit("tcp").alias("proto"),
        F.col("value").alias("size"),
        flags.alias("flags"),
        (F.col("user_id") % 7 + 58).cast("int").alias("ttl"),
        F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("direction"),
        F.when(kind == "signup", F.concat(F.lit("u"), F.col("user_id") % 97, F.lit(".k"), F.get_json_object("props", "$.k"), F.lit(".example"))).alias("dns_qname"),
        F.when(kind == "purchase", F.concat(F.lit("fp"), F.col("user_id") % 13)).alias("tls_fp"),
        F.when(kind == "error", "scan").when((kind == "signup") & (F.col("value") > 50), "dga").otherwise("benign").alias("label"),
    )


def reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """peer, reputation: a made-up outside service's word on users."""
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(F.col("user_id").cast("string").alias("peer"), (F.col("user_id") * 7919 % 100 / 100.0).alias("reputation"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, window, host, qname: hosts of page addresses as looked-up names."""
    return read(spark, sf_dir, "pages").select(
        "page_id",
        F.floor(F.col("page_id") / 50).cast("long").alias("window"),
        F.coalesce(F.split_part("url", F.lit("/"), F.lit(4)), F.lit("")).alias("host"),
        F.lower(F.split_part("url", F.lit("/"), F.lit(3))).alias("qname"),
    )


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, y, p1, fold: labelled documents with a made-up probability of label 1, to calibrate and measure."""
    d = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    noise = (F.col("doc_id") * 7919 % 1000) / 1000.0
    p = 0.15 + 0.5 * F.col("quality") + 0.3 * noise - 0.1 * (F.col("n_chars") % 7) / 7.0
    labelled = read(spark, sf_dir, "labels").join(d, "doc_id").where("quality is not null")
    return labelled.select("doc_id", F.col("quality").cast("int").alias("y"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p1"), (F.col("doc_id") % 5).alias("fold"))


FLOWS_SQL = """flows AS (SELECT epoch_us(l_shipdate) AS us, CAST(l_suppkey AS VARCHAR) AS src, CAST(l_partkey % 50 AS VARCHAR) AS dst,
  l_linenumber AS dport, l_quantity AS fwd_pkts, l_extendedprice AS fwd_bytes,
  CASE WHEN l_returnflag = 'R' THEN 'scan' WHEN l_linestatus = 'F' THEN 'exfil' ELSE 'benign' END AS label FROM lineitem),
origin AS (SELECT min(us) AS t0 FROM flows),
wf AS (SELECT *, CAST(floor((us - t0) / 2592000000000) AS BIGINT) AS "window" FROM flows, origin)"""

PACKETS_SQL = """packets AS (SELECT event_id AS idx, epoch_us(ts) AS us, CAST(user_id AS VARCHAR) AS src_ip, event_type AS dst_ip,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS dst_port, value AS size,
  CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 17 WHEN 'signup' THEN 2 ELSE 24 END AS flags,
  CAST(user_id % 7 + 58 AS INTEGER) AS ttl, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS direction,
  CASE WHEN event_type = 'signup' THEN 'u' || (user_id % 97) || '.k' || json_extract_string(props, '$.k') || '.example' END AS dns_qname,
  CASE WHEN event_type = 'purchase' THEN 'fp' || (user_id % 13) END AS tls_fp,
  CASE WHEN event_type = 'error' THEN 'scan' WHEN event_type = 'signup' AND value > 50 THEN 'dga' ELSE 'benign' END AS label FROM events)"""

NAMES_SQL = """names AS (SELECT page_id, CAST(floor(page_id / 50) AS BIGINT) AS "window", coalesce(split_part(url, '/', 4), '') AS host, lower(split_part(url, '/', 3)) AS qname FROM pages)"""

PROBS_SQL = """probs AS (SELECT l.doc_id, CAST(quality AS INTEGER) AS y,
  greatest(0.0, least(1.0, 0.15 + 0.5 * quality + 0.3 * ((l.doc_id * 7919 % 1000) / 1000.0) - 0.1 * (n_chars % 7) / 7.0)) AS p1, l.doc_id % 5 AS fold
  FROM labels l JOIN documents d USING (doc_id) WHERE quality IS NOT NULL)"""
