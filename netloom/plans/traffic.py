"""Queries over flows and packets, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import exprs as X
from netloom.operators import hostwindow as H
from netloom.operators import packetcell as P
from netloom.operators import sessions as S
from netloom.operators import sketches as K
from netloom.operators import visibility as V
from netloom.schema import HOST_FEATURES
from netloom.sources import tables as T

DAY_US = 86_400_000_000
IDLE_US = 6 * 3_600_000_000
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def wf(spark, d):
    return H.windowed(T.flows(spark, d), T.FLOW_WINDOW)


def r6(df, keep):
    return df.select(*keep, *(F.round(F.col(c).cast("double"), 6).alias(c) for c in df.columns if c not in keep))


def r6_sql(names):
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


SRC = ["n_flows", "n_dports", "n_peers", "fwd_pkts", "fwd_bytes", "iat_mean", "iat_cv", "peer_concentration", "fanout_per_flow"]
SRC_SQL = f"""{T.FLOWS_SQL}, gaps AS (SELECT *, (us - lag(us) OVER (PARTITION BY "window", src ORDER BY us)) / 1e6 AS gap FROM wf),
sa AS (SELECT "window", src, count(*) AS n_flows, count(DISTINCT dport) AS n_dports, count(DISTINCT dst) AS n_peers, sum(fwd_pkts) AS fwd_pkts, sum(fwd_bytes) AS fwd_bytes,
  coalesce(avg(gap), 0.0) AS iat_mean, CASE WHEN count(gap) >= 2 AND avg(gap) > 1e-9 THEN stddev_pop(gap) / avg(gap) ELSE 0.0 END AS iat_cv FROM gaps GROUP BY ALL),
sp AS (SELECT "window", src, max(n) * 1.0 / sum(n) AS peer_concentration FROM (SELECT "window", src, dst, count(*) AS n FROM wf GROUP BY ALL) GROUP BY ALL),
src_cells AS (SELECT sa.*, peer_concentration, n_peers * 1.0 / greatest(n_flows, 1) AS fanout_per_flow FROM sa JOIN sp USING ("window", src))"""
DST = ["n_flows", "n_srcs", "fwd_pkts", "fwd_bytes", "src_entropy", "flows_per_src"]
DST_SQL = f"""dn AS (SELECT "window", dst, src, CAST(count(*) AS DOUBLE) AS n, sum(fwd_pkts) AS p, sum(fwd_bytes) AS b FROM wf GROUP BY ALL),
dst_cells AS (SELECT "window", dst, sum(n) AS n_flows, count(*) AS n_srcs, sum(p) AS fwd_pkts, sum(b) AS fwd_bytes,
  greatest(0.0, log2(sum(n)) - sum(n * log2(n)) / sum(n)) + 0.0 AS src_entropy, sum(n) / count(*) AS flows_per_src FROM dn GROUP BY ALL)"""
EWM_SQL = """hist AS (SELECT *, list(fwd_bytes) OVER (PARTITION BY src ORDER BY "window" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM src_cells),
based AS (SELECT * EXCLUDE (past), CASE WHEN past IS NULL OR len(past) = 0 THEN 0.0 ELSE list_reduce(past, lambda a, x: pow(0.5, 1 / 5.0) * a + (1 - pow(0.5, 1 / 5.0)) * x) END AS baseline FROM hist)"""


@query(f'WITH {SRC_SQL} SELECT "window", src, {r6_sql(SRC)} FROM src_cells')
def hw_src_cells(spark, d):
    return r6(H.src_cells(wf(spark, d)).select("window", "src", *SRC), ["window", "src"])


@query(f'WITH {T.FLOWS_SQL}, {DST_SQL} SELECT "window", dst, {r6_sql(DST)} FROM dst_cells')
def hw_dst_cells(spark, d):
    return r6(H.dst_cells(wf(spark, d)).select("window", "dst", *DST), ["window", "dst"])


@query(f'WITH {SRC_SQL} SELECT "window", src, round(peer_concentration, 6) AS peer_concentration FROM src_cells')
def hw_peer_concentration(spark, d):
    n = wf(spark, d).groupBy("window", "src", "dst").agg(F.count("*").alias("n"))
    return n.groupBy("window", "src").agg(F.round(F.max("n") / F.sum("n"), 6).alias("peer_concentration"))


@query(f'WITH {T.FLOWS_SQL}, {DST_SQL} SELECT "window", dst, round(src_entropy, 6) AS src_entropy FROM dst_cells')
def hw_src_entropy(spark, d):
    n = wf(spark, d).groupBy("window", "dst", "src").agg(F.count("*").cast("double").alias("n"))
    return n.groupBy("window", "dst").agg(F.round(X.entropy_of_counts(F.col("n")), 6).alias("src_entropy"))


@query(f'WITH {SRC_SQL} SELECT "window", src, round(iat_mean, 6) AS iat_mean, round(iat_cv, 6) AS iat_cv FROM src_cells')
def hw_iat_stats(spark, d):
    return r6(H.src_cells(wf(spark, d)).select("window", "src", "iat_mean", "iat_cv"), ["window", "src"])


@query(f'WITH {SRC_SQL}, {EWM_SQL} SELECT "window", src, round(fwd_bytes / (baseline + 1), 4) AS bytes_vs_baseline FROM based')
def hw_baseline_ewm(spark, d):
    cells = wf(spark, d).groupBy("window", "src").agg(F.sum("fwd_bytes").alias("fwd_bytes"))
    return H.with_baseline(cells).select("window", "src", F.round("bytes_vs_baseline", 4).alias("bytes_vs_baseline"))


@query(f"""WITH {T.FLOWS_SQL}, c AS (SELECT "window", src, sum(fwd_bytes) AS x FROM wf GROUP BY ALL),
p AS (SELECT c."window", c.src, c.x, max(q."window") AS last FROM c LEFT JOIN c q ON q.src = c.src AND q."window" < c."window" GROUP BY ALL),
b AS (SELECT p."window", p.src, any_value(p.x) AS x, coalesce(sum(q.x * pow(0.5, (p.last - q."window") / 5.0)), 0.0) AS baseline FROM p LEFT JOIN c q ON q.src = p.src AND q."window" < p."window" GROUP BY p."window", p.src)
SELECT "window", src, round(x / (baseline + 1), 4) AS bytes_vs_baseline FROM b""")
def hw_baseline_decayed(spark, d):
    cells = wf(spark, d).groupBy("window", "src").agg(F.sum("fwd_bytes").alias("fwd_bytes"))
    return H.with_baseline(cells, decayed=True).select("window", "src", F.round("bytes_vs_baseline", 4).alias("bytes_vs_baseline"))


ENRICHED = f"""{SRC_SQL}, {EWM_SQL}, {DST_SQL}"""
ENRICHED_COLS = ", ".join([f"round(CAST(s.{c} AS DOUBLE), 4) AS hw_src_{c}" for c in SRC] + ["round(s.fwd_bytes / (s.baseline + 1), 4) AS hw_src_bytes_vs_baseline"] + [f"round(CAST(t.{c} AS DOUBLE), 4) AS hw_dst_{c}" for c in DST])


@query(f'WITH {ENRICHED} SELECT f."window", f.src, f.dst, f.us, f.dport, f.fwd_pkts, f.fwd_bytes, {ENRICHED_COLS} FROM wf f LEFT JOIN based s USING ("window", src) LEFT JOIN dst_cells t USING ("window", dst)')
def hw_flow_enriched(spark, d):
    out = H.enriched_flows(wf(spark, d))
    return out.select("window", "src", "dst", "us", "dport", "fwd_pkts", "fwd_bytes", *(F.round(c, 4).alias(c) for c in HOST_FEATURES))


UNPIVOT = ["hw_src_n_flows", "hw_src_n_peers", "hw_src_n_dports", "hw_src_fwd_pkts", "hw_src_fwd_bytes", "hw_src_peer_concentration", "hw_dst_n_flows", "hw_dst_n_srcs", "hw_dst_fwd_pkts", "hw_dst_fwd_bytes", "hw_dst_src_entropy"]
UNPIVOT_SQL = ", ".join(f"round(coalesce(CAST({'s' if c.startswith('hw_src') else 't'}.{c[7:]} AS DOUBLE), 0.0), 4) AS {c}" for c in UNPIVOT)


@query(f'WITH {SRC_SQL}, {DST_SQL} SELECT coalesce(s."window", t."window") AS "window", coalesce(s.src, t.dst) AS host, {UNPIVOT_SQL} FROM src_cells s FULL JOIN dst_cells t ON s."window" = t."window" AND s.src = t.dst')
def role_unpivot_cells(spark, d):
    return H.unpivot_cells(wf(spark, d)).select("window", "host", *(F.round(c, 4).alias(c) for c in UNPIVOT))


MERGED_SQL = ", ".join([f"round(coalesce(CAST(s.{c} AS DOUBLE), 0.0), 4) AS hw_src_{c}" for c in SRC] + [f"round(coalesce(CAST(t.{c} AS DOUBLE), 0.0), 4) AS hw_dst_{c}" for c in DST])


@query(f'WITH {SRC_SQL}, {DST_SQL} SELECT coalesce(s."window", t."window") AS "window", coalesce(s.src, t.dst) AS host, {MERGED_SQL} FROM src_cells s FULL JOIN dst_cells t ON s."window" = t."window" AND s.src = t.dst')
def merge_rows_full_outer(spark, d):
    w = wf(spark, d)
    src = H.prefixed(H.src_cells(w), "src", "src").withColumnRenamed("src", "host")
    dst = H.prefixed(H.dst_cells(w), "dst", "dst").withColumnRenamed("dst", "host")
    out = src.join(dst, ["window", "host"], "full_outer")
    return out.select("window", "host", *(F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in [f"hw_src_{c}" for c in SRC] + [f"hw_dst_{c}" for c in DST]))


@query(f"""WITH {T.FLOWS_SQL}, a AS (SELECT DISTINCT "window", src AS host FROM wf), b AS (SELECT DISTINCT "window", dst AS host FROM wf)
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS in_both, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS in_either""")
def keyset_agreement(spark, d):
    w = wf(spark, d)
    a, b = w.select("window", F.col("src").alias("host")).distinct(), w.select("window", F.col("dst").alias("host")).distinct()
    return a.intersect(b).agg(F.count("*").alias("in_both")).crossJoin(a.union(b).distinct().agg(F.count("*").alias("in_either")))


# ---- visibility


@query(f"WITH {T.PACKETS_SQL} SELECT idx, src_ip, dst_ip, CAST(size AS DOUBLE) AS size FROM packets WHERE direction = 1")
def visibility_oneway(spark, d):
    return V.profile("DIODE_ONEWAY").apply(T.packets(spark, d)).select(F.col("index").alias("idx"), "src_ip", "dst_ip", F.col("size").cast("double").alias("size"))


FLOW_TEXT = "CASE WHEN direction = 1 THEN format('{}:{}->{}:{}/tcp', src_ip, 0, dst_ip, dst_port) ELSE format('{}:{}->{}:{}/tcp', dst_ip, dst_port, src_ip, 0) END"
SAMPLED_SQL = f"direction = 1 AND {X.portable_sql(7, FLOW_TEXT)} * 16 < 1"


@query(f"WITH {T.PACKETS_SQL} SELECT idx, src_ip, dst_ip, CAST(size AS DOUBLE) AS size FROM packets WHERE {SAMPLED_SQL}")
def visibility_sampled(spark, d):
    return V.profile("DIODE_ONEWAY_SAMPLED").apply(T.packets(spark, d)).select(F.col("index").alias("idx"), "src_ip", "dst_ip", F.col("size").cast("double").alias("size"))


@query(f"""WITH {T.PACKETS_SQL} SELECT idx, CASE WHEN direction = 1 THEN format('{{}}:{{}}->{{}}:{{}}/tcp', src_ip, 0, dst_ip, dst_port) ELSE format('{{}}:{{}}->{{}}:{{}}/tcp', dst_ip, dst_port, src_ip, 0) END AS flow FROM packets""")
def flow_key_text(spark, d):
    return T.packets(spark, d).select(F.col("index").alias("idx"), V.flow_text(V.flow_key()).alias("flow"))


@query(f"""WITH {T.PACKETS_SQL}, e AS (SELECT CAST(floor(us / {DAY_US}) AS BIGINT) AS "window", src_ip AS host, size FROM packets UNION ALL SELECT CAST(floor(us / {DAY_US}) AS BIGINT), dst_ip, size FROM packets)
SELECT "window", host, count(*) AS n, round(sum(size), 4) AS bytes FROM e WHERE starts_with(host, '1') GROUP BY ALL""")
def monitored_prefix_cells(spark, d):
    return P.ends(T.packets(spark, d), DAY_US, "1").groupBy("window", "host").agg(F.count("*").alias("n"), F.round(F.sum("size"), 4).alias("bytes"))


@query(f"WITH {T.PACKETS_SQL} SELECT idx, CASE flags WHEN 4 THEN 'RST' WHEN 17 THEN 'FIN|ACK' WHEN 2 THEN 'SYN' ELSE 'PSH|ACK' END AS flags FROM packets")
def tcp_flags_text(spark, d):
    return T.packets(spark, d).select(F.col("index").alias("idx"), X.flags_text(F.col("flags")).alias("flags"))


@query(f'WITH {T.FLOWS_SQL} SELECT "window", src, dst, 0.0::DOUBLE AS dport, fwd_pkts, 0.0::DOUBLE AS fwd_bytes FROM wf')
def ablate_zero(spark, d):
    return V.ablate(wf(spark, d).select("window", "src", "dst", "dport", "fwd_pkts", "fwd_bytes"), ["fwd_pkts"], ["dport", "fwd_pkts", "fwd_bytes"])


def corpus_like(spark, d):
    """Flows under some of the names that flow tables have, of every class of column."""
    f = T.flows(spark, d)
    named = {"Src IP": "src", "Dst IP": "dst", "Label": "label", "Dst Port": "dport", "Total Fwd Packet": "fwd_pkts", "Total Length of Fwd Packet": "fwd_bytes", "Down/Up Ratio": "dport", "Flow Duration": "us"}
    return f.select(*(F.col(c).alias(n) for n, c in named.items()), (F.col("fwd_pkts") * 2).alias("Total Bwd packets"), F.col("us").alias("note"))


@query("""WITH c AS (SELECT unnest(['Src IP', 'Dst IP', 'Label', 'Dst Port', 'Total Fwd Packet', 'Total Length of Fwd Packet', 'Down/Up Ratio', 'Flow Duration', 'Total Bwd packets', 'note']) AS "column")
SELECT "column", CASE WHEN "column" IN ('Src IP', 'Dst IP', 'Label') THEN 'meta' WHEN contains("column", 'Bwd') OR "column" = 'Down/Up Ratio' THEN 'backward' WHEN contains("column", 'Fwd') OR "column" = 'Dst Port' THEN 'forward' WHEN starts_with("column", 'Flow') THEN 'both' ELSE 'other' END AS class FROM c""")
def column_audit(spark, d):
    return spark.createDataFrame([(x, V.column_class(x)) for x in corpus_like(spark, d).columns], "column string, class string")


@query(f"""WITH {T.FLOWS_SQL} SELECT 'full' AS visibility, count(*) AS n, 5 AS columns, round(sum(fwd_pkts), 4) AS pkts, round(sum(fwd_pkts * 2), 4) AS back FROM flows UNION ALL SELECT 'oneway', count(*), 2, round(sum(fwd_pkts), 4), NULL FROM flows""")
def observable_columns(spark, d):
    """What a sensor sees of the same flows, both ways and one way."""
    out = None
    for v in ("full", "oneway"):
        df = V.observable(corpus_like(spark, d).drop("Dst Port"), v)
        back = F.round(F.sum("Total Bwd packets"), 4) if "Total Bwd packets" in df.columns else F.lit(None).cast("double")
        one = df.agg(F.lit(v).alias("visibility"), F.count("*").alias("n"), F.lit(len(df.columns)).alias("columns"), F.round(F.sum("Total Fwd Packet"), 4).alias("pkts"), back.alias("back"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {T.FLOWS_SQL} SELECT us - t0 AS us, src, dst, dport FROM flows, origin")
def rebased_times(spark, d):
    return V.rebased(T.flows(spark, d)).select("us", "src", "dst", "dport")


# ---- sessions

SESSION_SQL = f"""{T.PACKETS_SQL}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w >= {IDLE_US} THEN 1 WHEN lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM packets WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY us, idx)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY src_ip, dst_ip ORDER BY us, idx ROWS UNBOUNDED PRECEDING) AS session FROM g)"""


@query(f"WITH {SESSION_SQL} SELECT src_ip, dst_ip, CAST(session AS BIGINT) AS session, min(us) AS start_us, max(us) AS last_us, count(*) AS n_pkts, round(sum(size), 4) AS n_bytes FROM n GROUP BY ALL")
def session_idle(spark, d):
    out = S.idle_sessions(T.packets(spark, d), IDLE_US, ["src_ip", "dst_ip"])
    return out.withColumn("n_bytes", F.round("n_bytes", 4)).withColumn("session", F.col("session").cast("long"))


TIMEOUTS = S.Timeouts(IDLE_US, 3 * DAY_US, 3_600_000_000)


def sessions(spark, d):
    return S.assemble(T.packets(spark, d).withColumn("dst_port", F.lit(80)), TIMEOUTS)


FULL_SQL = f"""{T.PACKETS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY us, idx) AS k FROM packets),
f AS (SELECT src_ip, dst_ip, k, us, us AS start_us, CASE WHEN flags & 1 <> 0 THEN us END AS fin, flags & 4 <> 0 AS ended, 1 AS session FROM o WHERE k = 1
UNION ALL SELECT o.src_ip, o.dst_ip, o.k, o.us,
  CASE WHEN c.fresh THEN o.us ELSE f.start_us END, CASE WHEN o.flags & 1 <> 0 AND (c.fresh OR f.fin IS NULL) THEN o.us WHEN c.fresh THEN NULL ELSE f.fin END, o.flags & 4 <> 0, f.session + CAST(c.fresh AS INTEGER)
  FROM f JOIN o ON o.src_ip = f.src_ip AND o.dst_ip = f.dst_ip AND o.k = f.k + 1,
  LATERAL (SELECT f.ended OR coalesce(f.fin <= o.us - 3600000000, false) OR f.start_us <= o.us - {3 * DAY_US} OR f.us <= o.us - {IDLE_US} AS fresh) c)"""


@query(f"WITH RECURSIVE {FULL_SQL} SELECT f.src_ip AS src, f.dst_ip AS dst, min(f.start_us) AS start_us, max(f.us) AS last_us, count(*) AS n_pkts, round(sum(o.size), 4) AS n_bytes FROM f JOIN o USING (src_ip, dst_ip, k) GROUP BY f.src_ip, f.dst_ip, session")
def session_full(spark, d):
    return sessions(spark, d).select("src", "dst", "start_us", "last_us", "n_pkts", F.round("n_bytes", 4).alias("n_bytes"))


CLOSED_SQL = f"""{FULL_SQL}, e AS (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip, session ORDER BY k DESC) AS rk, lead(us) OVER (PARTITION BY src_ip, dst_ip ORDER BY k) AS nus FROM f),
z AS (SELECT start_us, us, fin, CASE WHEN ended THEN 'rst' WHEN nus IS NOT NULL THEN CASE WHEN fin <= nus - 3600000000 THEN 'fin' WHEN start_us <= nus - {3 * DAY_US} THEN 'active' ELSE 'idle' END
  WHEN fin + 3600000000 <= least(start_us + {3 * DAY_US}, us + {IDLE_US}) THEN 'fin' WHEN start_us + {3 * DAY_US} <= us + {IDLE_US} THEN 'active' ELSE 'idle' END AS close_reason FROM e WHERE rk = 1),
closed AS (SELECT start_us, close_reason, CASE close_reason WHEN 'rst' THEN us WHEN 'fin' THEN fin + 3600000000 WHEN 'active' THEN start_us + {3 * DAY_US} ELSE us + {IDLE_US} END AS emit_us FROM z)"""


@query(f"WITH RECURSIVE {CLOSED_SQL} SELECT close_reason, count(*) AS n, min(emit_us) AS first_emit, max(emit_us) AS last_emit FROM closed GROUP BY ALL")
def session_close_reasons(spark, d):
    return sessions(spark, d).groupBy("close_reason").agg(F.count("*").alias("n"), F.min("emit_us").alias("first_emit"), F.max("emit_us").alias("last_emit"))


ALLOWED = [0, 3_600_000_000, 6 * 3_600_000_000, DAY_US]


@query(f"""WITH RECURSIVE {CLOSED_SQL}, t AS (SELECT emit_us, max(start_us) AS top FROM closed GROUP BY ALL), s AS (SELECT emit_us, max(top) OVER (ORDER BY emit_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM t),
a AS (SELECT unnest([{", ".join(map(str, ALLOWED))}]) AS allowed)
SELECT allowed, count(*) AS n, count(*) FILTER (seen > (floor(start_us / {DAY_US}) + 1) * {DAY_US} + allowed) AS dropped FROM closed JOIN s USING (emit_us), a GROUP BY allowed""")
def lateness_sweep(spark, d):
    return S.lateness(sessions(spark, d), 0, DAY_US, ALLOWED).select(F.col("allowed").cast("long").alias("allowed"), "n", "dropped")


# ---- wide packet cells

ENDS_SQL = f"""{T.PACKETS_SQL}, e AS (SELECT *, CAST(floor(us / {DAY_US}) AS BIGINT) AS "window", src_ip AS host, dst_ip AS peer, true AS is_src FROM packets
UNION ALL SELECT *, CAST(floor(us / {DAY_US}) AS BIGINT), dst_ip, src_ip, false FROM packets)"""
WIDE = {
    "fwd_pkts": "count(*) FILTER (direction = 1)", "fwd_bytes": "coalesce(sum(size) FILTER (direction = 1), 0)", "bwd_pkts": "count(*) FILTER (direction <> 1)", "bwd_bytes": "coalesce(sum(size) FILTER (direction <> 1), 0)",
    "out_pkts": "count(*) FILTER (is_src)", "out_bytes": "coalesce(sum(size) FILTER (is_src), 0)", "in_pkts": "count(*) FILTER (NOT is_src)", "in_bytes": "coalesce(sum(size) FILTER (NOT is_src), 0)",
    "syn": "count(*) FILTER (flags & 2 <> 0)", "ack": "count(*) FILTER (flags & 16 <> 0)", "rst": "count(*) FILTER (flags & 4 <> 0)", "fin": "count(*) FILTER (flags & 1 <> 0)",
    "n_peers": "count(DISTINCT peer)", "n_dports": "count(DISTINCT dst_port) FILTER (is_src)", "ttl_diversity": "least(count(DISTINCT ttl), 64)",
}
DERIVED = {
    "bwd_fwd_pkt_ratio": "bwd_pkts / greatest(fwd_pkts, 1)", "bwd_fwd_byte_ratio": "bwd_bytes / greatest(fwd_bytes, 1)", "amplification": "bwd_bytes / greatest(fwd_bytes, 1)", "out_in_byte_ratio": "out_bytes / greatest(in_bytes, 1)",
    "syn_without_ack": "greatest(0, syn - ack) / greatest(1, syn)", "rst_rate": "rst / greatest(fwd_pkts + bwd_pkts, 1)", "fin_rate": "fin / greatest(fwd_pkts + bwd_pkts, 1)", "syn_rate": "syn / 86400.0", "fanout_per_pkt": "n_peers / greatest(out_pkts, 1)",
}
SAMPLED = ["mean_size", "std_size", "mean_iat", "min_iat", "size_cv", "iat_cv"]
WIDE_SQL = f"""{ENDS_SQL}, w AS (SELECT "window", host, {", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in WIDE.items())} FROM e GROUP BY ALL),
bp AS (SELECT "window", host, peer, count(*) AS n, CAST(count(*) FILTER (NOT is_src) AS DOUBLE) AS n_in FROM e GROUP BY ALL),
pc AS (SELECT "window", host, max(n) * 1.0 / sum(n) AS peer_concentration, coalesce(greatest(0.0, log2(sum(n_in) FILTER (n_in > 0)) - sum(n_in * log2(n_in)) FILTER (n_in > 0) / sum(n_in) FILTER (n_in > 0)) + 0.0, 0.0) AS src_entropy FROM bp GROUP BY ALL),
sm AS (SELECT "window", host, size, us, row_number() OVER x AS rk, (us - lag(us) OVER x) / 1e6 AS gap FROM e WINDOW x AS (PARTITION BY "window", host ORDER BY us, idx, is_src)),
ss AS (SELECT "window", host, avg(size) AS mean_size, stddev_pop(size) AS std_size, coalesce(avg(gap), 0.0) AS mean_iat, coalesce(min(gap), 0.0) AS min_iat, CASE WHEN avg(size) > 1e-9 THEN stddev_pop(size) / avg(size) ELSE 0.0 END AS size_cv,
  CASE WHEN count(gap) >= 3 AND avg(gap) > 1e-9 THEN stddev_pop(gap) / avg(gap) ELSE 0.0 END AS iat_cv FROM sm WHERE rk <= 512 GROUP BY ALL)"""
NAMED_SQL = """qn AS (SELECT * FROM (SELECT "window", host, dns_qname, row_number() OVER (PARTITION BY "window", host ORDER BY us, idx, is_src) AS rk FROM e WHERE dns_qname <> '') WHERE rk <= 512),
qs AS (SELECT "window", host, CAST(count(*) AS DOUBLE) AS dns_count, avg(length(dns_qname)) AS dns_qname_len, max(list_max(list_transform(string_split(dns_qname, '.'), lambda x: length(x)))) AS qname_max_label FROM qn GROUP BY ALL),
qb AS (SELECT "window", host, b, CAST(count(*) AS DOUBLE) AS n FROM (SELECT "window", host, unnest(regexp_extract_all(hex(encode(dns_qname)), '..')) AS b FROM qn) GROUP BY ALL),
qe AS (SELECT "window", host, greatest(0.0, log2(sum(n)) - sum(n * log2(n)) / sum(n)) + 0.0 AS qname_entropy FROM qb GROUP BY ALL),
fg AS (SELECT tls_fp, 1 - count(*) / (SELECT count(*) FROM packets WHERE tls_fp <> '') AS rarity FROM packets WHERE tls_fp <> '' GROUP BY ALL),
fn AS (SELECT * FROM (SELECT "window", host, tls_fp, row_number() OVER (PARTITION BY "window", host ORDER BY us, idx, is_src) AS rk FROM e WHERE tls_fp <> '') WHERE rk <= 512),
fs AS (SELECT "window", host, CAST(count(*) AS DOUBLE) AS tls_count, avg(rarity) AS tls_fp_rarity FROM fn JOIN fg USING (tls_fp) GROUP BY ALL),
rp AS (SELECT "window", host, max(r) AS peer_rep_max, avg(r) AS peer_rep_mean, avg(CAST(r > 0.5 AS INT)) AS peer_rep_flagged FROM (SELECT bp."window", bp.host, coalesce(r.r, 0.0) AS r FROM bp LEFT JOIN (SELECT DISTINCT CAST(user_id AS VARCHAR) AS peer, (user_id * 7919 % 100) / 100.0 AS r FROM events) r USING (peer)) GROUP BY ALL),
lp AS (SELECT src_ip, max(us) AS m FROM packets GROUP BY ALL),
bl AS (SELECT src_ip AS host, sum(size * pow(0.5, (m - us) / 1e6 / 300.0)) AS baseline FROM packets JOIN lp USING (src_ip) GROUP BY ALL)"""
NAMED = ["dns_count", "dns_qname_len", "qname_max_label", "qname_entropy", "tls_count", "tls_fp_rarity", "peer_rep_max", "peer_rep_mean", "peer_rep_flagged"]
FAMILIES = [(f"bi_{c}", c) for c in [*P.SHARED, *P.BI_ONLY]] + [(f"uni_{c}", c) for c in P.SHARED] + [(f"uni_{n}", c) for n, c in P.UNI_ONLY.items()]


@query(f"""WITH {WIDE_SQL}, {NAMED_SQL}, j AS (SELECT w.*, peer_concentration, src_entropy, {", ".join(f"ss.{c}" for c in SAMPLED)}, {", ".join(f"coalesce({c}, 0) AS {c}" for c in NAMED)}, {", ".join(f"{v} AS {k}" for k, v in DERIVED.items())},
  coalesce(dns_count, 0) / 86400.0 AS dns_rate, out_bytes / (coalesce(baseline, 0) + 1) AS out_vs_baseline
  FROM w JOIN pc USING ("window", host) JOIN ss USING ("window", host) LEFT JOIN qs USING ("window", host) LEFT JOIN qe USING ("window", host) LEFT JOIN fs USING ("window", host) JOIN rp USING ("window", host) LEFT JOIN bl USING (host))
SELECT "window", host, {", ".join(f"round(CAST({c} AS DOUBLE) + 2e-8, 6) AS {n}" for n, c in FAMILIES)} FROM j""")
def packet_cell_wide(spark, d):
    out = P.families(P.cells(T.packets(spark, d), DAY_US, reputation=T.reputation(spark, d)))
    return out.select("window", "host", *(F.round(F.col(n) + 2e-8, 6).alias(n) for n, _ in FAMILIES))  # past ties of halves of microseconds


@query(f'WITH {ENDS_SQL} SELECT "window", host, round(count(*) FILTER (flags & 2 <> 0) * 1.0 / count(*), 6) AS syn_share, round(count(*) FILTER (flags & 4 <> 0) * 1.0 / count(*), 6) AS rst_share FROM e GROUP BY ALL')
def tcp_flag_rates(spark, d):
    e = P.ends(T.packets(spark, d), DAY_US)
    share = lambda bit: F.round(F.avg(X.has_flag(F.col("flags"), bit).cast("double")), 6)
    return e.groupBy("window", "host").agg(share(2).alias("syn_share"), share(4).alias("rst_share"))


@query(f'WITH {ENDS_SQL} SELECT "window", host, least(count(DISTINCT ttl), 64) AS ttl_diversity FROM e GROUP BY ALL')
def ttl_diversity(spark, d):
    e = P.ends(T.packets(spark, d), DAY_US)
    return e.groupBy("window", "host").agg(F.least(F.countDistinct("ttl"), F.lit(64)).cast("long").alias("ttl_diversity"))


@query(f'WITH {ENDS_SQL}, n AS (SELECT "window", host, peer, count(*) AS n FROM e GROUP BY ALL) SELECT "window", host, round(max(n) * 1.0 / sum(n), 6) AS top_peer_share FROM n GROUP BY ALL')
def top_peer_share(spark, d):
    n = P.ends(T.packets(spark, d), DAY_US).groupBy("window", "host", "peer").agg(F.count("*").alias("n"))
    return n.groupBy("window", "host").agg(F.round(F.max("n") / F.sum("n"), 6).alias("top_peer_share"))


@query(f"""WITH {ENDS_SQL}, n AS (SELECT "window", host, label, count(*) AS n, min(idx) AS f FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "window", host ORDER BY label = 'benign', n DESC, f) AS k FROM n) SELECT "window", host, label FROM r WHERE k = 1""")
def cell_majority_label(spark, d):
    return P.majority_label(P.ends(T.packets(spark, d), DAY_US))


@query(f"""WITH {ENDS_SQL} SELECT "window", host, coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label <> 'benign')), ','), '') AS labels FROM e GROUP BY ALL""")
def multilabel_sets(spark, d):
    return P.label_sets(P.ends(T.packets(spark, d), DAY_US)).select("window", "host", F.array_join("labels", ",").alias("labels"))


@query(f"""WITH {ENDS_SQL}, s AS (SELECT DISTINCT "window", host, label FROM e WHERE label <> 'benign')
SELECT x.label AS a, y.label AS b, count(*) AS n FROM s x JOIN s y ON x."window" = y."window" AND x.host = y.host AND x.label < y.label GROUP BY ALL ORDER BY n DESC, a, b LIMIT 5""")
def cooccurring_pairs(spark, d):
    return P.label_pairs(P.label_sets(P.ends(T.packets(spark, d), DAY_US)))


@query(f"""WITH {T.PACKETS_SQL}, l AS (SELECT src_ip, max(us) AS m FROM packets GROUP BY ALL) SELECT src_ip, round(sum(size * pow(0.5, (m - us) / 1e6 / 86400.0)), 4) AS baseline FROM packets JOIN l USING (src_ip) GROUP BY ALL""")
def decayed_out_bytes(spark, d):
    return P.decayed_out_bytes(T.packets(spark, d), 86_400.0).select("src_ip", F.round("baseline", 4).alias("baseline"))


# ---- sketches


@query(f'WITH {T.FLOWS_SQL} SELECT "window", src, count(DISTINCT dst) AS exact, true AS near FROM wf GROUP BY ALL')
def hll_fanout(spark, d):
    """Peers of a (window, src) by a mergeable sketch, held against the exact number."""
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("dst", F.lit(12)))
    out = wf(spark, d).groupBy("window", "src").agg(sketch.alias("estimate"), F.countDistinct("dst").alias("exact"))
    return out.select("window", "src", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 1 + 0.05 * F.col("exact")).alias("near"))


@query(f"""WITH {T.FLOWS_SQL}, n AS (SELECT src, dst, count(*) AS n FROM wf GROUP BY ALL), r AS (SELECT src, n, row_number() OVER (PARTITION BY src ORDER BY n DESC) AS place FROM n)
SELECT src, CAST(place AS INTEGER) AS place, n FROM r WHERE place <= 3""")
def approx_topk_peers(spark, d):
    """How often each source meets its commonest peers, by a mergeable sketch of bounded size,
    which is exact while a source has no more peers than it holds."""
    top = wf(spark, d).groupBy("src").agg(F.expr("approx_top_k(dst, 3, 100)").alias("top"))
    return top.select("src", F.posexplode(F.reverse(F.array_sort(F.col("top.count")))).alias("at", "n")).select("src", (F.col("at") + 1).cast("int").alias("place"), "n")


@query(f"""WITH {T.FLOWS_SQL}, k AS (SELECT dst, count(*) AS n FROM flows GROUP BY ALL), l AS (SELECT unnest(range(4)) AS line),
c AS (SELECT dst, n, line, floor(CAST('0x' || substr(md5(line || '|' || dst), 1, 13) AS BIGINT) / 4503599627370496.0 * 32) AS cell FROM k, l), s AS (SELECT line, cell, sum(n) AS n FROM c GROUP BY ALL)
SELECT c.dst, CAST(min(s.n) AS BIGINT) AS estimate, any_value(c.n) AS exact FROM c JOIN s USING (line, cell) GROUP BY c.dst""")
def count_min_peers(spark, d):
    """Flows of each destination by a narrow count-min sketch of two merged halves, and exactly."""
    f = T.flows(spark, d)
    halves = [K.count_min(f.where(F.col("dport") % 2 == i), "dst", width=32) for i in (0, 1)]
    exact = f.groupBy("dst").agg(F.count("*").alias("exact"))
    return K.estimates(K.merged(*halves), exact, "dst", width=32).join(exact, "dst").select("dst", F.col("estimate").cast("long").alias("estimate"), "exact")


@query(f"""WITH {T.FLOWS_SQL}, s AS (SELECT CAST(floor({X.portable_sql(0, "src")} * 8) AS INTEGER) AS shard FROM flows), n AS (SELECT shard, count(*) AS n FROM s GROUP BY ALL), e AS (SELECT CAST(unnest(range(8)) AS INTEGER) AS shard)
SELECT e.shard, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) / 8.0 FROM flows), 6) AS over_mean FROM e LEFT JOIN n USING (shard)""")
def shard_balance(spark, d):
    return K.shard_balance(T.flows(spark, d), 8, "src").withColumn("over_mean", F.round("over_mean", 6))


@query(f'WITH {SRC_SQL} SELECT "window", src, {r6_sql(SRC)} FROM src_cells')
def sharded_cells(spark, d):
    """Source cells of each shard of the sources for itself, put together: those of one run."""
    w = wf(spark, d)
    shard = K.shard_of(4, "src")
    out = None
    for i in range(4):
        one = H.src_cells(w.where(shard == i))
        out = one if out is None else out.unionByName(one)
    return r6(out.select("window", "src", *SRC), ["window", "src"])


@query(f'WITH {SRC_SQL} SELECT "window", src, n_flows FROM src_cells ORDER BY "window", src LIMIT 100')
def sorted_cells(spark, d):
    cells = H.pairs(wf(spark, d)).groupBy("window", "src").agg(F.sum("n").alias("n_flows"))
    return cells.orderBy("window", "src").limit(100)


@query(f"WITH {T.FLOWS_SQL} SELECT array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, count(DISTINCT label) AS n FROM flows")
def distinct_labels(spark, d):
    found = F.array_sort(F.collect_set("label"))
    return T.flows(spark, d).select("label").distinct().agg(F.array_join(found, ",").alias("labels"), F.count("*").alias("n"))


@query(f"WITH {T.FLOWS_SQL} SELECT dst, count(*) AS n FROM flows GROUP BY ALL ORDER BY n DESC, dst LIMIT 10")
def heavy_hitters_exact(spark, d):
    return T.flows(spark, d).groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(10)


@query(f"""WITH {T.PACKETS_SQL}, p AS (SELECT DISTINCT src_ip AS peer FROM packets), u AS (SELECT peer, {X.portable_sql(10, "peer")} < 0.05 AS listed, {X.portable_sql(11, "peer")} AS u, {X.portable_sql(12, "peer")} AS v FROM p),
r AS (SELECT peer, CASE WHEN listed AND v < 0.55 THEN 0.6 + 0.4 * u WHEN NOT listed AND v < 0.03 THEN 0.5 + 0.4 * u ELSE 0.0 END AS reputation FROM u) SELECT peer, round(reputation, 6) AS reputation, reputation > 0.5 AS flagged FROM r""")
def reputation_join(spark, d):
    """Peers with an outside service's word on them: it knows 55 % of listed ones, and takes 3 % of others for such."""
    peers = T.packets(spark, d).select(F.col("src_ip").alias("peer")).distinct()
    listed = peers.where(X.portable(10, F.col("peer")) < 0.05)
    return V.reputation(peers, listed).select("peer", F.round("reputation", 6).alias("reputation"), (F.col("reputation") > 0.5).alias("flagged"))
