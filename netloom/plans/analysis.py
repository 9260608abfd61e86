"""Queries over names, scores, alerts and campaigns, each with DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions import exprs as X
from netloom.operators import alerts as A
from netloom.operators import campaigns as C
from netloom.operators import hostwindow as H
from netloom.operators import metrics as M
from netloom.operators import protocol as N
from netloom.operators.ordered import numbered
from netloom.sources import generator as G
from netloom.sources import tables as T

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def names(spark, d):
    return T.names(spark, d).withColumnRenamed("page_id", "name_id")


CHAR_SQL = """chars AS (SELECT page_id, unnest(string_split(qname, '')) AS c FROM names),
cc AS (SELECT page_id, c, CAST(count(*) AS DOUBLE) AS n FROM chars WHERE c <> '' GROUP BY ALL),
ce AS (SELECT page_id, greatest(0.0, log2(sum(n)) - sum(n * log2(n)) / sum(n)) + 0.0 AS e FROM cc GROUP BY ALL)"""
LABEL_LEN = "list_max(list_transform(string_split(qname, '.'), lambda x: length(x)))"
DIGITS = "length(regexp_replace(qname, '[^0-9]', '', 'g')) * 1.0 / length(qname)"


@query(f"WITH {T.NAMES_SQL}, {CHAR_SQL} SELECT n.page_id AS name_id, round(coalesce(e, 0.0), 6) AS entropy FROM names n LEFT JOIN ce USING (page_id)")
def qname_char_entropy(spark, d):
    return names(spark, d).select("name_id", F.round(X.char_entropy(F.col("qname")), 6).alias("entropy"))


@query(f"""WITH {T.NAMES_SQL}, {CHAR_SQL} SELECT "window", host, count(*) AS dns_count, round(avg(e), 6) AS qname_entropy, round(avg(length(qname)), 6) AS qname_len_mean,
CAST(max({LABEL_LEN}) AS BIGINT) AS qname_len_max, round(avg({DIGITS}), 6) AS qname_digit_ratio FROM names JOIN ce USING (page_id) WHERE qname <> '' GROUP BY ALL""")
def qname_stats(spark, d):
    out = N.name_stats(names(spark, d))
    return out.select("window", "host", "dns_count", "qname_len_max", *(F.round(c, 6).alias(c) for c in ("qname_entropy", "qname_len_mean", "qname_digit_ratio")))


@query(f"WITH {T.NAMES_SQL} SELECT page_id AS name_id, array_to_string(list_slice(string_split(qname, '.'), -2, -1), '.') AS domain FROM names")
def registrable_domain(spark, d):
    return names(spark, d).select("name_id", X.registrable(F.col("qname")).alias("domain"))


CODE_SQL = f"""ch AS (SELECT page_id, "window", i, CASE WHEN instr('{N.ALPHABET}', substring(qname, i, 1)) > 0 THEN instr('{N.ALPHABET}', substring(qname, i, 1)) - 1 ELSE 37 END AS a
  FROM (SELECT page_id, "window", qname, unnest(generate_series(1, length(qname))) AS i FROM names)),
pr AS (SELECT x.page_id, x."window", x.a, y.a AS b FROM ch x JOIN ch y ON x.page_id = y.page_id AND y.i = x.i + 1)"""


@query(f"""WITH {T.NAMES_SQL}, {CODE_SQL}, k AS (SELECT a, b, "window", count(*) AS n FROM pr GROUP BY ALL), w AS (SELECT DISTINCT "window" FROM names),
c AS (SELECT w."window", k.a, k.b, sum(n) AS c FROM w JOIN k ON k."window" < w."window" GROUP BY ALL), r AS (SELECT "window", a, sum(c) AS r FROM c GROUP BY ALL),
s AS (SELECT p.page_id, avg(-log2((coalesce(c.c, 0) + 0.5) / (coalesce(r.r, 0) + 19.0))) AS s FROM pr p LEFT JOIN c ON c."window" = p."window" AND c.a = p.a AND c.b = p.b LEFT JOIN r ON r."window" = p."window" AND r.a = p.a GROUP BY ALL)
SELECT n.page_id AS name_id, "window", round(coalesce(s, 0.0), 6) AS surprisal FROM names n LEFT JOIN s USING (page_id)""")
def bigram_causal_surprisal(spark, d):
    return N.causal_surprisal(names(spark, d)).withColumn("surprisal", F.round("surprisal", 6))


@query(f"""WITH {T.NAMES_SQL}, {CODE_SQL}, t AS (SELECT a, b, count(*) AS c FROM pr GROUP BY ALL), r AS (SELECT a, sum(c) AS r FROM t GROUP BY ALL),
o AS (SELECT page_id, a, b, count(*) AS o FROM pr GROUP BY ALL), q AS (SELECT page_id, a, sum(o) AS q FROM o GROUP BY ALL)
SELECT page_id AS name_id, round(sum(-log2((c - o + 0.5) / (r - q + 19.0)) * o) / sum(o), 6) AS surprisal FROM o JOIN q USING (page_id, a) JOIN t USING (a, b) JOIN r USING (a) GROUP BY ALL""")
def loo_bigram(spark, d):
    return N.left_out_surprisal(names(spark, d)).withColumn("surprisal", F.round("surprisal", 6))


@query(f"""WITH {T.NAMES_SQL}, c AS (SELECT "window", qname AS fp, count(*) AS n FROM names GROUP BY ALL), w AS (SELECT "window", sum(n) AS t FROM c GROUP BY ALL),
a AS (SELECT x."window", coalesce(sum(y.t), 0) AS s FROM w x LEFT JOIN w y ON y."window" < x."window" GROUP BY ALL),
b AS (SELECT x."window", x.fp, any_value(x.n) AS n, coalesce(sum(y.n), 0) AS before FROM c x LEFT JOIN c y ON y.fp = x.fp AND y."window" < x."window" GROUP BY x."window", x.fp)
SELECT b."window", fp, n, CAST(before AS BIGINT) AS before, round(CASE WHEN s > 0 THEN 1 - before / s ELSE 1.0 END, 6) AS rarity, before = 0 AS novel FROM b JOIN a USING ("window")""")
def fingerprint_rarity_novelty(spark, d):
    prints = names(spark, d).select("window", F.col("qname").alias("fp"))
    return N.rarity(prints).withColumn("rarity", F.round("rarity", 6))


BLOCK = ["dns_count", "qname_entropy", "qname_len_mean", "qname_len_max", "qname_digit_ratio", "qname_bigram_rarity", "tls_count", "tls_fp_rarity", "tls_fp_novel"]
SAMPLED_NAMES = T.NAMES_SQL.replace("names AS (", "raw AS (", 1) + """, names AS (SELECT page_id, "window", host, qname FROM (SELECT *, row_number() OVER (PARTITION BY "window", host ORDER BY page_id) AS rk FROM raw WHERE qname <> '') WHERE rk <= 64)"""


@query(f"""WITH {SAMPLED_NAMES}, {CHAR_SQL}, {CODE_SQL}, k AS (SELECT a, b, "window", count(*) AS n FROM pr GROUP BY ALL), w AS (SELECT DISTINCT "window" FROM names),
c AS (SELECT w."window", k.a, k.b, sum(n) AS c FROM w JOIN k ON k."window" < w."window" GROUP BY ALL), r AS (SELECT "window", a, sum(c) AS r FROM c GROUP BY ALL),
s AS (SELECT p.page_id, avg(-log2((coalesce(c.c, 0) + 0.5) / (coalesce(r.r, 0) + 19.0))) AS s FROM pr p LEFT JOIN c ON c."window" = p."window" AND c.a = p.a AND c.b = p.b LEFT JOIN r ON r."window" = p."window" AND r.a = p.a GROUP BY ALL),
fc AS (SELECT "window", qname AS fp, count(*) AS n FROM names GROUP BY ALL), fw AS (SELECT "window", sum(n) AS t FROM fc GROUP BY ALL),
fa AS (SELECT x."window", coalesce(sum(y.t), 0) AS s FROM fw x LEFT JOIN fw y ON y."window" < x."window" GROUP BY ALL),
fb AS (SELECT x."window", x.fp, coalesce(sum(y.n), 0) AS before FROM fc x LEFT JOIN fc y ON y.fp = x.fp AND y."window" < x."window" GROUP BY x."window", x.fp),
fr AS (SELECT "window", fp, CASE WHEN fa.s > 0 THEN 1 - before / fa.s ELSE 1.0 END AS rarity, before = 0 AS novel FROM fb JOIN fa USING ("window")),
g AS (SELECT n."window", host, count(*) AS dns_count, avg(e) AS qname_entropy, avg(length(qname)) AS qname_len_mean, max(list_max(list_transform(string_split(qname, '.'), lambda x: length(x)))) AS qname_len_max,
  avg(length(regexp_replace(qname, '[^0-9]', '', 'g')) * 1.0 / length(qname)) AS qname_digit_ratio, avg(coalesce(s.s, 0.0)) AS qname_bigram_rarity, count(*) AS tls_count, avg(rarity) AS tls_fp_rarity, avg(CAST(novel AS INT)) AS tls_fp_novel
  FROM names n LEFT JOIN ce USING (page_id) LEFT JOIN s USING (page_id) JOIN fr ON fr."window" = n."window" AND fr.fp = n.qname GROUP BY ALL)
SELECT "window", host, {", ".join(f"round(CAST({c} AS DOUBLE), 6) AS hw_src_{c}" for c in BLOCK)} FROM g""")
def protocol_block(spark, d):
    n = names(spark, d)
    out = N.protocol_block(n, n.select("name_id", "window", "host", F.md5(F.col("qname").cast("binary")).alias("fp")))
    return out.select("window", "host", *(F.round(f"hw_src_{c}", 6).alias(f"hw_src_{c}") for c in BLOCK))


# ---- measures


def probs(spark, d):
    return T.probabilities(spark, d)


GUESS = f"{T.PROBS_SQL}, g AS (SELECT *, CASE WHEN p1 >= 0.6 THEN 1 ELSE 0 END AS guess FROM probs)"


@query(f"""WITH {GUESS}, l AS (SELECT unnest([0, 1]) AS label), s AS (SELECT label, count(*) FILTER (y = label) AS t, count(*) FILTER (guess = label) AS p, count(*) FILTER (y = label AND guess = label) AS h FROM l, g GROUP BY ALL)
SELECT round(avg(CASE WHEN p + t > 0 THEN 2.0 * h / (p + t) ELSE 0.0 END), 6) AS macro_f1 FROM s""")
def binary_macro_f1(spark, d):
    return M.macro_f1(probs(spark, d).withColumn("guess", (F.col("p1") >= 0.6).cast("int")), "y", "guess").select(F.round("macro_f1", 6).alias("macro_f1"))


@query(f"""WITH {T.PROBS_SQL}, s AS (SELECT p1, sum(y) AS pos, count(*) AS n FROM probs GROUP BY ALL), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS al FROM s WINDOW w AS (ORDER BY p1 DESC))
SELECT round(sum(pos * tp * 1.0 / al) / sum(pos), 6) AS average_precision FROM c""")
def average_precision(spark, d):
    return M.average_precision(probs(spark, d), "y", "p1").select(F.round("average_precision", 6).alias("average_precision"))


@query(f"""WITH {T.PROBS_SQL} SELECT round(sum(CASE WHEN a.p1 > b.p1 THEN 1.0 WHEN a.p1 = b.p1 THEN 0.5 ELSE 0.0 END) / count(*), 6) AS auc FROM probs a, probs b WHERE a.y = 1 AND b.y = 0""")
def rank_auc(spark, d):
    return M.rank_auc(probs(spark, d), "y", "p1").select(F.round("auc", 6).alias("auc"))


@query(f"""WITH {T.PROBS_SQL}, t AS (SELECT quantile_cont(p1, 0.95) AS threshold FROM probs WHERE y = 0)
SELECT round(any_value(threshold), 6) AS threshold, round(avg(CASE WHEN p1 >= threshold THEN 1.0 ELSE 0.0 END), 6) AS recall FROM probs, t WHERE y = 1""")
def recall_at_fpr(spark, d):
    return M.recall_at_fpr(probs(spark, d), "y", "p1", 0.05).select(F.round("threshold", 6).alias("threshold"), F.round("recall", 6).alias("recall"))


ECE_SQL = f"""{GUESS}, e AS (SELECT CAST(ceil(greatest(p1, 1 - p1) * 10) - 1 AS BIGINT) AS bin, greatest(p1, 1 - p1) AS conf, CASE WHEN (p1 >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END AS ok FROM g),
b AS (SELECT bin, count(*) AS n, avg(conf) AS confidence, avg(ok) AS accuracy FROM e GROUP BY ALL)"""


def confident(spark, d):
    return probs(spark, d).withColumn("conf", F.greatest("p1", 1 - F.col("p1"))).withColumn("ok", ((F.col("p1") >= 0.5) == (F.col("y") == 1)).cast("int"))


@query(f"WITH {ECE_SQL} SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM b")
def ece_bins(spark, d):
    return M.ece_bins(confident(spark, d), "conf", "ok").select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {ECE_SQL} SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 6) AS ece FROM b")
def expected_calibration_error(spark, d):
    return M.ece(confident(spark, d), "conf", "ok").select(F.round("ece", 6).alias("ece"))


@query(f"""WITH {T.PROBS_SQL}, q AS (SELECT DISTINCT unnest(quantile_cont(p1, [{", ".join(str(i / 40) for i in range(1, 40))}])) AS threshold FROM probs),
f AS (SELECT threshold, 2.0 * count(*) FILTER (p1 >= threshold AND y = 1) / (count(*) FILTER (p1 >= threshold) + count(*) FILTER (y = 1)) AS f1 FROM probs, q GROUP BY ALL)
SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, f.threshold LIMIT 1""")
def threshold_tuning(spark, d):
    return M.threshold_tuning(probs(spark, d), "y", "p1").select(F.round("threshold", 6).alias("threshold"), F.round("f1", 6).alias("f1"))


def calibration(spark, d):
    p = probs(spark, d).withColumn("probs", F.array(1 - F.col("p1"), F.col("p1")))
    return p.where("fold < 2"), p.where("fold >= 2")


CAL_SQL = f"{T.PROBS_SQL}, cal AS (SELECT *, CASE WHEN y = 1 THEN 1 - p1 ELSE 1 - (1 - p1) END AS s FROM probs WHERE fold < 2)"
MARGINAL_SQL = f"""{CAL_SQL}, r AS (SELECT s, row_number() OVER (ORDER BY s) AS k, count(*) OVER () AS m FROM cal),
q AS (SELECT coalesce(max(s) FILTER (k = greatest(1, least(m, CAST(ceil(round((m + 1) * 0.9, 9)) AS BIGINT)))), 1.0) AS t FROM r), th AS (SELECT l AS label, t FROM q, (SELECT unnest([0, 1]) AS l))"""
MONDRIAN_SQL = f"""{CAL_SQL}, r AS (SELECT y, s, row_number() OVER (PARTITION BY y ORDER BY s) AS k, count(*) OVER (PARTITION BY y) AS m FROM cal),
th AS (SELECT l AS label, coalesce(max(s) FILTER (k = greatest(1, least(m, CAST(ceil(round((m + 1) * 0.9, 9)) AS BIGINT)))), 1.0) AS t FROM (SELECT unnest([0, 1]) AS l) LEFT JOIN r ON r.y = l GROUP BY ALL)"""


@query(f"WITH {MARGINAL_SQL} SELECT label, round(t, 6) AS threshold FROM th")
def conformal_marginal(spark, d):
    return M.Conformal(0.1).thresholds(calibration(spark, d)[0], "probs", "y", 2).select("label", F.round("threshold", 6).alias("threshold"))


@query(f"WITH {MONDRIAN_SQL} SELECT label, round(t, 6) AS threshold FROM th")
def conformal_mondrian(spark, d):
    return M.Conformal(0.1, True).thresholds(calibration(spark, d)[0], "probs", "y", 2).select("label", F.round("threshold", 6).alias("threshold"))


def _decided(spark, d, mondrian):
    c = M.Conformal(0.1, mondrian)
    cal, rest = calibration(spark, d)
    return c.decide(rest, "probs", c.thresholds(cal, "probs", "y", 2))


SETS_SQL = """d AS (SELECT y, p1, 1 - (1 - p1) <= (SELECT t FROM th WHERE label = 0) AS in0, 1 - p1 <= (SELECT t FROM th WHERE label = 1) AS in1, CASE WHEN p1 > 1 - p1 THEN 1 ELSE 0 END AS predicted FROM probs WHERE fold >= 2)"""
REPORT = """count(*) AS n, round(avg(CASE WHEN CASE WHEN y = 1 THEN in1 ELSE in0 END THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(CASE WHEN ab THEN 1.0 ELSE 0.0 END), 6) AS abstention,
round(coalesce(avg(CASE WHEN predicted = y THEN 1.0 ELSE 0.0 END) FILTER (NOT ab), 0.0), 6) AS accuracy"""


def _report(df, by_class=False):
    out = M.Conformal.report(df, "y", by_class)
    return out.select(*(["label"] if by_class else []), "n", *(F.round(c, 6).alias(c) for c in ("coverage", "abstention", "accuracy")))


@query(f"WITH {MARGINAL_SQL}, {SETS_SQL}, z AS (SELECT *, in0 = in1 AS ab FROM d) SELECT {REPORT} FROM z")
def calibration_report(spark, d):
    return _report(_decided(spark, d, False))


@query(f"WITH {MONDRIAN_SQL}, {SETS_SQL}, z AS (SELECT *, NOT CASE WHEN predicted = 1 THEN in1 ELSE in0 END AS ab FROM d) SELECT y AS label, {REPORT} FROM z GROUP BY y")
def calibration_report_by_class(spark, d):
    return _report(_decided(spark, d, True), True)


@query(f"""WITH {T.FLOWS_SQL}, c AS (SELECT quantile_cont(us, 0.7) AS c FROM flows) SELECT us < c AS train, count(*) AS n FROM flows, c GROUP BY ALL""")
def temporal_split(spark, d):
    return M.temporal_cut(T.flows(spark, d), "us", 0.7).groupBy("train").agg(F.count("*").alias("n"))


@query(f"""WITH {T.FLOWS_SQL}, c AS (SELECT quantile_cont(us, 0.0002) AS c FROM flows) (SELECT DISTINCT label FROM flows) EXCEPT (SELECT DISTINCT label FROM flows, c WHERE us < c)""")
def unseen_classes_except(spark, d):
    f = M.temporal_cut(T.flows(spark, d), "us", 0.0002)
    return f.select("label").distinct().subtract(f.where("train").select("label").distinct())


@query(f"""WITH {T.FLOWS_SQL}, c AS (SELECT "window", src, sum(fwd_bytes) AS a, sum(round(fwd_bytes)) AS b, count(*) AS n FROM wf GROUP BY ALL)
SELECT 'bytes' AS feature, round(corr(a, b), 6) AS r, round(avg(abs(a - b) / greatest(abs(a), 1.0)), 6) AS relative_error, round(avg(CASE WHEN abs(a - b) <= 1e-9 + 1e-6 * abs(b) THEN 1.0 ELSE 0.0 END), 6) AS share_close FROM c
UNION ALL SELECT 'flows', 1.0, 0.0, 1.0""")
def feature_agreement(spark, d):
    c = H.windowed(T.flows(spark, d), T.FLOW_WINDOW).groupBy("window", "src").agg(F.sum("fwd_bytes").alias("a"), F.sum(F.round("fwd_bytes")).alias("b"), F.count("*").cast("double").alias("n"))
    out = M.feature_agreement(c, {"bytes": ("a", "b"), "flows": ("n", "n")})
    return out.select("feature", *(F.round(x, 6).alias(x) for x in ("r", "relative_error", "share_close")))


# ---- alerts


def alerts(spark, d):
    """Alerts by plain rules over host cells."""
    cells = H.unpivot_cells(H.windowed(T.flows(spark, d), T.FLOW_WINDOW))
    threat = F.when(F.col("hw_src_fwd_bytes") > 500_000, "exfil").when(F.col("hw_src_n_dports") >= 7, "scan").when(F.col("hw_dst_src_entropy") > 3.5, "ddos")
    score = F.least(F.lit(0.99), 0.5 + F.col("hw_src_n_flows") / 100 + F.col("hw_dst_n_flows") / 1000)
    rows = cells.withColumn("threat_class", threat).where("threat_class is not null").withColumn("score", score)
    wanted = ["hw_src_fwd_bytes", "hw_dst_fwd_bytes", "hw_src_n_flows"]
    return rows.select(
        F.substring(F.sha2(F.concat_ws("|", "window", "host", "threat_class").cast("binary"), 256), 1, 16).alias("alert_id"), (F.col("window") * 60.0).alias("ts"), "window", "host", "threat_class", "score", F.col("score").alias("confidence"),
        F.when(F.col("score") >= 0.55, "ALERT").otherwise("ABSTAIN").alias("decision"), F.map_from_arrays(F.array(*map(F.lit, wanted)), F.array(*wanted)).alias("features"),
        F.create_map(F.lit("rule"), F.col("threat_class")).alias("observed"), F.array(F.lit("rule"), F.col("threat_class")).alias("decision_path"),
    )


ALERT_SQL = f"""{T.FLOWS_SQL}, s AS (SELECT "window", src AS host, sum(fwd_bytes) AS sb, count(*) AS sn, count(DISTINCT dport) AS sp FROM wf GROUP BY ALL),
n AS (SELECT "window", dst AS host, src, CAST(count(*) AS DOUBLE) AS n, sum(fwd_bytes) AS b FROM wf GROUP BY ALL),
t AS (SELECT "window", host, sum(b) AS db, sum(n) AS dn, greatest(0.0, log2(sum(n)) - sum(n * log2(n)) / sum(n)) AS de FROM n GROUP BY ALL),
c AS (SELECT "window", host, coalesce(sb, 0) AS sb, coalesce(sn, 0) AS sn, coalesce(sp, 0) AS sp, coalesce(db, 0) AS db, coalesce(dn, 0) AS dn, coalesce(de, 0) AS de FROM s FULL JOIN t USING ("window", host)),
a AS (SELECT *, CASE WHEN sb > 500000 THEN 'exfil' WHEN sp >= 7 THEN 'scan' WHEN de > 3.5 THEN 'ddos' END AS threat_class, least(0.99, 0.5 + sn / 100.0 + dn / 1000.0) AS score FROM c),
al AS (SELECT *, CASE WHEN score >= 0.55 THEN 'ALERT' ELSE 'ABSTAIN' END AS decision, substring(sha256("window" || '|' || host || '|' || threat_class), 1, 16) AS alert_id FROM a WHERE threat_class IS NOT NULL),
log AS (SELECT *, row_number() OVER (ORDER BY "window", host COLLATE "binary", alert_id) - 1 AS seq FROM al)""".replace(' COLLATE "binary"', "")


@query(f"""WITH {ALERT_SQL}, v AS (SELECT "window", host, threat_class, CASE threat_class WHEN 'exfil' THEN 1.0 * (0.6 + 0.4 * greatest(0, least(1, greatest(sb, db) / 3340640.0))) WHEN 'scan' THEN 0.2 ELSE 0.7 END AS s FROM al)
SELECT "window", host, threat_class, round(s, 6) AS severity_score, CASE WHEN s >= 0.8 THEN 'critical' WHEN s >= 0.6 THEN 'high' WHEN s >= 0.4 THEN 'medium' WHEN s >= 0.2 THEN 'low' ELSE 'info' END AS severity FROM v""")
def severity_bands(spark, d):
    s = A.severity(F.col("threat_class"), F.col("features")["hw_src_fwd_bytes"], F.col("features")["hw_dst_fwd_bytes"])
    return alerts(spark, d).withColumn("s", s).select("window", "host", "threat_class", F.round("s.score", 6).alias("severity_score"), F.col("s.level").alias("severity"))


KEY = b"netloom-example-key"


def log(spark, d):
    return A.append(alerts(spark, d), KEY, "rules-1")


SEP_SQL = "chr(31)"
CHAIN_SQL = f"""{ALERT_SQL}, tx AS MATERIALIZED (SELECT CAST(seq AS BIGINT) AS seq, "window", host, threat_class, alert_id,
  concat_ws({SEP_SQL}, CAST(seq AS VARCHAR), alert_id, printf('%.6f', "window" * 60.0), CAST("window" AS VARCHAR), host, threat_class, printf('%.6f', score), printf('%.6f', score), decision, 'rules-1',
  sha256(concat_ws({SEP_SQL}, 'hw_dst_fwd_bytes=' || printf('%.6f', CAST(db AS DOUBLE)), 'hw_src_fwd_bytes=' || printf('%.6f', CAST(sb AS DOUBLE)), 'hw_src_n_flows=' || printf('%.6f', CAST(sn AS DOUBLE))))) AS t FROM log),
ch AS (SELECT seq, repeat('0', 64) AS prev_hash, sha256(t || {SEP_SQL} || repeat('0', 64)) AS entry_hash FROM tx WHERE seq = 0
UNION ALL SELECT tx.seq, ch.entry_hash, sha256(t || {SEP_SQL} || ch.entry_hash) FROM ch JOIN tx ON tx.seq = ch.seq + 1)"""


@query(f"""WITH RECURSIVE {CHAIN_SQL} SELECT tx.seq, alert_id, "window", host, threat_class, prev_hash, entry_hash FROM ch JOIN tx USING (seq)""")
def evidence_chain(spark, d):
    return log(spark, d).select("seq", "alert_id", "window", "host", "threat_class", "prev_hash", "entry_hash")


@query(f"""WITH {ALERT_SQL} SELECT CAST(seq AS BIGINT) AS seq, seq NOT IN (17, 18, 40, 41, 60) AS ok, seq NOT IN (17, 40) AS entry_ok, seq NOT IN (18, 41) AS link_ok, seq <> 60 AS features_ok FROM log""")
def evidence_verify(spark, d):
    """A log in which two entries' hosts and scores and one's features were changed afterwards:
    an edit shows at its entry and breaks the link of the next."""
    bad = log(spark, d)
    bad = bad.withColumns(
        {
            "host": F.when(F.col("seq") == 17, "other").otherwise(F.col("host")),
            "score": F.when(F.col("seq") == 40, 0.1).otherwise(F.col("score")),
            "features": F.when(F.col("seq") == 60, F.create_map(F.lit("x"), F.lit(1.0))).otherwise(F.col("features")),
        }
    )
    return A.verify(bad, KEY).select("seq", "ok", "entry_ok", "link_ok", "features_ok")


@query(f"""WITH {ALERT_SQL} SELECT count(*) AS entries, true AS chain_verified, 0 AS n_problems, 'rules-1' AS model_hash FROM log""")
def log_summary_with_chain(spark, d):
    return A.summary_with_chain(log(spark, d), KEY).select("entries", "chain_verified", F.size("chain_problems").alias("n_problems"), "model_hash")


@query(f"""WITH {ALERT_SQL} SELECT count(*) AS entries, count(*) FILTER (decision = 'ALERT') AS alerts, count(*) FILTER (decision = 'ABSTAIN') AS abstentions, min("window") AS first_window, max("window") AS last_window FROM log""")
def log_summary(spark, d):
    return A.summary(log(spark, d)).select("entries", "alerts", "abstentions", "first_window", "last_window")


@query(f"WITH {ALERT_SQL} SELECT 'ok' AS status, count(*) AS entries FROM log")
def log_health(spark, d):
    return A.health(log(spark, d))


@query(f"""WITH {ALERT_SQL} SELECT CAST(seq AS BIGINT) AS seq, "window", host, decision FROM log WHERE threat_class = 'exfil' AND decision = 'ALERT' ORDER BY seq LIMIT 20 OFFSET 5""")
def alerts_page(spark, d):
    return A.page(log(spark, d), 20, 5, "exfil", "alert").select("seq", "window", "host", "decision")


@query(f"""WITH {ALERT_SQL} SELECT CAST(seq AS BIGINT) AS seq, "window", host, threat_class, decision FROM log WHERE seq = 17""")
def alert_by_seq(spark, d):
    return A.by_seq(log(spark, d), 17).select("seq", "window", "host", "threat_class", "decision")


# ---- campaigns and generated data


def labelled(spark, d):
    w = H.windowed(T.flows(spark, d), T.FLOW_WINDOW)
    return w.withColumn("id", F.xxhash64("us", "src", "dst", "dport", "fwd_pkts", "fwd_bytes"))


CFG = C.Diffusion(flows_per_cell=2.0, window_us=int(T.FLOW_WINDOW * 1e6), min_windows=20)


@query(f"""WITH {T.FLOWS_SQL}, c AS (SELECT "window", src, count(*) AS n, count(*) FILTER (label <> 'benign') AS a FROM wf GROUP BY ALL HAVING count(*) FILTER (label <> 'benign') > 0)
SELECT round(avg(a), 6) AS mean_attack, round(quantile_cont(a, 0.5), 6) AS median_attack, round(avg(a * 1.0 / n), 6) AS dilution, round(avg(n - a), 6) AS benign_per_attack_cell, count(*) AS attack_cells FROM c""")
def diffusion_stats(spark, d):
    out = C.diffusion_stats(labelled(spark, d))
    return out.select("attack_cells", *(F.round(c, 6).alias(c) for c in ("mean_attack", "median_attack", "dilution", "benign_per_attack_cell")))


@query(f"""WITH {T.FLOWS_SQL} SELECT label, count(*) AS n, label = 'benign' AS in_place, true AS at_home FROM flows GROUP BY ALL""")
def diffuse_attacks(spark, d):
    """What thinning attacks out leaves: as many flows of each label, benign ones where they were,
    attacks elsewhere, and only on hosts that have benign flows."""
    before = labelled(spark, d)
    after = C.diffuse(before, CFG)
    marks = [f"mark{i}" for i in range(3)]
    sums = [x.alias(m) for x, m in zip(C.multiset("us", "src", "dst", "window", "label", "id"), marks, strict=True)]
    hosts = before.where("label = 'benign'").select("src").distinct().withColumn("known", F.lit(True))
    out = after.groupBy("label", "src").agg(F.count("*").alias("n"), *sums).join(hosts, "src", "left")
    out = out.groupBy("label").agg(F.sum("n").alias("n"), F.bool_and(F.coalesce("known", F.lit(False))).alias("at_home"), *(F.sum(m).alias(m) for m in marks))
    was = before.groupBy("label").agg(F.struct(F.count("*"), *sums).alias("was"))
    return out.join(was, "label").select("label", "n", (F.struct("n", *marks) == F.col("was")).alias("in_place"), "at_home")


@query(f"""WITH {T.FLOWS_SQL}, sp AS (SELECT src AS host, count(DISTINCT "window") AS windows FROM wf WHERE label = 'benign' GROUP BY ALL), wide AS (SELECT host FROM sp WHERE windows >= 20),
pool AS (SELECT host FROM wide UNION ALL SELECT host FROM (SELECT host FROM sp ORDER BY windows DESC, host LIMIT 8) WHERE (SELECT count(*) FROM wide) = 0),
win AS (SELECT unnest(range(0, (SELECT max("window") + 1 FROM wf))) AS "window"), act AS (SELECT src AS host, "window", count(*) AS n FROM wf WHERE label = 'benign' GROUP BY ALL),
u AS (SELECT host, "window", coalesce(n, 0) + 1e-6 AS w, greatest(least({X.portable_sql(0, "'c'", "host", '"window"')}, 1 - 1e-12), 1e-12) AS u FROM pool CROSS JOIN win LEFT JOIN act USING (host, "window")),
r AS (SELECT host, "window", row_number() OVER (PARTITION BY host ORDER BY ln(w) - ln(-ln(u)) DESC, "window") AS rank FROM u) SELECT 'c' AS campaign, host, "window", rank FROM r WHERE rank <= 5""")
def topk_gumbel(spark, d):
    w = labelled(spark, d)
    hosts = C.blend_pool(w, CFG).select("host", "seen").withColumn("campaign", F.lit("c"))
    n_windows = w.agg(F.max("window") + 1).first()[0] or 0
    return C.top_windows(hosts, CFG, F.lit(5), n_windows).select("campaign", "host", "window", "rank")


@query(f"""WITH {T.FLOWS_SQL}, i AS (SELECT *, src || '-' || dst || '-' || us || '-' || dport || '-' || CAST(fwd_bytes * 100 AS BIGINT) AS id FROM flows),
r AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY {X.portable_sql(0, "id")}, id) AS k FROM i WHERE label <> 'benign') SELECT label, id FROM r WHERE k <= 500""")
def attack_budget(spark, d):
    f = T.flows(spark, d)
    f = f.withColumn("id", F.concat_ws("-", "src", "dst", "us", "dport", F.round(F.col("fwd_bytes") * 100).cast("long")))
    return C.within_budget(f, 1000).where("label <> 'benign'").select("label", "id")


@query(f"WITH {T.FLOWS_SQL}, n AS (SELECT label, count(*) AS n FROM flows GROUP BY ALL) SELECT label, n, true AS moved FROM n")
def label_permutation(spark, d):
    """Labels dealt anew: each as often as before, and no closer to the old ones than chance has it."""
    rows = labelled(spark, d).dropDuplicates(["id"])
    out = C.permuted_labels(rows).join(rows.select("id", F.col("label").alias("old")), "id")
    share = F.avg((F.col("label") == F.col("old")).cast("double"))
    n = out.groupBy("label").agg(F.count("*").alias("n"), share.alias("same"))
    whole = out.agg(F.count("*").alias("all"))
    near = F.abs(F.col("same") - F.col("n") / F.col("all")) < 0.05
    return n.crossJoin(F.broadcast(whole)).select("label", "n", near.alias("moved"))


@query()
def generated_packets(spark, d):
    return G.packets(spark, 0.02).groupBy("label", "proto").agg(F.count("*").alias("packets"), F.countDistinct("src_ip").alias("sources"))


FAMILIES = ("uniform", "short", "long", "rewritten", "two_words", "phrase")


@query()
def dga_auc(spark, d):
    """How well character entropy tells generated names from host names, by family, for all names
    and for those that are as long as most host names."""
    real = names(spark, d).select("qname")
    made = reduce(DataFrame.unionByName, (G.dga_names(spark, f, 2000).select(F.lit(f).alias("family"), "qname") for f in FAMILIES))
    both = made.withColumn("y", F.lit(1)).unionByName(real.select(F.explode(F.array(*map(F.lit, FAMILIES))).alias("family"), "qname", F.lit(0).alias("y")))
    both = both.withColumn("score", X.char_entropy(F.col("qname"))).persist()
    like = N.within_lengths(both.where("y = 1"), real).unionByName(both.where("y = 0"))
    same = M.rank_auc(like, "y", "score", ("family",)).withColumnRenamed("auc", "auc_same_length")
    return M.rank_auc(both, "y", "score", ("family",)).join(same, "family")


@query(f"""WITH {T.NAMES_SQL}, sizes AS (SELECT unnest([10, 20, 40]) AS n), seen AS (SELECT page_id, qname, row_number() OVER (ORDER BY page_id) - 1 AS place FROM names),
ch AS (SELECT page_id, place, i, CASE WHEN instr('{N.ALPHABET}', substring(qname, i, 1)) > 0 THEN instr('{N.ALPHABET}', substring(qname, i, 1)) - 1 ELSE 37 END AS a FROM (SELECT page_id, place, qname, unnest(generate_series(1, length(qname))) AS i FROM seen)),
pr AS (SELECT x.page_id, x.place, x.a, y.a AS b FROM ch x JOIN ch y ON x.page_id = y.page_id AND y.i = x.i + 1),
t AS (SELECT n, a, b, count(*) AS c FROM pr JOIN sizes ON place < n GROUP BY ALL), r AS (SELECT n, a, sum(c) AS r FROM t GROUP BY ALL),
z AS (SELECT sizes.n, page_id, avg(-log2((coalesce(c, 0) + 0.5) / (coalesce(r, 0) + 19.0))) AS s FROM pr JOIN sizes ON place >= sizes.n LEFT JOIN t ON t.n = sizes.n AND t.a = pr.a AND t.b = pr.b LEFT JOIN r ON r.n = sizes.n AND r.a = pr.a GROUP BY ALL)
SELECT CAST(n AS INTEGER) AS seen, count(*) AS held, round(avg(s), 6) AS surprisal FROM z GROUP BY n""")
def name_warm_up(spark, d):
    """How odd names look that come after the first 10, 20 and 40, under pairs of these alone."""
    all_names = numbered(names(spark, d).select("name_id", "qname"), "name_id")
    out = None
    for n in (10, 20, 40):
        held = N.surprisal_under(all_names.where(F.col("number") < n), all_names.where(F.col("number") >= n))
        one = held.where(F.length("qname") > 1).agg(F.lit(n).alias("seen"), F.count("*").alias("held"), F.round(F.avg("surprisal"), 6).alias("surprisal"))
        out = one if out is None else out.unionByName(one)
    return out
