"""Queries that compare: labels, splits, sources, detectors and rungs of visibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.functions.exprs import portable
from netloom.operators import detectors as D
from netloom.operators import hostwindow as H
from netloom.operators import metrics as M
from netloom.operators import packetcell as P
from netloom.operators import visibility as V
from netloom.sources import corpus as C
from netloom.plans.traffic import SAMPLED_SQL
from netloom.schema import CLASSES, HOST_FEATURES
from netloom.sources import tables as T

QUERIES, ORACLE = {}, {}
DAY_US = 86_400_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def wf(spark, d):
    return H.windowed(T.flows(spark, d), T.FLOW_WINDOW)


@query(f"""WITH {T.PACKETS_SQL} SELECT 'FULL_ENRICHED' AS profile, count(*) AS packets, count(DISTINCT src_ip) AS sources FROM packets UNION ALL SELECT 'DIODE_FULL', count(*), count(DISTINCT src_ip) FROM packets
UNION ALL SELECT 'DIODE_ONEWAY', count(*), count(DISTINCT src_ip) FROM packets WHERE direction = 1
UNION ALL SELECT 'DIODE_ONEWAY_SAMPLED', count(*), count(DISTINCT src_ip) FROM packets WHERE {SAMPLED_SQL}""")
def visibility_ladder(spark, d):
    rungs = [p.apply(T.packets(spark, d)).agg(F.lit(p.name).alias("profile"), F.count("*").alias("packets"), F.countDistinct("src_ip").alias("sources")) for p in V.LADDER]
    return reduce(DataFrame.unionByName, rungs)


@query(f"""WITH {T.PACKETS_SQL}, e AS (SELECT CAST(floor(us / {DAY_US}) AS BIGINT) AS "window", src_ip AS host, label FROM packets UNION ALL SELECT CAST(floor(us / {DAY_US}) AS BIGINT), dst_ip, label FROM packets),
s AS (SELECT "window", host, label FROM e WHERE label <> 'benign' GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM s GROUP BY ALL),
r AS (SELECT s.*, row_number() OVER (PARTITION BY "window", host ORDER BY n, s.label) AS k FROM s JOIN n USING (label)) SELECT "window", host, label FROM r WHERE k = 1""")
def label_collapse(spark, d):
    """One label for cells with several: the rarest over all cells."""
    sets = P.label_sets(P.ends(T.packets(spark, d), DAY_US)).select("window", "host", F.explode("labels").alias("label"))
    n = sets.groupBy("label").agg(F.count("*").alias("n"))
    return sets.join(F.broadcast(n), "label").groupBy("window", "host").agg(F.min_by("label", F.struct("n", "label")).alias("label"))


@query(f"""WITH {T.PACKETS_SQL}, e AS (SELECT CAST(floor(us / {DAY_US}) AS BIGINT) AS "window", src_ip AS host, label, flags FROM packets UNION ALL SELECT CAST(floor(us / {DAY_US}) AS BIGINT), dst_ip, label, flags FROM packets),
s AS (SELECT "window", host, bool_or(label = 'scan') AS scan, bool_or(label = 'dga') AS dga, bool_or(flags & 4 <> 0) AS p_scan, bool_or(flags & 2 <> 0) AS p_dga FROM e GROUP BY ALL)
SELECT count(*) FILTER (scan AND dga) AS both_true, count(*) FILTER (scan AND dga AND p_scan AND p_dga) AS both_found, CAST(sum(CAST(scan AND p_scan AS INT) + CAST(dga AND p_dga AS INT)) AS BIGINT) AS labels_found FROM s""")
def multilabel_recovery(spark, d):
    """How many labels of cells a rule for each class brings back, and how many pairs."""
    e = P.ends(T.packets(spark, d), DAY_US)
    flags = F.collect_set(F.when(F.col("flags").bitwiseAND(4) != 0, "scan").when(F.col("flags").bitwiseAND(2) != 0, "dga"))
    sets = P.label_sets(e).join(e.groupBy("window", "host").agg(flags.alias("found")), ["window", "host"])
    hit = F.size(F.array_intersect("labels", "found"))
    return sets.agg(F.count_if(F.size("labels") == 2).alias("both_true"), F.count_if((F.size("labels") == 2) & (hit == 2)).alias("both_found"), F.sum(hit).cast("long").alias("labels_found"))


@query(f"""WITH {T.FLOWS_SQL}, a AS (SELECT "window", src, count(*) AS n FROM wf GROUP BY ALL), b AS (SELECT "window", src, count(*) AS n FROM wf WHERE dport <= 5 GROUP BY ALL)
SELECT count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL) AS shared, count(*) FILTER (b.n IS NULL) AS only_a, count(*) FILTER (a.n <> b.n) AS mismatches FROM a FULL JOIN b USING ("window", src)""")
def cell_comparison(spark, d):
    """Two runs cell by cell: keys in both, in one, and values that differ."""
    a = wf(spark, d).groupBy("window", "src").agg(F.count("*").alias("x"))
    b = wf(spark, d).where("dport <= 5").groupBy("window", "src").agg(F.count("*").alias("y"))
    j = a.join(b, ["window", "src"], "full_outer")
    return j.agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("shared"), F.count_if(F.col("y").isNull()).alias("only_a"), F.count_if(F.col("x") != F.col("y")).alias("mismatches"))


@query(f"""WITH {T.FLOWS_SQL}, c AS (SELECT quantile_cont(us, 0.0002) AS c FROM flows), k AS (SELECT DISTINCT label FROM flows, c WHERE us < c)
SELECT f.label, count(*) AS n, f.label IN (SELECT label FROM k) AS known FROM flows f, c WHERE us >= c GROUP BY ALL""")
def known_class_split(spark, d):
    """Test rows by whether training has seen their class."""
    f = M.temporal_cut(T.flows(spark, d), "us", 0.0002)
    known = f.where("train").select("label").distinct().withColumn("known", F.lit(True))
    return f.where("not train").groupBy("label").agg(F.count("*").alias("n")).join(F.broadcast(known), "label", "left").select("label", "n", F.coalesce("known", F.lit(False)).alias("known"))


@query(f"""WITH {T.FLOWS_SQL}, a AS (SELECT DISTINCT src AS host FROM flows WHERE label <> 'benign'), b AS (SELECT DISTINCT dst AS host FROM flows WHERE label <> 'benign') SELECT host FROM a UNION SELECT host FROM b""")
def attack_hosts_union(spark, d):
    f = T.flows(spark, d).where("label <> 'benign'")
    return f.select(F.col("src").alias("host")).union(f.select("dst")).distinct()


@query("""SELECT event_type AS label, count(*) AS n, count(*) FILTER (event_type <> 'view') AS y FROM events GROUP BY ALL""")
def class_histogram(spark, d):
    e = T.read(spark, d, "events").select(F.col("event_type").alias("Label"))
    return C.binary_labels(e, "view").groupBy(F.col("Label").alias("label")).agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("y"))


@query(f"""WITH {T.FLOWS_SQL}, b AS (SELECT min("window") AS lo, max("window") AS hi FROM wf)
SELECT CASE WHEN "window" >= lo + floor((hi - lo + 1) * 0.75) THEN 2 WHEN "window" >= lo + floor((hi - lo + 1) * 0.6) THEN 1 ELSE 0 END AS part, count(*) AS n, min("window") AS first_window FROM wf, b GROUP BY ALL""")
def temporal_parts(spark, d):
    """Fit, calibration and test on whole windows: 60, 15 and 25 %."""
    return M.temporal_parts(wf(spark, d), "window", (0.60, 0.15, 0.25)).groupBy("part").agg(F.count("*").alias("n"), F.min("window").alias("first_window"))


@query(f"""WITH {T.FLOWS_SQL}, c AS (SELECT "window", src, count(*) AS n_flows, sum(fwd_bytes) AS fwd_bytes FROM wf GROUP BY ALL)
SELECT f."window", f.src, f.dst, f.dport, coalesce(c.n_flows, 0) AS n_flows, round(coalesce(c.fwd_bytes, 0), 4) AS bytes FROM wf f LEFT JOIN c USING ("window", src)""")
def cells_reattached(spark, d):
    """Cells made elsewhere, as a stream makes them, put back on the flows by window and host."""
    w = wf(spark, d)
    cells = H.unpivot_cells(w).select("window", F.col("host").alias("src"), F.col("hw_src_n_flows").cast("long").alias("n_flows"), F.col("hw_src_fwd_bytes").alias("b"))
    return H.reattached(w, cells, "src").select("window", "src", "dst", "dport", "n_flows", F.round("b", 4).alias("bytes"))


@query(f"""WITH {T.FLOWS_SQL} SELECT src, dst, dport FROM wf ORDER BY us, src, dst, dport, fwd_bytes LIMIT 50""")
def sorted_head(spark, d):
    return wf(spark, d).orderBy("us", "src", "dst", "dport", "fwd_bytes").limit(50).select("src", "dst", "dport")


#: What a made-up label of each class hangs on, one feature; the last two stand for names and handshakes.
SIGNS = {"ddos": "hw_dst_n_srcs", "scan": "hw_src_n_dports", "beacon": "hw_src_iat_cv", "exfil": "hw_src_fwd_bytes", "dga": "hw_src_qname_bigram_rarity", "encrypted": "hw_src_tls_fp_rarity"}
PROTOCOL = ["qname_entropy", "qname_len_mean", "qname_len_max", "qname_digit_ratio", "qname_bigram_rarity", "dns_count", "tls_fp_rarity", "tls_fp_novel", "tls_count"]
FEATURES = [*HOST_FEATURES, *(f"hw_src_{c}" for c in PROTOCOL)]


def labelled_cells(spark, d) -> DataFrame:
    """Host cells with protocol features that a hash makes up, and six labels that may co-occur: the
    upper quarter of one feature each. `part` is 0 for fitting, 1 for tuning, 2 for testing."""
    cells = H.host_cells(wf(spark, d))
    cells = cells.withColumns({f"hw_src_{c}": portable(50 + i, F.col("window"), F.col("host")) for i, c in enumerate(PROTOCOL)})
    over = cells.agg(*(F.percentile_approx(c, 0.75, 1000).alias(t) for t, c in SIGNS.items())).first()
    cells = cells.withColumns({t: (F.col(c) > F.lit(over[t])).cast("int") for t, c in SIGNS.items()})
    return M.temporal_parts(cells, "window", (0.60, 0.10, 0.30)).persist()


@query()
def detector_heads(spark, d):
    """All six detectors and one model for all classes, fitted on the first windows, thresholds
    tuned on the next, measured on the rest: average precision and F1 of each class."""
    rows = labelled_cells(spark, d)
    fit, tune, test = (rows.where(F.col("part") == i) for i in range(3))
    heads = D.build_heads(trees=TREES)
    ensemble = D.Ensemble(heads).fit(fit, {t: t for t in SIGNS})
    n = fit.agg(*(F.sum(t).alias(t) for t in SIGNS)).first()
    rarest = reduce(lambda c, t: c.when(F.col(t) == 1, t), sorted(SIGNS, key=lambda t: (n[t], t)), F.when(F.lit(False), "")).otherwise("benign")
    one_model = D.Multiclass(CLASSES, FEATURES, trees=TREES).fit(fit.withColumn("one", rarest), "one")

    def by_class(cells: DataFrame) -> DataFrame:
        """A row a cell and class: the truth, the detector's and the one model's probability."""
        scored = one_model.score(ensemble.score(cells))
        of = [F.struct(F.lit(t).alias("threat"), F.col(t).alias("y"), F.col(f"p_{t}").alias("p"), F.coalesce(F.get("probs", F.lit(CLASSES.index(t))), F.lit(0.0)).alias("q")) for t in SIGNS]
        return scored.select(F.explode(F.array(*of)).alias("x")).select("x.*").persist()

    tuned, tested = by_class(tune), by_class(test)
    cut = M.best_threshold(tuned, "y", "p", ("threat",)).select("threat", "threshold")
    guess = tested.join(F.broadcast(cut), "threat").withColumn("guess", (F.col("p") >= F.col("threshold")).cast("int"))
    hit, all_of = F.sum(F.col("guess") * F.col("y")), F.sum(F.col("guess") + F.col("y"))
    f1 = guess.groupBy("threat").agg(F.sum("y").alias("support"), F.coalesce(2 * hit / F.nullif(all_of, F.lit(0)), F.lit(0.0)).alias("f1"))
    ap = M.average_precision(tested, "y", "p", ("threat",))
    multi = M.average_precision(tested, "y", "q", ("threat",)).withColumnRenamed("average_precision", "ap_one_model")
    why = spark.createDataFrame([(h.threat, h.explain()) for h in heads], "threat string, why string")
    return reduce(lambda a, b: a.join(b, "threat"), (f1, ap, multi, why))


#: Trees of the models that queries fit; detectors have 180 of depth 5 unless told otherwise.
TREES = 5


@query()
def visibility_models(spark, d):
    """A model of attack cells on each rung of visibility: what the features that it leaves are
    worth, as average precision on later windows."""
    packets = T.packets(spark, d)
    out = []
    for p in V.LADDER:
        seen = p.apply(packets).persist()
        cells = P.families(P.cells(seen, DAY_US, reputation=T.reputation(spark, d) if p.enrichment else None))
        truth = P.majority_label(P.ends(packets, DAY_US)).select("window", "host", (F.col("label") != "benign").cast("int").alias("y"))
        rows = M.temporal_parts(cells.join(truth, ["window", "host"]), "window", (0.7, 0.3)).persist()
        kind = "uni" if p.one_way else "bi"
        head = D.Head("scan", trees=TREES, depth=3)
        head.features = [c for c in rows.columns if c.startswith(f"{kind}_")]
        scored = head.fit(rows.where("part = 0"), "y").score(rows.where("part = 1"))
        out.append(scored.select(F.lit(p.name).alias("profile"), F.lit(kind).alias("family"), "y", "p_scan"))
    return M.average_precision(reduce(DataFrame.unionByName, out), "y", "p_scan", ("profile", "family"))


ROSTER_SQL = " UNION ALL ".join(f"SELECT '{t}' AS threat_class, {len(f)} AS n_features, {str(D.MECHANISM[t][1]).lower()} AS known_gap" for t, f in D.HEADS.items())


@query(ROSTER_SQL)
def head_roster(spark, d):
    return D.roster(spark).select("threat_class", F.size("declared_features").alias("n_features"), "known_gap")
