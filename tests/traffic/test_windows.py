import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import hostwindow as H
from netloom.operators import metrics as M
from netloom.operators import visibility as V
from netloom.operators.campaigns import Diffusion, budget, diffuse, drawn_hosts, multiset
from netloom.sources import generator as G

S = 1_000_000


@pytest.fixture(scope="module")
def flows(spark):
    r = random.Random(3)
    rows = [(int(r.uniform(0, 300) * S), f"10.0.0.{r.randint(1, 29)}", f"10.0.1.{r.randint(1, 79)}", r.randint(1, 899), float(r.randint(1, 39)), float(r.randint(60, 3999))) for _ in range(3000)]
    return spark.createDataFrame(rows, "us long, src string, dst string, dport int, fwd_pkts double, fwd_bytes double").cache()


def test_merged_sides_are_the_unpivot(flows):
    w = H.windowed(flows, 60, 0)
    a, b = H.unpivot_cells(w), H.host_cells(w)
    common = [c for c in a.columns if c in b.columns]
    key = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*common).collect())
    assert key(a) == key(b)


def test_another_origin_shows(flows):
    a, b = (H.src_cells(H.windowed(flows, 60, t)).select("window", "src", "n_flows") for t in (0, 17 * S))
    assert a.intersect(b).count() < 0.95 * a.count()


def test_baseline_knows_earlier_windows_only(spark):
    rows = [(int(t * S), "h", "p", 80, 1.0, 1000.0) for t in (1, 2, 61, 62, 121)]
    w = H.windowed(spark.createDataFrame(rows, "us long, src string, dst string, dport int, fwd_pkts double, fwd_bytes double"), 60, 0)
    for decayed in (False, True):
        got = [r["bytes_vs_baseline"] for r in H.with_baseline(H.src_cells(w), decayed).orderBy("window").collect()]
        assert got[0] == 2000 and got[1] < 2


def test_every_flow_is_enriched(flows):
    w = H.windowed(flows, 60, 0)
    out = H.enriched_flows(w)
    assert out.count() == flows.count() and out.where("hw_src_n_flows < 1 or hw_dst_n_flows < 1").isEmpty()


def test_gaps_over_slices(spark):
    r = random.Random(9)
    rows = [(int(t * S), "flood", f"p{i % 3}", 80, 1.0, 1.0) for i, t in enumerate(sorted(r.uniform(0, 120) for _ in range(700)))]
    rows += [(int(t * S), "slow", "p", 80, 1.0, 1.0) for t in (3, 40, 59, 61)] + [(5 * S, "same", "p", None, 1.0, 1.0)] * 3 + [(200 * S, "one", "p", 80, 1.0, 1.0)]
    w = H.windowed(spark.createDataFrame(rows, "us long, src string, dst string, dport int, fwd_pkts double, fwd_bytes double"), 60, 0)
    got = {(x["window"], x["src"]): (x["iat_mean"], x["iat_cv"], x["n_dports"]) for x in H.src_cells(w).collect()}
    for (window, src), (mean, cv, n_ports) in got.items():
        ts = sorted(u / 1e6 for u, s, _, d, *_ in rows if s == src and u // (60 * S) == window)
        gaps = [b - a for a, b in zip(ts, ts[1:])]
        m = sum(gaps) / len(gaps) if gaps else 0.0
        sd = (sum((g - m) ** 2 for g in gaps) / len(gaps)) ** 0.5 if gaps else 0.0
        assert mean == pytest.approx(m) and cv == pytest.approx(sd / m if len(gaps) >= 2 and m > 1e-9 else 0.0)
        assert n_ports == (0 if src == "same" else 1)
    assert len(got) == 6


def test_profiles(spark):
    p = G.packets(spark, 0.01).cache()
    one = V.profile("DIODE_ONEWAY").apply(p)
    assert one.where("direction <> 1").isEmpty() and V.profile("FULL_ENRICHED").apply(p).count() == p.count()
    key = F.struct("src_ip", "dst_ip", "src_port", "dst_port", "proto")
    kept = V.profile("DIODE_ONEWAY_SAMPLED").apply(p)
    flows_kept, flows_all = kept.select(key.alias("k")).distinct(), one.select(key.alias("k")).distinct()
    assert one.join(kept.select(key.alias("k")).distinct(), key == F.col("k"), "left_semi").count() == kept.count()
    assert 0 < flows_kept.count() < flows_all.count() / 4
    with pytest.raises(KeyError):
        V.profile("x")
    assert p.select("label").distinct().count() == 7
    again = G.packets(spark, 0.01)
    assert p.exceptAll(again).isEmpty() and p.select("index").distinct().count() == p.count()


def test_conformal_edges(spark):
    with pytest.raises(ValueError):
        M.Conformal(0)
    df = spark.createDataFrame([([0.5, 0.5, 0.0], 0)], "probs array<double>, y int")
    c = M.Conformal(0.1, True)
    t = c.thresholds(df, "probs", "y", 3)
    assert [r["threshold"] for r in t.orderBy("label").collect()] == [0.5, 1.0, 1.0]
    r = c.decide(df, "probs", t).first()
    assert (r["predicted"], r["set_size"], r["abstained"]) == (0, 3, False)


def test_ece_edges(spark):
    df = spark.createDataFrame([(0.0, 1), (1.0, 1), (0.1, 0)], "c double, ok int")
    assert sorted((r["bin"], r["n"]) for r in M.ece_bins(df, "c", "ok").collect()) == [(0, 1), (9, 1)]


def test_budget_and_diffusion(spark):
    assert budget({"a": 10, "b": 1000, "c": 400}, 600) == {"a": 10, "c": 295, "b": 295}
    r = random.Random(5)
    rows = [(i, r.randrange(6000 * S), f"192.168.10.{r.randint(5, 29)}", "benign") for i in range(4000)] + [(4000 + i, r.randrange(200 * S), "172.16.0.1", "scan") for i in range(800)]
    w = H.windowed(spark.createDataFrame(rows, "id long, us long, src string, label string"), 60, 0)
    for density in (8.0, 1.0):
        out = diffuse(w, Diffusion(density, min_windows=20)).cache()
        assert out.where("label = 'benign'").exceptAll(w.where("label = 'benign'")).isEmpty()
        a = out.where("label = 'scan'")
        assert a.count() == 800 and a.join(w.where("label = 'benign'").select("src").distinct(), "src", "left_anti").isEmpty()
        per = a.groupBy("window", "src").count().agg(F.avg("count")).first()[0]
        assert per == pytest.approx(density, rel=0.35)
    with pytest.raises(ValueError):
        diffuse(w.where("label = 'benign'"), Diffusion(1.0))


def test_campaigns_draw_hosts_without_pairing_them(spark):
    campaigns = spark.range(3000).selectExpr("concat('c', id) as campaign", "1 + id % 7 as k")
    for n_hosts in (1, 8, 2000):
        out = drawn_hosts(campaigns, n_hosts, F.least(F.col("k"), F.lit(n_hosts).cast("long")), 0)
        rows = out.collect()
        by = {}
        for x in rows:
            assert 0 <= x["number"] < n_hosts
            by.setdefault(x["campaign"], []).append(x["number"])
        assert all(len(set(v)) == len(v) for v in by.values()) and len(by) == 3000
        assert len(rows) == sum(min(1 + i % 7, n_hosts) for i in range(3000))
        assert len({x["number"] for x in rows}) > 0.98 * n_hosts
        assert "CartesianProduct" not in (plan := out._jdf.queryExecution().toString()) and "NestedLoopJoin" not in plan


def test_diffusion_keeps_every_attack_and_pairs_no_tables(spark):
    r = random.Random(6)
    rows = [(i, r.randrange(3000 * S), f"h{r.randint(0, 30)}", "benign") for i in range(3000)] + [(3000 + i, r.randrange(3000 * S), f"a{i % 40}", r.choice(["scan", "exfil"])) for i in range(2000)]
    w = H.windowed(spark.createDataFrame(rows, "id long, us long, src string, label string"), 60, 0)
    out = diffuse(w, Diffusion(2.0, min_windows=20))
    # broadcasts of a row or a few thousand bucket totals apart, no table is paired with another
    assert "CartesianProduct" not in out._jdf.queryExecution().toString()
    assert {x["id"] for x in out.collect()} == set(range(5000)) and out.count() == 5000
    with pytest.raises(ValueError):
        diffuse(w.where("label = 'scan'"), Diffusion(1.0))


def test_multiset_sums_tell_rows_and_how_often_they_are(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z")], "k long, v string")
    mark = lambda df: tuple(df.agg(*multiset("k", "v")).first())
    assert mark(a) == mark(a.repartition(3).orderBy(F.desc("v")))
    assert len({mark(a), mark(a.distinct()), mark(a.where("k is not null")), mark(a.withColumn("k", F.col("k") + 1))}) == 4
