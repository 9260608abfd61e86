import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import alerts as A
from netloom.operators import detectors as D
from netloom.operators import metrics as M
from netloom.operators import ordered as O
from netloom.operators import sketches as K
from netloom.operators import visibility as V


@pytest.fixture(scope="module")
def values(spark):
    r = random.Random(4)
    rows = [(i, r.choice("ab"), r.choice([0.0, -2.5, r.random(), r.random() * 1e6]), r.randrange(50)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id long, g string, v double, w long").repartition(5).cache()


def test_running_sums_and_maxima(values):
    rows, df = values
    by_value = df.groupBy("g", "v").agg(F.sum("w").alias("w"), F.max("id").alias("m"))
    out = O.running(by_value, "v", {"s": ("sum", F.col("w")), "t": ("max", F.col("m"))}, by=("g",)).collect()
    for x in random.Random(1).sample(out, 60):
        upto = [(w, i) for i, g, v, w in rows if g == x["g"] and v <= x["v"]]
        assert (x["s"], x["t"]) == (sum(w for w, _ in upto), max(i for _, i in upto))
    down = O.running(by_value, "v", {"s": ("sum", F.col("w"))}, by=("g",), descending=True).collect()
    x = max(down, key=lambda x: x["s"])
    assert x["s"] == sum(w for _, g, _, w in rows if g == x["g"])


def test_numbers_and_quantiles(values, spark):
    rows, df = values
    got = {x["id"]: x["number"] for x in O.numbered(df, "v", "id").collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted((v, i) for i, _, v, _ in rows))}
    shares = [0.0, 0.1, 0.5, 0.777, 1.0]
    assert np.allclose(O.quantiles(df, "v", shares).first()["values"], np.quantile([v for _, _, v, _ in rows], shares))
    assert not O.quantiles(df.limit(0), "v", shares).first()["values"] and O.numbered(df.limit(0), "v").collect() == []
    one = spark.createDataFrame([(None, 1), (3.0, 2)], "v double, id int")
    assert O.quantiles(one, "v", [0.5]).first()["values"] == [3.0]


def test_best_threshold(spark):
    rows = [("x", 1, 0.9), ("x", 0, 0.8), ("x", 1, 0.7), ("x", 0, 0.1), ("y", 0, 0.5), ("y", 0, 0.4)]
    out = {r["g"]: r for r in M.best_threshold(spark.createDataFrame(rows, "g string, y int, p double"), "y", "p", ("g",)).collect()}
    assert out["x"]["threshold"] == 0.7 and out["x"]["f1"] == pytest.approx(0.8) and out["y"]["f1"] == 0
    assert M.average_precision(spark.createDataFrame(rows[4:], "g string, y int, p double"), "y", "p").first()[0] is None


def test_parts_of_windows(spark):
    out = M.temporal_parts(spark.range(20).withColumnRenamed("id", "window"), "window", (0.6, 0.15, 0.25)).collect()
    assert [sum(r["part"] == i for r in out) for i in range(3)] == [12, 3, 5]
    with pytest.raises(ValueError):
        M.temporal_parts(spark.range(2), "id", (0.5, 0.6))


def test_count_min_and_shards(values):
    rows, df = values
    df = df.withColumn("k", F.col("w").cast("string"))
    whole = K.count_min(df, "k", width=16)
    halves = K.merged(*(K.count_min(df.where(F.col("id") % 2 == i), "k", width=16) for i in (0, 1)))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, halves.collect())) and whole.count() <= 64
    for r in K.estimates(whole, df, "k", width=16).collect():
        assert r["estimate"] >= sum(w == int(r["k"]) for *_, w in rows)
    out = K.shard_balance(df, 8, "k").collect()
    assert len(out) == 8 and sum(r["n"] for r in out) == len(rows)


def test_columns_that_a_sensor_sees(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, "x")], "`Total Fwd Packet` double, `Down/Up Ratio` double, `Flow Bytes/s` double, Label string")
    assert V.observable(df, "oneway").columns == ["Total Fwd Packet"] and len(V.observable(df, "full").columns) == 3
    assert (len(V.SEES["full"]), len(V.SEES["oneway"])) == (103, 35) and V.column_class("Label") == "meta"
    with pytest.raises(ValueError):
        V.observable(df, "half")
    small = V.shrink(spark.createDataFrame([(1, 1 << 40, 0.5, "x")], "a long, b long, c double, d string"), ["d"])
    assert small.dtypes == [("a", "int"), ("b", "bigint"), ("c", "float")]
    assert [r["us"] for r in V.rebased(spark.createDataFrame([(7,), (9,)], "us long")).orderBy("us").collect()] == [0, 2]
    assert V.family(spark.createDataFrame([(1, 2)], "bi_a int, uni_a int"), "uni_").columns == ["uni_a"]


def test_alerts_from_decisions(spark):
    rows = [(1, "h", 0, 0.9, False, 1), (2, "h", 1, 0.9, False, 1), (3, "h", 0, 0.4, True, 2)]
    df = spark.createDataFrame(rows, "window long, host string, predicted int, confidence double, abstained boolean, set_size long").withColumn("features", F.create_map(F.lit("hw_src_fwd_bytes"), F.lit(5.0)))
    out = {r["window"]: (r["threat_class"], r["decision"]) for r in A.constructed(df, ["benign", "scan"], 60.0, ["alpha=0.1"]).collect()}
    assert out == {2: ("scan", "ALERT"), 3: ("benign", "ABSTAIN")}  # a benign decision is no alert, an abstention is an entry
    log = A.append(A.constructed(df, ["benign", "scan"], 60.0, ["alpha=0.1"]), b"k", A.model_digest("trees", 180, 5))
    one = A.summary_with_chain(log, b"k").first()
    assert one["chain_verified"] and one["entries"] == 2 and one["model_hash"] == A.model_digest("trees", 180, 5) != A.model_digest("trees", 180, 6)
    assert not A.summary_with_chain(log.withColumn("score", F.lit(0.0)), b"k").first()["chain_verified"]


def test_roster_and_one_model(spark):
    assert {r["threat_class"] for r in D.roster(spark).collect()} == set(D.HEADS)
    assert [h.features for h in D.build_heads(restrict=["hw_src_n_flows"])][1] == ["hw_src_n_flows"] and D.build_heads()[0].trees == 180
    r = random.Random(2)
    rows = [(x := r.random(), y := r.random(), "scan" if x > 0.6 else "ddos" if y > 0.7 else "benign") for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, label string")
    model = D.Multiclass(["benign", "ddos", "scan"], ["a", "b"], trees=8, depth=4).fit(df, "label")
    out = model.score(df).collect()
    assert sum(["benign", "ddos", "scan"][x["predicted"]] == x["label"] for x in out) > 370 and len(out[0]["probs"]) == 3
