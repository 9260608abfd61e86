import pytest
from pyspark.sql import functions as F

from netloom.operators import alerts as A

SCHEMA = "alert_id string, ts double, window long, host string, threat_class string, score double, confidence double, decision string, features map<string,double>, observed map<string,string>, decision_path array<string>"


@pytest.fixture(scope="module")
def log(spark):
    rows = [(f"id{i}", i * 1.5, i // 3, f"h{i % 5}", ["exfil", "scan", "beacon"][i % 3], 0.5 + i / 100, 0.7, "ALERT" if i % 4 else "ABSTAIN", {"hw_src_fwd_bytes": i * 1e5, "b": -0.0, "c": 5e-7}, {"k": "v"}, ["rule"]) for i in range(25)]
    return A.append(spark.createDataFrame(rows, SCHEMA), b"k", "m").cache()


def faults(df, key=b"k"):
    return [r["position"] for r in A.verify(df, key).where("not ok").orderBy("position").collect()]


def test_chain_holds_and_tampering_shows(log):
    assert faults(log) == [] and log.count() == 25
    assert faults(log.withColumn("host", F.when(F.col("seq") == 7, "evil").otherwise(F.col("host")))) == [7, 8]
    assert faults(log.where("seq <> 7").withColumn("position", F.col("seq"))) == [8]
    assert faults(log.withColumn("position", F.when(F.col("seq") == 3, 4).when(F.col("seq") == 4, 3).otherwise(F.col("seq"))))
    assert faults(log.withColumn("features", F.when(F.col("seq") == 5, F.create_map(F.lit("x"), F.lit(1.0))).otherwise(F.col("features")))) == [5]
    assert len(faults(log, b"other")) == 25


def test_numbers():
    assert [A.fixed(x) for x in (-0.0, float("nan"), float("inf"), 5e-7, 1.25)] == ["0.000000", "0.000000", "0.000000", "0.000000", "1.250000"]


@pytest.mark.parametrize("threat,src,dst,want", [("exfil", 0.0, None, (0.6, "high")), ("exfil", None, None, (1.0, "critical")), ("exfil", float("nan"), 3_340_640.0, (1.0, "critical")), ("scan", 1e9, None, (0.2, "low")), ("benign", 1.0, 1.0, (0.0, "info")), ("encrypted", None, 1685.5, (0.48, "medium")), ("other", 1.0, None, (0.0, "info"))])
def test_severity(spark, threat, src, dst, want):
    s = spark.createDataFrame([(threat, src, dst)], "t string, s double, d double").select(A.severity(F.col("t"), F.col("s"), F.col("d")).alias("x")).first()["x"]
    assert (round(s["score"], 9), s["level"]) == want


def test_queries(log, spark, tmp_path):
    assert A.health(log).first()["status"] == "ok" and A.health(log.limit(0)).first()["status"] == "no-log"
    one = A.summary(log).first()
    assert (one["entries"], one["alerts"], one["by_class"]["exfil"]) == (25, 18, 9)
    assert [r["seq"] for r in A.page(log, 3, 2).collect()] == [2, 3, 4]
    assert {r["decision"] for r in A.page(log, decision="abstain").collect()} == {"ABSTAIN"} and "features" not in A.page(log).columns
    with pytest.raises(ValueError):
        A.page(log, 0)
    assert A.by_seq(log, 99).isEmpty() and [r["seq"] for r in A.replay(log, 22)] == [22, 23, 24]
    A.write_jsonl(log, str(tmp_path / "log"))
    assert faults(A.read_jsonl(spark, str(tmp_path / "log"))) == []
