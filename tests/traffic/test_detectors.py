import random

import pytest
from pyspark.sql import functions as F

from netloom.operators import detectors as D
from netloom.schema import THREATS

FEATURES = sorted({f for fs in D.HEADS.values() for f in fs})


@pytest.fixture(scope="module")
def cells(spark):
    r = random.Random(4)
    rows = [[r.random() for _ in FEATURES] for _ in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURES))
    # labels that can hold together
    return df.withColumns({f"y_{t}": F.col(D.HEADS[t][0]) > 0.75 for t in THREATS}).cache()


def test_ensemble(cells):
    heads = [D.Head(t, trees=3, depth=3) for t in ("ddos", "scan", "exfil")]
    e = D.Ensemble(heads).fit(cells, {t: f"y_{t}" for t in THREATS})
    out = e.score(cells).withColumn("fired", e.fired())
    for h in heads:
        right = out.select(F.avg(((F.col(f"p_{h.threat}") >= 0.5) == F.col(f"y_{h.threat}")).cast("double"))).first()[0]
        assert right > 0.95 and h.top_features(1)[0][0] == D.HEADS[h.threat][0] and h.threat in h.explain()
    several = [r for r in out.collect() if len(r["fired"]) > 1]
    assert several
    for r in several:
        p = [r[f"p_{t}"] for t in r["fired"]]
        assert p == sorted(p, reverse=True)


def test_missing_labels_and_features(cells):
    with pytest.raises(KeyError):
        D.Ensemble([D.Head("scan")]).fit(cells, {})
    with pytest.raises(ValueError):
        D.Head("ddos", only=["hw_src_n_peers"]).fit(cells, "y_ddos")
