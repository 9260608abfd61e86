import random
import zlib

import numpy as np

from pyspark.sql import functions as F

from netloom.llm.quality import Model, quality
from netloom.llm.toxicity import bounded_sample, chosen_rows, held_out, training_rows


def test_sum_of_squares_identity():
    r = np.random.default_rng(1)
    m = Model(0.3, r.normal(size=20), r.normal(size=(20, 4)))
    f, x = r.permutation(20)[:7], r.normal(size=7)
    want = 0.3 + m.weights[f] @ x + sum(m.factors[f[i]] @ m.factors[f[j]] * x[i] * x[j] for i in range(7) for j in range(i))
    assert np.allclose(m.z(1, np.zeros(7, int), f, x), want)


def test_held_out_accuracy_and_odd_rows(spark):
    r = random.Random(4)
    vocab = ["river", "stone", "lantern", "quiet", "meadow", "copper", "window", "garden", "the", "of"]
    docs, labels = [], []
    for i in range(900):
        w = r.choices(vocab, k=r.randint(20, 80))
        bad = r.random() < 0.4
        t = " ".join(w).capitalize() + "."
        if bad:
            t = r.choice([t.upper() + "!!", " ".join(x for x in w for _ in range(4)), " | ".join(w) + " %%% $$$"])
        docs.append((i, t, "en", len(t)))
        if i % 3:
            labels.append((i, int(not bad), 0))
    odd = [(900, None, "x", None), (901, "", None, 0), (None, "Quiet river.", "x", 12), (3, "Quiet river.", "x", 12), (902, "a" * 3_000_000, "x", -5), (903, "\n\n", "x", 2), (904, "word " * 300_000, "x", 7)]
    d = spark.createDataFrame([(*x, 1.0) for x in docs + odd], "doc_id long, text string, lang string, n_chars long, score double").repartition(3)
    out = quality(d, spark.createDataFrame([*labels, (1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(docs) + len(odd) and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in out)
    truth = {i: q for i, q, _ in labels}
    held = [(x["score"], truth[x["doc_id"]]) for x in out if x["held_out"] and x["doc_id"] in truth and x["doc_id"] != 3]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in out if x["doc_id"] is not None)
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in held]) > 0.95


def test_without_labels_and_documents(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (2, None, None)], "doc_id long, text string, n_chars long")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(abs(x["score"] - 0.5) < 0.1 for x in quality(docs, none).collect())
    assert quality(docs.limit(0), none).collect() == []


def test_chosen_rows_are_those_of_all_training_rows(spark):
    docs = [(i, f"text {i}", i) for i in range(400)] + [(7, "again", 1), (None, "no id", 2), (9, None, 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 1)] + [(5, None), (None, 1), (6, 7), (8, 1)], "doc_id long, quality int")
    whole = training_rows(d, labels, "quality", held_out(4, 2), "n_chars")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    n = whole.count()
    assert rows(chosen_rows(d, labels, "quality", held_out(4, 2), 1000, "n_chars")) == rows(whole)
    few = chosen_rows(d, labels, "quality", held_out(4, 2), 50, "n_chars")
    assert 50 <= few.count() <= 52 < n
    # of an id that is chosen all rows come, and a fit takes the first of them again
    ids = {r["id"] for r in bounded_sample(whole, 50).collect()}
    assert {r["id"] for r in few.collect()} == ids
    assert few.join(whole.withColumnRenamed("text", "t").select("id", "t"), "id").where(F.col("text") == F.col("t")).count() >= 50
