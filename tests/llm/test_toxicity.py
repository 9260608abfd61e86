import random
import zlib

import numpy as np
import pyarrow as pa

from netloom.llm.toxicity import Grams, _buckets_of_texts, toxicity


def tables(spark, n=600):
    r = random.Random(4)
    soft = ["river", "stone", "lantern", "quiet", "meadow", "copper", "window", "garden"]
    docs, labels = [], []
    for i in range(n):
        w = r.choices(soft, k=r.randint(3, 60))
        bad = r.random() < 0.3
        if bad:
            w[r.randrange(len(w))] = r.choice(["blorkhead", "Vexfiend"])
        docs.append((i, " ".join(w), "x"))
        if i % 2:
            labels.append((i, int(bad)))
    docs += [(n, None, "x"), (n + 1, "", "x"), (None, "blorkhead", "x"), (0, "quiet", "x"), (n + 2, "river " * 300_000, None)]
    return docs, labels + [(1, None), (None, 1), (5, 9)]


def test_held_out_accuracy(spark):
    docs, labels = tables(spark)
    d = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3)
    out = toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    texts = dict((a, b) for a, b, _ in docs[:600])
    for r in out:
        if r["doc_id"] in texts and r["doc_id"]:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            assert r["predicted"] == int(any(x in texts[r["doc_id"]] for x in ("blorkhead", "Vexfiend")))
    assert [r["predicted"] for r in out if r["doc_id"] in (600, 601)] == [0, 0]


def test_without_labels_and_documents(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity(docs, none).collect()] == [0.0, 0.0]
    assert [r["predicted"] for r in toxicity(docs, none).collect()] == [0, 0]
    assert toxicity(docs.limit(0), none).collect() == []


def test_every_toxic_word_counts(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    bad, soft = [word() for _ in range(400)], [word() for _ in range(60)]
    docs = [(i, " ".join([*r.choices(soft, k=6), bad[i // 2 % 400] if i % 2 else r.choice(soft), *r.choices(soft, k=6)])) for i in range(16000)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    out = toxicity(spark.createDataFrame(docs, "doc_id long, text string"), labels).where("held_out").collect()
    assert [r["doc_id"] for r in out if r["predicted"] != r["doc_id"] % 2] == []


def test_buckets_are_those_of_characters():
    texts = ["", "été", "Été à la\tmer", "токсичный текст", "中文字符测试", "a😀b😀c", "plain Text", "x"]
    grams = Grams((2, 3))
    got = {i: set(b.tolist()) for i, b in _buckets_of_texts(pa.array(texts), grams)}
    # each text for itself, its n-grams one by one: as many as there are, equal ones equal
    of = {}
    for i, t in enumerate(texts):
        t = "".join(c.lower() if c.isascii() else c for c in t).replace("\t", " ")
        want = set()
        for n in (2, 3):
            for k in range(len(t) - n + 1):
                one = Grams((n,))
                x, _ = one.characters(np.frombuffer(t[k : k + n].encode(), np.uint8), np.array([0, len(t[k : k + n].encode())]))
                (bucket,) = next(iter(one(x)))[1].tolist()
                assert of.setdefault(t[k : k + n], bucket) == bucket
                want.add(bucket)
        assert got[i] == want
    assert len(set(of.values())) == len(of)
