import math

import numpy as np

from netloom.llm import embed_dedup
from netloom.llm.embed_dedup import near_embeddings, near_pairs


def brute(rows, least=0.9):
    links = [0] * len(rows)
    label = list(range(len(rows)))
    ok = [(k, np.array(v, float)) for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for x, (k, a) in enumerate(ok):
        for j, b in ok[:x]:
            if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= least:
                links[k] += 1
                links[j] += 1
                old, new = max(label[k], label[j]), min(label[k], label[j])
                label = [new if z == old else z for z in label]
    least_id = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least_id[label[k]] = min(i, least_id.get(label[k], i))
    return sorted(((i, links[k], least_id.get(label[k]), i is not None and i == least_id.get(label[k])) for k, (i, _) in enumerate(rows)), key=str)


def test_against_all_pairs(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(300, 64)).astype(np.float32)
    for _ in range(200):
        a, b = r.integers(0, 300, 2)
        v[a] = v[b] * r.uniform(0.5, 2) + r.normal(size=64) * r.uniform(0, 0.6)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(300, None), (301, [0.0] * 64), (302, [float("nan")] * 64), (303, [1.0] * 3), (304, [None] + [1.0] * 63), (305, rows[7][1]), (7, rows[7][1]), (None, rows[7][1]), (306, []), (307, [float("inf")] + [0.0] * 63)]
    # other lengths: copies, near ones, and vectors that are the start of longer ones
    rows += [(400 + i, x[: 3 + i % 5].tolist()) for i, x in enumerate(v[:60])] + [(500 + i, (x[:7] * 2).tolist()) for i, x in enumerate(v[:20])] + [(401, v[1][:4].tolist())]
    df = spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<float>, component_id string").repartition(3)
    assert sorted((tuple(x) for x in near_embeddings(df).collect()), key=str) == brute(rows)


def test_blocks_of_a_hot_cluster(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 1500)
    r = np.random.default_rng(2)
    v = np.vstack([np.ones((3000, 64)) + r.normal(size=(3000, 64)) * 0.2, r.normal(size=(1600, 64))])
    n = np.linalg.norm(v, axis=1)
    near = (v @ v.T) / np.outer(n, n) >= 0.9
    short = r.normal(size=(2000, 2))  # a second length of more than a block
    m = np.linalg.norm(short, axis=1)
    more = ((short @ short.T) / np.outer(m, m) >= 0.9).sum(axis=1) - 1
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate([*v, *short])], "vec_id long, embedding array<double>")
    got = {x["vec_id"]: x["n_links"] for x in near_embeddings(df).collect()}
    assert [got[i] for i in range(len(v))] == (near.sum(axis=1) - 1).tolist()
    assert [got[len(v) + i] for i in range(len(short))] == more.tolist()


def test_short_vectors_and_no_rows(spark):
    a = np.array([[1.0, 0, 0], [1, 0.1, 0], [0, 1, 0]])
    assert [(x.tolist(), y.tolist()) for x, y in near_pairs(a, a, np.eye(3), 0.9, True)] == [([0], [1])]
    assert near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert [tuple(x) for x in near_embeddings(spark.createDataFrame([(3, None)], "vec_id long, embedding array<float>")).collect()] == [(3, 0, 3, True)]
