import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from netloom.llm.kneser_ney import discounts, kneser_ney_scores


def toks(t):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(train, texts):
    c = Counter(p for t in train for p in zip(["<s>", *toks(t)], toks(t)))
    uni = Counter(w for t in train for w in toks(t))
    n, v = sum(uni.values()), len(uni)
    before = Counter(w for _, w in c)
    ctx = Counter()
    kinds = Counter()
    for (a, _), k in c.items():
        ctx[a] += k
        kinds[a, min(k, 3)] += 1
    d = discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])
    e = discounts([sum(x == k for x in before.values()) for k in (1, 2, 3, 4)])
    cut = lambda x, dd: max(x - (0, *dd)[min(x, 3)], 0)
    mass = sum(e[min(x, 3) - 1] for x in before.values())

    def low(w):
        return (cut(before[w], e) + mass / (v + 1)) / len(c) if c else 1 / (v + 1)

    def p(w, a):
        if not ctx[a]:
            return low(w)
        return (cut(c[a, w], d) + sum(d[k - 1] * kinds[a, k] for k in (1, 2, 3)) * low(w)) / ctx[a]

    if c:
        for a in ["<s>", "b", "never seen"]:
            assert sum(p(w, a) for w in [*uni, "unknown word"]) == pytest.approx(1)
    out = []
    for t in texts:
        s = toks(t)
        out.append((len(s), sum(uni[w] > 0 for w in s), n, sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in s), sum(math.log10(p(w, a)) for a, w in zip(["<s>", *s], s))))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    fold = F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False))
    want = {}
    for (i, t), x in zip(rows, brute([t for i, t in rows if i is None or i % 4], [t for _, t in rows])):
        want.setdefault((i, x[0], x[1]), []).append(x)
    got = kneser_ney_scores(df, fold).collect()
    assert len(got) == len(rows)
    for r in got:
        x = want[r["doc_id"], r["n_tokens"], r["n_known"]]
        assert any(r["train_tokens"] == y[2] and r["base_score"] == pytest.approx(y[3], rel=1e-9) and r["score"] == pytest.approx(y[4], rel=1e-9) for y in x)


def test_against_brute_force(spark):
    r = random.Random(8)
    vocab = [chr(97 + i) for i in range(20)]
    text = lambda n: " ".join(r.choices(vocab, weights=[1 / (i + 1) for i in range(20)], k=n))
    rows = [(i, text(r.choice([1, 5, 40, 300]))) for i in range(60)] + [(61, None), (62, ""), (64, None), (65, "É Zz\tb"), (68, "new words b"), (None, "a b"), (5, "b c"), (69, "x" * 1_500_000 + " b"), (70, "a b " * 100_000)]
    check(spark, rows)


def test_without_training_rows_or_rows(spark):
    check(spark, [(4, "a b"), (8, None)])
    assert kneser_ney_scores(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).collect() == []
