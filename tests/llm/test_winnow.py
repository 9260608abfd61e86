import random
import re

from netloom.llm.winnow import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=13):
    out = []
    for d, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for i, it in items:
            v = words(it)
            n = min(window, len(v))
            if not n:
                continue
            wins = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in wins:
                    hit.update(range(j, j + n))
                    if i is not None:
                        ids.add(i)
        out.append((d, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(spark, docs, items):
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string, doc_id int"))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], sorted(r["item_ids"]), r["contaminated"]) for r in got.collect()]
    assert sorted(got, key=str) == brute(docs, [(a, b) for a, b, _ in items])


def test_against_all_windows(spark):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(60)] + ["É", "ß9", "x"]
    text = lambda n: "".join(r.choice(vocab) + r.choice([" ", "-", "\n", ". "]) for _ in range(n))
    items = [(i, text(r.choice([1, 3, 8, 12, 13, 14, 30, 60])).upper(), 1) for i in range(25)] + [(3, text(20), 1), (None, text(15), 1), (90, None, 1), (91, " ,;", 1), (92, "a a a a a a a a a a a a a a a a", 2)]
    docs = []
    for n in range(120):
        t = text(r.choice([0, 2, 12, 13, 40, 200]))
        if r.random() < 0.6:
            w = words(r.choice(items)[1])
            a = r.randint(0, max(0, len(w) - 5))
            t += " ".join(w[a : a + r.choice([4, 12, 13, 20, 99])]) + " " + text(r.choice([0, 30]))
        docs.append((n, t))
    docs += [(200, None), (201, ""), (202, "a " * 60), (None, docs[3][1]), (3, docs[5][1]), (203, "b" * 2_500_000), (204, text(90_000) + items[6][1])]
    check(spark, docs, items)


def test_empty_tables(spark):
    check(spark, [], [(1, "a b", 1)])
    check(spark, [(1, "a b"), (2, None)], [])
