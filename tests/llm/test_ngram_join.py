import random
import re

import numpy as np
import pyarrow as pa

from netloom.llm import ngram_join
from netloom.llm.ngram_join import ngram_jaccard, signatures, band_starts, minima_keys, orders
from netloom.llm.text import Words, batch_texts, graph_bytes, mix


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def check(spark, rows, k=4, percent=85):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in ngram_jaccard(df, k, percent).collect()), key=str)
    assert got == brute(rows, k, percent)


def test_against_all_pairs(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = r.choices(vocab, k=r.choice([3, 5, 12, 40, 90, 300]))
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((n, r.choice([" ", "\n", "\t "]).join(w)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One TWO"), (n + 4, "one two"), (n + 5, "é É"), (n + 6, "É é"), (None, "one two"), (7, rows[7][1]), (7, "other text than before is here"), (n + 7, "x" * 3_000_000), (n + 8, "ab " * 400_000)]
    check(spark, rows)
    check(spark, rows, 5, 80)


def test_common_passages(spark):
    r = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for i in range(300):
        own = " ".join(f"o{i}x{j}" for j in range(r.choice([0, 2, 5, 30, 60])))
        rows.append((i, f"{passage} {own}" if i % 3 else own))
    check(spark, rows)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, component_id string, node int")
    assert ngram_jaccard(df).collect() == []
    df = spark.createDataFrame([(1, "a b c d e f", "x", 5), (2, "a b c d e f", None, None)], "doc_id long, text string, component_id string, node int")
    assert [tuple(x) for x in ngram_jaccard(df).orderBy("doc_id").collect()] == [(1, 2, 1), (2, 2, 1)]


def test_signatures_lose_no_pair():
    r = np.random.default_rng(3)
    starts = band_starts(1 << 20, 85)
    for _ in range(400):
        n = int(r.integers(1, 300))
        a = np.unique(mix(r.integers(0, 1 << 60, n).astype(np.uint64)))
        drop = r.integers(0, 1 + int(0.085 * len(a)))
        add = r.integers(0, 1 + int(0.085 * len(a)))
        b = np.unique(np.concatenate([r.permutation(a)[drop:], mix(r.integers(0, 1 << 60, add).astype(np.uint64))]))
        inter = len(np.intersect1d(a, b))
        if 100 * inter >= 85 * (len(a) + len(b) - inter):
            for mask in (0, 1, 3, 7):  # none, half, three and seven of eight shingles are common
                x, y = (signatures(s, (s & np.uint64(mask)) == 0, starts, 85) for s in (a, b))
                assert np.intersect1d(x, y).size


def test_large_families_are_dealt_by_size(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_SETS", 7)
    r = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    # a chain of sets that grow: neighbours link, far ones don't; and many of one size
    rows = [(i, " ".join(base[: 40 + 2 * i])) for i in range(60)]
    rows += [(100 + i, " ".join([*base[:80], f"own{i}", *base[81:120]])) for i in range(40)]
    rows += [(200 + i, " ".join(r.choices(base, k=60))) for i in range(10)]
    check(spark, rows)
    members = spark.createDataFrame([(i, 40 + i % 90, i % 3) for i in range(300)], "node long, n long, family long")
    out = ngram_join.tiled(members, 85).collect()
    tiles = {}
    for x in out:
        tiles.setdefault((x["family"], x["tile"]), set()).add((x["node"], x["n"]))
    met = {(a, b) for t in tiles.values() for a, _ in t for b, _ in t}
    want = {(i, j) for i in range(300) for j in range(300) if i % 3 == j % 3 and 100 * min(40 + i % 90, 40 + j % 90) >= 85 * max(40 + i % 90, 40 + j % 90)}
    assert want <= met and len(out) < 0.7 * sum(100 // 7 + 1 for _ in range(300)) and max(map(len, tiles.values())) <= 40


def test_packed_buckets():
    r = np.random.default_rng(9)
    for n, top in ((1, 1 << 60), (2, 1), (1000, 1 << 63), (1000, 3), (70_000, 1 << 40)):
        keys = np.sort(r.integers(0, top, n).astype(np.uint64) + np.uint64(r.integers(0, 1 << 62)))
        nodes = r.integers(-(1 << 62), 1 << 62, n) if n > 5 else np.arange(n)
        a, b = ngram_join.unpack_bucket(*ngram_join.pack_bucket(keys, nodes))
        assert (a == keys).all() and (b == nodes).all()


def test_linked_sets_share_minima_and_strangers_do_not():
    r = np.random.default_rng(7)
    for percent in (80, 85):
        factors = orders(percent)
        for n in (1, 3, 4, 9, 40, 400, 5000):
            whole = np.unique(mix(r.integers(1, 1 << 62, 2 * n + 9).astype(np.uint64)))
            for _ in range(20 if n < 1000 else 2):
                differ = 2 * n * (100 - percent) // (100 + percent) // 2  # one swapped shingle differs on both sides
                r.shuffle(whole)
                a, b, c = whole[:n], np.append(whole[differ:n], whole[n : n + differ]), np.append(whole[n : 2 * n], whole[:1])
                assert 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))
                x, y, z = (minima_keys(np.sort(s), factors, percent) for s in (a, b, c))
                assert not len(x) if 100 * n < percent * (n + 1) else len(np.intersect1d(x, y))
                assert n < 40 or not len(np.intersect1d(x, z))


def test_strangers_in_a_large_family_part(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_SETS", 8)
    r = random.Random(8)
    words = [[f"v{r.randrange(300)}" for _ in range(60)] for _ in range(20)]
    texts = [" ".join(w) for w in words] + [" ".join([*w[:-1], "other"]) for w in words[:10]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    digests = {}
    for i, t in enumerate(texts):
        for _, raw, offsets in batch_texts(pa.array([t])):
            (own,) = ngram_join.shingle_sets(*Words(graph_bytes())(raw, offsets), 4)
            digests[i] = ngram_join.digest_of(own)
    near = spark.createDataFrame([(digests[i], 57, 1) for i in range(len(texts))] + [(2, 57, 2), (3, 57, 2)], "node long, n long, family long")
    got = {x["node"]: x["family"] for x in ngram_join.regrouped(near, docs, 4, 85).collect()}
    assert got.pop(2) == got.pop(3) == 2
    assert set(got) == {digests[i] for i in (*range(10), *range(20, 30))}
    assert all(got[digests[i]] == got[digests[20 + i]] for i in range(10)) and len(set(got.values())) == 10


def test_chance_ties_leave_links_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_SETS", 4)
    r = random.Random(9)
    vocab = [f"c{i}" for i in range(7)]
    rows = []
    for i in range(60):
        w = r.choices(vocab, k=r.choice([30, 60, 120]))
        rows.append((2 * i, " ".join(w)))
        w[r.randrange(len(w))] = "other"
        rows.append((2 * i + 1, " ".join(w)))
    check(spark, rows, 5, 80)
