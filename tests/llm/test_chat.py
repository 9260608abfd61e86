import hashlib

from netloom.llm.chat import chat_digests, chat_format

SCHEMA = "tree_id long, node_id long, parent_id long, role string, text string, score double, conversation string"


def want(turns):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), h("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), h(loss)


def test_digests_read_back(spark):
    odd = ["", "a\\", "\\|", "<|im_end|>\n<|im_start|>assistant ok", "<\\|x", "<|nl|>", "é\U0001f600 $1 \\$1", "\n\n", "<" * 3 + "|" * 3, "x" * 200_000]
    rows = [(1, i, "assistant" if i % 2 else "us\ner", t) for i, t in enumerate(odd)] + [(2, 0, "user", None), (2, 1, None, "x"), (3, 5, "user", "b"), (3, 5, "user", "b"), (3, 5, "assistant", "b"), (None, 1, "user", "q"), (4, None, "user", "n"), (4, 0, "assistant", "m")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, tree_id int").repartition(3)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat_digests(df).collect()}
    clean = lambda k: [(r or "", t or "") for c, n, r, t in sorted(rows, key=lambda x: (str(x[0]), -1 if x[1] is None else x[1], x[2] or "", x[3] or "")) if c == k]
    assert got == {k: want(clean(k)) for k in (1, 2, 3, 4, None)}
    assert chat_digests(df.limit(0)).collect() == []


def test_trees(spark):
    rows = [(1, 0, None, "user", "root", 0.5), (1, 1, 0, "assistant", "left", 0.1), (1, 2, 0, "assistant", "right", 0.9), (1, 3, 1, "user", "leaf a", 1.0), (1, 4, 2, "user", "leaf b", None), (1, 5, 2, "user", "leaf c", 0.2), (1, 8, 77, "user", "lost", 9.0), (1, 9, 10, "user", "circle", 9.0), (1, 10, 9, "user", "circle", 9.0)]
    rows += [(2, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(11)]
    df = spark.createDataFrame([(*r, "old") for r in rows], SCHEMA)
    out = {(r["tree_id"], r["rank"]): r["conversation"] for r in chat_format(df, top=2).collect()}
    turn = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    a = turn("user", "root") + turn("assistant", "right") + turn("user", "leaf c")
    b = turn("user", "root") + turn("assistant", "left") + turn("user", "leaf a")
    # means: root left leaf-a 1.6/3, root right leaf-c 1.6/3, root right leaf-b 1.4/3; ties by path
    assert out[1, 1] == b and out[1, 2] == a
    assert out[2, 1] == "".join(turn("user", str(i)) for i in range(11)) and (2, 2) not in out


def test_deep_and_forked_trees(spark):
    import random

    r = random.Random(5)
    trees = {1: [None] + list(range(400)), 2: [None], 3: [None], None: [None, 0, 1, 1]}
    trees[2] += [max(0, i - 1 - r.randrange(2)) for i in range(1, 300)]  # forks all the way down
    trees[3] += [r.randrange(i) for i in range(1, 200)]
    rows = [(t, i, p, "user" if i % 2 else "assistant", f"{t}.{i}", r.choice([0.0, 0.25, 0.5, 1.0])) for t, parents in trees.items() for i, p in enumerate(parents)]
    # circles with and without forks, longer than some trees, and what hangs below them
    rows += [(1, 1000 + i, 1000 + (i + 1) % 37, "user", "circle", 9.0) for i in range(37)] + [(1, 2000 + i, 1000, "user", "below", 9.0) for i in range(5)] + [(3, 900, 901, "user", "lost", 9.0), (3, 902, 900, "user", "lost", 9.0)]
    df = spark.createDataFrame([(*x, "old") for x in rows], SCHEMA).repartition(4)
    tracker, group = spark.sparkContext.statusTracker(), "chat-deep"
    spark.sparkContext.setJobGroup(group, group)
    got = {(x["tree_id"], x["rank"]): x["conversation"] for x in chat_format(df.where("tree_id = 1 and node_id < 400"), unique=True).collect()}
    assert len(tracker.getJobIdsForGroup(group)) <= 50
    spark.sparkContext.setJobGroup("rest", "rest")
    text = lambda path, t: "".join(f"<|im_start|>{'user' if i % 2 else 'assistant'}\n{t}.{i}<|im_end|>\n" for i in path)
    assert got == {(1, 1): text(range(400), 1)}
    want = {}
    for t, parents in trees.items():
        score = {x[1]: x[5] for x in rows if x[0] == t}
        paths = []
        for leaf in set(range(len(parents))) - set(parents):
            path = [leaf]
            while parents[path[-1]] is not None:
                path.append(parents[path[-1]])
            paths.append((-sum(score[i] for i in path) / len(path), leaf, path[::-1]))
        for rank, (_, _, path) in enumerate(sorted(paths)[:3], 1):
            want[t, rank] = text(path, t)
    assert {(x["tree_id"], x["rank"]): x["conversation"] for x in chat_format(df, top=3).collect()} == want
    assert chat_format(df.limit(0)).collect() == []
