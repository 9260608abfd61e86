import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from netloom.llm.bpe import WordIds
from netloom.llm.packing import best_fit_pack, plan_classes, plan_rows, tokenizer_path


def bins_of(counts, small, groups):
    room = len(counts) - 1
    used = {}
    bins = 0
    for n, held in plan_classes(counts, small, groups):
        assert sum(x * k for x, k, _ in held) <= room and n > 0
        bins += n
        for x, k, first in held:
            used.setdefault(x, []).append((first, first + n * k))
    for x in range(room + 1):
        at = 0
        for a, b in sorted(used.get(x, [])):
            assert a == at
            at = b
        assert at == counts[x]
    return bins


def bound(counts):
    """No packing has fewer sequences: pieces over half never share one, and what is left of theirs takes only so much."""
    room, x = len(counts) - 1, np.arange(len(counts))
    best = 0
    for k in range(1, room // 2 + 1):
        n1, two, three = counts[x > room - k].sum(), (x > room // 2) & (x <= room - k), (x >= k) & (x <= room // 2)
        rest = (counts * x)[three].sum() - (counts[two].sum() * room - (counts * x)[two].sum())
        best = max(best, n1 + counts[two].sum() + max(0, -(-rest // room)))
    return int(best)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=2, max_size=65), st.integers(1, 12), st.integers(0, 30))
def test_plan_holds_every_piece_once(counts, groups, small):
    bins_of(np.array([0, *counts]), small, groups)


def test_plan_is_close_to_the_bound():
    r = np.random.default_rng(1)
    counts = np.bincount(np.clip(r.lognormal(6, 1.1, 200_000).astype(int), 1, 2048), minlength=2049)
    total = int((counts * np.arange(2049)).sum())
    assert total / 2048 <= bound(counts) <= bins_of(counts, 256, 96) <= 1.005 * bound(counts) + 100
    # a third of all pieces with one awkward length: two of them never share a sequence
    counts[1100] += 100_000
    assert bound(counts) <= bins_of(counts, 256, 96) <= 1.01 * bound(counts) + 100


def test_round_trip(spark):
    r = random.Random(3)
    t = Tokenizer.from_file(tokenizer_path())
    texts = [None, "", " ", "word", "word", "Two  WORDS\n<|endoftext|>x é", "x" * 30_000, "many short words " * 20_000] + [" ".join(r.choices(["river", "Stone's", "42", "été", "!!"], k=r.choice([1, 20, 300, 2500]))) for _ in range(150)]
    ids = [*range(len(texts) - 2), 3, None]
    df = spark.createDataFrame([(i, x, 1) for i, x in zip(ids, texts)], "doc_id long, text string, piece int").repartition(4)
    rows = best_fit_pack(df).collect()
    want = {}
    for i, x in zip(ids, texts):
        tokens = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        for p in range(0, len(tokens), 2048):
            part = tokens[p : p + 2048]
            key = (i, p // 2048, p, len(part), zlib.crc32(part.tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    sequences = {}
    for r_ in rows:
        key = (r_["doc_id"], r_["piece"], r_["start"], r_["length"], r_["ids_crc32"])
        got[key] = got.get(key, 0) + 1
        sequences.setdefault(r_["sequence_id"], []).append((r_["offset"], r_["length"]))
    assert got == want
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(plan_rows([])) == 0


def test_empty_table(spark):
    assert best_fit_pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def library_ids(words, tokenizer, held):
    found = tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
    return [w for w, x in zip(words, found) if np.array(x.ids, "<u4").tobytes() != held[w]]


def test_ids_of_odd_words():
    r = random.Random(1)
    usual = [chr(c) for c in [*range(0x21, 0x7F)] * 2 + [*range(0xC0, 0x100)]] + list("'" * 4 + "smtrevld0123ŒœßÀaaaeee") * 6 + ["ф", "́", "１", "²"]
    words = {"".join(r.choices(usual, k=r.choice([1, 2, 3, 5, 9, 14, 30, 70]))).encode() for _ in range(30_000)}
    words |= {b"a" * i for i in range(1, 70)} | {b"<|endoftext|>", b"x<|endoftext|>y", b"<|ENDOFTEXT|>", "中文".encode()}
    ids = WordIds(tokenizer_path())
    assert ids.known
    ids.learn(words)
    assert library_ids(words, ids.tokenizer, ids) == []
    ids.HELD = 1  # starts anew each time, and what is asked for is there
    ids.learn({b"one", b"two"})
    ids.learn({b"two", b"three"})
    assert set(ids) == {b"two", b"three"} and library_ids(set(ids), ids.tokenizer, ids) == []


def test_other_tokenizer_files(tmp_path):
    form = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None}
    form["model"] = {"type": "WordLevel", "vocab": {"?": 0, "One": 1, "one": 2}, "unk_token": "?"}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(form))
    ids = WordIds(str(path))
    texts = ids.words(b"One one <|endoftext|>", [0, 21])
    ids.learn(set(texts[0]))
    assert [int.from_bytes(ids[w], "little") for w in texts[0]] == [1, 2, 0]
