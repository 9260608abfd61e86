import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from netloom.llm.packing import tokenizer_path
from netloom.llm.pii import Feistel, rewrite
from tests.llm.test_ngram_join import brute as near
from tests.llm.test_winnow import brute as windows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    base = [f"the river {i} runs past stone {i % 7} and garden {i % 5} while lanterns number {i * 3} glow over copper roofs in quiet street {i}" for i in range(60)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)]
    docs += [(60 + i, base[i], "en", "s", 1) for i in range(5)]
    docs += [(70 + i, base[10 + i] + " blorkhead", "en", "s", 1) for i in range(12)]
    docs += [(90, "intro words here " + " ".join(f"bench{j}" for j in range(20)), "en", "s", 1), (91, "card 4111 1111 1111 1111 of anna", "en", "s", 1), (92, None, "en", "s", 0), (93, "", None, None, 0), (None, "no id here", "en", "s", 1), (94, "same row", "x", "y", 8), (94, "same row", "x", "y", 8), (94, "same id other text", "x", "y", 8)]
    labels = [(i, 1, 0) for i in range(60)] + [(70 + i, 1, 1) for i in range(12)]
    spark.createDataFrame(docs, SCHEMA).coalesce(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{j}" for j in range(20)))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs


def test_stages_against_brute_force(spark, folder):
    d, docs = folder
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    now = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(cp.STAGES)
    first = cp.cut(stages["toxicity"](spark, now, d), "t")
    assert rows(first) == sorted((x for x in docs if not x[1] or "blorkhead" not in x[1]), key=str)

    second = cp.cut(stages["ngram_jaccard_join"](spark, first, d), "t")
    before = sorted(set(rows(first)), key=lambda x: (x[0] is None, x[0] or 0, str(x)))
    groups = {k: c for k, _, c in near([(i, x[1]) for i, x in enumerate(before)], 5, 80)}
    assert rows(second) == sorted((x for i, x in enumerate(before) if groups[i] == i), key=str)

    third = cp.cut(stages["benchmark_decontamination"](spark, second, d), "t")
    bad = {r[0] for r in windows([(x[0], x[1]) for x in rows(second)], [(1, " ".join(f"bench{j}" for j in range(20)))]) if r[4]}
    assert bad == {90} and rows(third) == [x for x in rows(second) if x[0] not in bad]

    fourth = cp.cut(stages["pii_pseudonyms"](spark, third, d), "t")
    f = Feistel(cp.PII_KEY).permute
    change = lambda t: None if t is None else rewrite(t, f)[0]
    assert rows(fourth) == sorted(((i, change(t), a, b, None if t is None else len(change(t))) for i, t, a, b, _ in rows(third)), key=str)
    assert fourth.columns == cp.COLUMNS

    fifth = rows(stages["best_fit_packing"](spark, fourth, d).select("doc_id", "piece", "length", "ids_crc32"))
    t = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, text, *_ in rows(fourth):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, 0, len(ids), zlib.crc32(ids.tobytes())))
    assert fifth == sorted(want, key=str)
    assert rows(cp.run(spark, d).select("doc_id", "piece", "length", "ids_crc32")) == fifth


def test_odd_tables(spark, tmp_path):
    d = str(tmp_path)
    docs = spark.createDataFrame([(1, "quiet river runs past the old stone bridge", "en", "s", 4, "extra", 7), (2, None, "en", None, None, None, None), (3, "", None, "s", 0, "x", 1)], SCHEMA + ", doc_ID2 string, row int")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        kept = cp.cut(stage(spark, kept, d), name)
        assert kept.columns == cp.COLUMNS and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3], name
    assert sorted(r["doc_id"] for r in cp.run(spark, d).collect()) == [1, 2, 3]  # nothing is dropped without labels
    none = f"{d}/none"
    docs.limit(0).write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{none}/benchmark.parquet")
    assert cp.run(spark, none).collect() == []
