"""Benchmark decontamination by winnowing.

An item's windows are its spans of `window` words; an item with fewer words, but not none,
is one window. Texts are fingerprinted by winnowing: of the hashes of all grams of `gram`
words, the smallest of each `window - gram + 1` in a row stays (the rightmost of equal ones).
Any span of `window` words that two texts share holds such a run, so both keep the same gram
at the same place of it: no shared window is lost. Items shorter than a window are
fingerprinted by all their words at once, one length at a time, and so are documents for the
lengths that such items have.

A pass over the documents keeps their fingerprints that pass a bitmap of the benchmark's
(a fixed number of bits, so its broadcast is bounded; false positives only cost time), each
with the words around it. They are joined with the benchmark's on the fingerprint, and each
hit is extended to both sides over equal words; a run of a whole window marks its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.groups import runs
from netloom.llm.store import cut, map_batches, prepare
from netloom.llm.text import Words, alnum_bytes, batch_texts, grams, mix

#: Bits of the bitmap that fingerprints of documents must pass, as a power of two: 4 MB.
BITMAP = 25


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """The places of the minima of all runs of `width` hashes, the rightmost of equal ones."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width):
        less = hashes[j : j + n] <= low
        low[less] = hashes[j : j + n][less]
        at[less] = j
    return np.unique(at + np.arange(n))


def _prints(words: np.ndarray, window: int, gram: int, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, words that must match) of a text's fingerprints for whole windows and for
    items of each of the shorter lengths."""
    full = grams(words, gram)
    at = winnow(full, window - gram + 1)
    out = [(full[at], at, np.full(len(at), window))]
    for n in lengths:
        if n < window and len(words) >= n:
            short = mix(grams(words, n) ^ np.uint64(n))
            out.append((short, np.arange(len(short)), np.full(len(short), n)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _around(words: np.ndarray, at: int, window: int, need: int) -> bytes:
    """The words from `window` before to `window` behind a place; beyond the text, nothing
    matches: the sides are cut there and the first number tells how many stand before."""
    before = min(at, window)
    return np.concatenate([[np.uint64(before)], words[at - before : at + window + need]]).astype(np.uint64).tobytes()


def _items(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    hashed = Words(alnum_bytes())
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, raw, offsets in batch_texts(batch.column(1)):
            words, firsts = hashed(raw, offsets)
            rows: list[tuple] = []
            for i, (a, b) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True), first):
                own = words[a:b]
                if len(own):
                    h, at, need = _prints(own, window, gram, [len(own)] if len(own) < window else [])
                    rows += [(x, ids[i], int(n), _around(own, p, window, int(n))) for x, p, n in zip(h.view(np.int64).tolist(), at.tolist(), need.tolist(), strict=True) if len(own) < window or n == window]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))], ["print", "item_id", "need", "item_words"])


def _hits(batches: Iterator[pa.RecordBatch], window: int, gram: int, lengths: list[int], bitmap) -> Iterator[pa.RecordBatch]:
    hashed = Words(alnum_bytes())
    bits = np.frombuffer(bitmap.value, np.uint8)
    for batch in batches:
        for first, raw, offsets in batch_texts(batch.column(1)):
            words, firsts = hashed(raw, offsets)
            found: list[list] = []
            if len(words):
                h, at, need = _prints_of_run(words, firsts, window, gram, lengths)
                key = h >> np.uint64(64 - BITMAP)
                ok = (bits[(key >> np.uint64(3)).astype(np.int64)] >> (key & np.uint64(7)).astype(np.uint8)) & 1 == 1
                h, at, need = h[ok], at[ok], need[ok]
                doc = np.searchsorted(firsts, at, "right") - 1
                order = np.argsort(doc, kind="stable")
                h, at, need, doc = h[order], at[order], need[order], doc[order]
                ends = np.searchsorted(doc, np.arange(len(firsts)))
            for i in range(len(firsts) - 1):
                a, b = int(firsts[i]), int(firsts[i + 1])
                own = words[a:b]
                found.append([{"print": int(x), "place": int(p) - a, "need": int(n), "words": _around(own, int(p) - a, window, int(n))} for x, p, n in zip(h[ends[i] : ends[i + 1]].view(np.int64), at[ends[i] : ends[i + 1]], need[ends[i] : ends[i + 1]], strict=True)] if b > a else [])
            n = len(firsts) - 1
            kind = pa.list_(pa.struct([("print", pa.int64()), ("place", pa.int64()), ("need", pa.int32()), ("words", pa.binary())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.diff(firsts).astype(np.int64)), pa.array(found, kind)], ["doc_id", "n_words", "found"])


def _prints_of_run(words: np.ndarray, firsts: np.ndarray, window: int, gram: int, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The fingerprints of all texts of a run at once. A run of grams that crosses texts can
    only add fingerprints; those that don't end in their text are dropped."""
    ends = np.repeat(firsts[1:], np.diff(firsts))

    def inside(at: np.ndarray, n: int) -> np.ndarray:
        return at + n <= ends[at]

    width = window - gram + 1
    full = grams(words, gram)
    n = len(full) - width + 1
    if n > 0:
        low, at = full[:n].copy(), np.zeros(n, np.int8)
        for j in range(1, width):
            less = full[j : j + n] <= low
            np.copyto(low, full[j : j + n], where=less)
            at[less] = j
        starts = np.flatnonzero(inside(np.arange(n), window))
        places = starts + at[starts]
        places = places[np.concatenate([[True], places[1:] != places[:-1]])] if len(places) else places
    else:
        places = np.zeros(0, np.int64)
    out = [(full[places], places, np.full(len(places), window))]
    for k in lengths:
        if k < window:
            short = mix(grams(words, k) ^ np.uint64(k))
            at = np.flatnonzero(inside(np.arange(len(short)), k))
            out.append((short[at], at, np.full(len(at), k)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 128-byte blocks of the bitmap that a task's fingerprints touch."""
    bits = np.zeros(1 << (BITMAP - 3), np.uint8)
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - BITMAP)
        np.bitwise_or.at(bits, (key >> np.uint64(3)).astype(np.int64), np.uint8(1) << (key & np.uint64(7)).astype(np.uint8))
    blocks = bits.reshape(-1, 128)
    touched = np.flatnonzero(blocks.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(touched, pa.int64()), pa.array([blocks[i].tobytes() for i in touched], pa.binary())], ["block", "bits"])


def _or_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks, bits = [], []
    for t in runs(batches, ["block"]):
        blocks.append(t["block"][0].as_py())
        bits.append(np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t["bits"].to_pylist()]).tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(bits, pa.binary())], ["block", "bits"])


def _extend(batches: Iterator[pa.RecordBatch], gram: int, window: int) -> Iterator[pa.RecordBatch]:
    """Each hit's run of equal words, as [start, end) of the document's words, if it holds
    what must match."""
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        keep, start, end = [], [], []
        for i, (x, y, place, need) in enumerate(zip(cols["words"].to_pylist(), cols["item_words"].to_pylist(), cols["place"].to_pylist(), cols["need"].to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            a, b, x, y = int(x[0]), int(y[0]), x[1:], y[1:]
            left = right = 0
            while left < min(a, b) and x[a - left - 1] == y[b - left - 1]:
                left += 1
            while right < min(len(x) - a, len(y) - b) and x[a + right] == y[b + right]:
                right += 1
            if right >= (gram if need == window else need) and left + right >= need:
                keep.append(i)
                start.append(place - left)
                end.append(place + right)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([cols["row"].take(at), cols["item_id"].take(at), pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["row", "item_id", "start", "end"])


def _covered(spans: Column) -> Column:
    """How many words sorted spans cover."""
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], s["to"]))).alias("n"), F.greatest(s["to"], x["end"]).alias("to")),
    )
    return step["n"]


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, gram: int = 5, percent: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, item_ids, spans, contaminated), a row for each row of `docs`.

    A word of a document is hit if it lies in an occurrence of a window of an item; `spans`
    are the hit runs as [start, end) of its words, n_items counts distinct items that hit, and
    a document is contaminated if it has hits and 100 * n_hit >= percent * n_words. Null and
    empty texts have no words, long ones are searched whole, and an item without words no windows. Repeated ids are judged
    row by row; of items with a null id the words count as hits, and the id in no list. With
    an empty benchmark nothing is hit; with no documents there are no rows. Other columns
    are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    prints = cut(items.transform(map_batches, partial(_items, window=window, gram=gram), "print long, item_id long, need int, item_words binary").distinct(), "prints")
    lengths = sorted(r[0] for r in prints.select("need").distinct().collect())  # at most `window` numbers
    blocks = prints.select("print").distinct().transform(map_batches, _bitmap, "block long, bits binary")
    blocks = blocks.repartition("block").sortWithinPartitions("block").transform(map_batches, _or_blocks, "block long, bits binary")
    bits = np.zeros((1 << (BITMAP - 10), 128), np.uint8)  # all blocks together are the bitmap's fixed size
    for block, x in blocks.collect():
        bits[block] = np.frombuffer(x, np.uint8)
    bitmap = spark.sparkContext.broadcast(bits.tobytes())

    found = docs.transform(map_batches, partial(_hits, window=window, gram=gram, lengths=lengths, bitmap=bitmap), "doc_id long, n_words long, found array<struct<print: long, place: long, need: int, words: binary>>")
    # monotonically_increasing_id names rows, whose ids may repeat; the cut fixes it
    found = cut(found.withColumn("row", F.monotonically_increasing_id()), "found")
    hits = found.where("size(found) > 0").select("row", F.explode("found").alias("f")).select("row", "f.*")
    spans = hits.join(prints, ["print", "need"]).transform(map_batches, partial(_extend, gram=gram, window=window), "row long, item_id long, start long, end long")
    spans = spans.groupBy("row", "start", "end").agg(F.collect_set("item_id").alias("ids"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    out = found.select("row", "doc_id", "n_words").join(spans, "row", "left")
    none = F.array().cast("array<struct<start: long, end: long>>")
    out = out.withColumn("spans", F.coalesce("spans", none)).withColumn("n_hit", F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long"))
    item_ids = F.coalesce(F.col("ids"), F.array().cast("array<long>"))
    return out.select("doc_id", "n_words", "n_hit", F.size(item_ids).cast("long").alias("n_items"), item_ids.alias("item_ids"), "spans", ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"))
