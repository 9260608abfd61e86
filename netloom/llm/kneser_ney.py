"""Interpolated modified Kneser-Ney language model over word pairs, for scoring texts.

Tokens are words and one end per text; a text's first token follows a begin mark. With
c(vw) the count of a pair, c(v) of its first word as context, N1+(.w) the number of different
words before w, and discounts D1, D2, D3+ from counts of counts (Chen and Goodman):

  p(w | v) = (max(c(vw) - D(c(vw)), 0) + (D1 n1(v) + D2 n2(v) + D3+ n3+(v)) p(w)) / c(v)
  p(w)     = (max(N1+(.w) - D'(N1+(.w)), 0) + (mass that D' took) / (V + 1)) / N1+(..)

where an unknown word has the share 1 / (V + 1) alone, so both sum to 1 over V words and it.

Counting: workers count the pairs of some megabytes of text at a time, Spark sums them,
dealt by shards of the first word and sorted within. A shard becomes a file of sorted hash
arrays in the shared folder. Scoring maps these files into memory and looks up each different
pair of some megabytes of text once, by binary search. Nothing of the model goes through the
driver but the list of files and a few sums. Hashes have 64 bits.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.store import cut, forget, map_batches, new_path, prepare, release
from netloom.llm.text import Words, batch_texts, graph_bytes, mix

BEGIN, STOP = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_K = np.uint64(0xD6E8FEB86659FD93)
#: Pairs that a worker gathers before it counts them, and bytes of text that it scores at once.
HELD, TEXT_BYTES = 1 << 22, 1 << 23


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(v * _K + w)


def tokens(words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, tokens, the number of each text's first token) of a run of texts."""
    n = len(firsts) - 1
    at = firsts[:-1] + np.arange(n)  # of each text's first token
    total = len(words) + n
    w = np.empty(total, np.uint64)
    ends = firsts[1:] + np.arange(n)
    inner = np.ones(total, bool)
    inner[ends] = False
    w[inner], w[ends] = words, STOP
    v = np.empty(total, np.uint64)
    v[1:] = w[:-1]
    v[at] = BEGIN
    return v, w, np.append(at, total)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashed = Words(graph_bytes())
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def out():
        v, w = (np.concatenate(x) for x in zip(*held, strict=True))
        _, at, c = np.unique(pair_key(v, w), return_index=True, return_counts=True)
        # in order of the first word, which then costs next to nothing in the shuffle's files
        order = np.argsort(v[at], kind="stable")
        v, w, c = v[at][order], w[at][order], c[order]
        for i in range(0, len(v), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(v[s].view(np.int64)), pa.array(w[s].view(np.int64)), pa.array(c[s].astype(np.int32))], ["v", "w", "c"])

    for batch in batches:
        for _, raw, offsets in batch_texts(batch.column(0)):
            v, w, _ = tokens(*hashed(raw, offsets))
            held.append((v, w))
            n += len(w)
            if n >= HELD:
                yield from out()
                held, n = [], 0
    if held:
        yield from out()


def _write(folder: str, arrays: list[np.ndarray]) -> str:
    """A new file below `folder`; a task that runs twice writes two, and one is listed."""
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    name = uuid.uuid4().hex
    with fs.open_output_stream(f"{path}/{name}") as f:
        for a in arrays:
            f.write(a.tobytes())
    return f"{folder}/{name}"


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(shard, its columns) of rows sorted by shard and the column after it, in pieces of some
    million rows that end where that column changes."""
    held: list[list[np.ndarray]] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held.append(cols)
        n += batch.num_rows
        if n >= HELD and (held[0][0][0] != cols[0][-1] or held[0][1][0] != cols[1][-1]):
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            keep = int(np.flatnonzero((whole[1] != whole[1][-1]) | (whole[0] != whole[0][-1]))[-1]) + 1
            yield from _split([c[:keep] for c in whole])
            held = [[c[keep:] for c in whole]]
            n = len(held[0][0])
    if held:
        yield from _split([np.concatenate(x) for x in zip(*held, strict=True)])


def _split(cols: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    cuts = [0, *(np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1).tolist(), len(cols[0])]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(cols[0][a]), [c[a:b] for c in cols[1:]]


def _sharded(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shard = (batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(shard), *batch.columns], ["shard", *batch.schema.names])


def _pair_files(batches: Iterator[pa.RecordBatch], folder: str, bits: int) -> Iterator[pa.RecordBatch]:
    """Writes a shard's pairs and contexts. Rows out: (kind, key, x, y, z, path): a file (0, shard,
    pairs seen once, other pairs, contexts, path), a word's part (1, word, count, different words
    before it), and counts of counts (2, 1 to 4, pairs with that count)."""
    names = ["kind", "key", "x", "y", "z", "path"]
    of_counts = np.zeros(5, np.int64)
    words: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def rows(kind: int, key, x, y, z=0, path=None) -> pa.RecordBatch:
        n = len(key)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(np.asarray(k, np.int64)) for k in (key, x, y, np.full(n, z))), pa.array([path] * n, pa.string())], names)

    def word_rows() -> Iterator[pa.RecordBatch]:
        w, c, d = (np.concatenate(x) for x in zip(*words, strict=True))
        key, at = np.unique(w, return_inverse=True)
        c, d = (np.bincount(at, weights=x, minlength=len(key)).astype(np.int64) for x in (c, d))
        for i in range(0, len(key), 1 << 16):
            s = slice(i, i + (1 << 16))
            yield rows(1, key[s], c[s], d[s])

    for shard, (v, w, c) in _by_shard(_sharded(batches, bits)):
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])])
        at = np.flatnonzero(new)
        v, w, c = v[at].view(np.uint64), w[at], np.add.reduceat(c.astype(np.int64), at)
        of_counts += np.bincount(np.minimum(c, 5), minlength=6)[:5]
        heads = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        by_v = [np.add.reduceat(x.astype(np.int64), heads) for x in (c, c == 1, c == 2, c >= 3)]
        order = np.argsort(v[heads], kind="stable")  # signed order in the shuffle, unsigned here
        key = pair_key(v, w.view(np.uint64))
        once, more = np.sort(key[c == 1]), np.flatnonzero(c > 1)
        more = more[np.argsort(key[more], kind="stable")]
        path = _write(folder, [once, key[more], v[heads][order], by_v[0][order].astype(np.float64), *(x[order].astype(np.uint32) for x in by_v[1:]), np.minimum(c[more], (1 << 32) - 1).astype(np.uint32)])
        yield rows(0, [shard], [len(once)], [len(more)], len(heads), path)
        words.append((w, c, np.ones(len(w), np.int64)))
        if sum(len(x[0]) for x in words) >= HELD:
            yield from word_rows()
            words = []
    if words:
        yield from word_rows()
    yield rows(2, [1, 2, 3, 4], of_counts[1:5], np.zeros(4))


def _word_files(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for shard, (w, c, d) in _by_shard(batches):
        w = w.view(np.uint64)
        order = np.argsort(w, kind="stable")
        path = _write(folder, [w[order], c[order].astype(np.float64), d[order].astype(np.float64)])
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(w)], pa.int64()), pa.array([path])], ["shard", "n", "path"])


def discounts(t: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many things have the counts 1, 2, 3, 4; where one of those is
    missing, 0.75 of what a discount can be at most."""
    if all(x > 0 for x in t):
        y = t[0] / (t[0] + 2 * t[1])
        d = [k - (k + 1) * y * t[k] / t[k - 1] for k in (1, 2, 3)]
        if all(0 < x < k + 1 for k, x in enumerate(d, 0)):
            return tuple(min(x, k) for k, x in enumerate(d, 1))
    return 0.75, 1.0, 1.25


@dataclass
class Model:
    bits: int
    pairs: list[tuple[int, str, int, int, int]]  # shard, path, pairs seen once, other pairs, contexts
    words: list[tuple[int, str, int]]  # shard, path, words
    tokens: int
    vocabulary: int
    different_pairs: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_mass: float  # what the words' discounts took


def count(texts: DataFrame) -> Model:
    """Counts the model over the texts of a table's column `text`; null is empty."""
    spark = texts.sparkSession
    prepare(spark)
    bits = max(4, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())
    folder = new_path(spark, "pairs")
    pairs = texts.select(F.col("text").cast("string")).transform(map_batches, _pairs, "v long, w long, c int")
    pairs = pairs.repartition(F.shiftrightunsigned("v", 64 - bits)).sortWithinPartitions(F.shiftrightunsigned("v", 64 - bits), "v", "w")
    found = cut(pairs.transform(map_batches, partial(_pair_files, folder=folder, bits=bits), "kind int, key long, x long, y long, z long, path string"), "counted")
    del pairs
    release(spark)
    words = found.where("kind = 1").groupBy("key").agg(F.sum("x").alias("c"), F.sum("y").alias("d"))
    words = cut(words, "words")
    tops = F.least(F.col("d"), F.lit(5)).alias("d")
    of_words = {r["d"]: r["n"] for r in words.groupBy(tops).agg(F.count("*").alias("n")).collect()}
    total, different, vocabulary = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("d"), F.lit(0)), F.count("*")).first()
    shard = F.shiftrightunsigned("key", 64 - bits).cast("int").alias("shard")
    files = words.select(shard, "key", "c", "d").repartition("shard").sortWithinPartitions("shard", "key")
    files = cut(files.transform(map_batches, partial(_word_files, folder=folder), "shard int, n long, path string"), "word-files").collect()
    of_pairs = {r["key"]: r["n"] for r in found.where("kind = 2").groupBy("key").agg(F.sum("x").alias("n")).collect()}
    d = discounts([of_words.get(k, 0) for k in (1, 2, 3, 4)])
    mass = d[0] * of_words.get(1, 0) + d[1] * of_words.get(2, 0) + d[2] * sum(n for k, n in of_words.items() if k >= 3)
    model = Model(
        bits,
        sorted((r["key"], r["path"], r["x"], r["y"], r["z"]) for r in found.where("kind = 0").collect()),
        sorted((r["shard"], r["path"], r["n"]) for r in files),
        total, vocabulary, different,
        discounts([of_pairs.get(k, 0) for k in (1, 2, 3, 4)]), d, mass,
    )
    forget(words)
    forget(found)
    return model


def _mapped(path: str) -> np.ndarray:
    """A file's bytes, mapped into memory. A shared folder that is no mounted one is copied
    first; the copy has no name any more once it is mapped, so it goes with its last reader."""
    fs, inner = pafs.FileSystem.from_uri(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(inner, np.uint8, "r")
    with tempfile.NamedTemporaryFile() as local:
        with fs.open_input_stream(inner) as f:
            while chunk := f.read(1 << 24):
                local.write(chunk)
        local.flush()
        return np.memmap(local.name, np.uint8, "r")


def _sections(path: str, kinds: list[tuple[type, int]]) -> list[np.ndarray]:
    raw, out, at = _mapped(path), [], 0
    for kind, n in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(raw[at : at + size].view(kind))
        at += size
    return out


class Lookup:
    """Sorted arrays of shards: find() gives the columns of sorted 64-bit queries, 0 where
    a query is in no file of its shard."""

    def __init__(self, files: dict[int, list[tuple[np.ndarray, list[np.ndarray]]]], columns: int):
        self.files, self.columns = files, columns

    def find(self, queries: np.ndarray, shards: np.ndarray) -> list[np.ndarray]:
        out = [np.zeros(len(queries)) for _ in range(self.columns)]
        order = np.argsort(shards, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], shards[order][1:] != shards[order][:-1], [True]])) if len(order) else np.array([0])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = order[a:b]
            q = queries[own]
            for keys, columns in self.files.get(int(shards[own[0]]), []):
                if not len(keys):
                    continue
                at = np.searchsorted(keys, q)
                at[at == len(keys)] = 0
                has = keys[at] == q
                for o, c in zip(out, columns, strict=True):
                    o[own[has]] += c[at[has]]
        return out


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        once: dict[int, list] = {}
        pairs: dict[int, list] = {}
        contexts: dict[int, list] = {}
        words: dict[int, list] = {}
        for shard, path, n, more, k in model.pairs:
            single, key, v, total, n1, n2, n3, c = _sections(path, [(np.uint64, n), (np.uint64, more), (np.uint64, k), (np.float64, k), (np.uint32, k), (np.uint32, k), (np.uint32, k), (np.uint32, more)])
            once.setdefault(shard, []).append((single, [np.broadcast_to(1, n)]))
            pairs.setdefault(shard, []).append((key, [c]))
            contexts.setdefault(shard, []).append((v, [total, n1, n2, n3]))
        for shard, path, n in model.words:
            w, c, d = _sections(path, [(np.uint64, n), (np.float64, n), (np.float64, n)])
            words.setdefault(shard, []).append((w, [c, d]))
        self.once, self.pairs, self.contexts, self.words = Lookup(once, 1), Lookup(pairs, 1), Lookup(contexts, 4), Lookup(words, 2)

    def _discounted(self, c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3).astype(int)], 0)

    def __call__(self, v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether each token is known, log10 of its base share, log10 of p(w | v))."""
        m, high = self.m, np.uint64(64 - self.m.bits)
        own, of_w = np.unique(w, return_inverse=True)
        c, before = self.words.find(own, own >> high)
        base = np.log10((c + 0.1) / (m.tokens + 0.1 * (m.vocabulary + 1)))
        low = (self._discounted(before, m.word_discounts) + m.word_mass / (m.vocabulary + 1)) / m.different_pairs if m.different_pairs else np.full(len(own), 1 / (m.vocabulary + 1))
        first, of_v = np.unique(v, return_inverse=True)
        total, n1, n2, n3 = self.contexts.find(first, first >> high)
        d1, d2, d3 = m.pair_discounts
        back = d1 * n1 + d2 * n2 + d3 * n3
        key, one, of_pair = np.unique(pair_key(v, w), return_index=True, return_inverse=True)
        (pair,) = self.pairs.find(key, v[one] >> high)
        pair += self.once.find(key, v[one] >> high)[0]
        t, b, p = total[of_v[one]], back[of_v[one]], low[of_w[one]]
        score = np.log10(np.where(t > 0, (self._discounted(pair, m.pair_discounts) + b * p) / np.maximum(t, 1), p))
        return (c > 0)[of_w], base[of_w], score[of_pair]


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    hashed, scorer = Words(graph_bytes()), Scorer(model.value)
    for batch in batches:
        for first, raw, offsets in batch_texts(batch.column(batch.num_columns - 1), TEXT_BYTES):
            v, w, at = tokens(*hashed(raw, offsets))
            known, base, score = scorer(v, w)
            sums = [np.add.reduceat(x, at[:-1]) for x in (known.astype(np.int64), base, score)]
            n = len(offsets) - 1
            yield pa.RecordBatch.from_arrays([*(c.slice(first, n) for c in batch.columns[:-1]), pa.array(np.diff(at)), *map(pa.array, sums)], [*batch.schema.names[:-1], "n_tokens", "n_known", "base_score", "score"])


def kneser_ney_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), a row
    for each row of `docs`: scores are log10 of a text's probability.

    The model learns from the rows that are not held out. A null or empty text is the end
    token alone, a long one is scored whole; repeated ids and texts count and are scored each. Without training rows
    every share is that of one unknown word; an empty table gives no rows. Other columns are
    not read. Files of the model stay in the shared folder until it is cleared.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    model = count(docs.where("not held_out"))
    out = docs.transform(map_batches, partial(_score, model=spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))
