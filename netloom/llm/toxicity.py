"""A character n-gram linear classifier with naive Bayes log-count ratios (NB-LR), for
toxicity. Logistic regression is fitted over the presence of hashed n-grams of characters, each
scaled by its log ratio r = log((p + 1) / (P + 2)) - log((q + 1) / (Q + 2)), where p of the P
positive and q of the Q negative training texts hold it.

Counting covers all labelled training rows and is summed in Spark; every n-gram whose presence
depends on the label by a likelihood ratio test is a feature, however many there are; the
regression's weights are fitted by one task on at most `fit_rows` training rows, the first by a
hash of their id. Scoring is one pass over the texts without a shuffle: a table of 2**BITS
entries maps an n-gram's hash to its weight.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from netloom.llm.groups import runs
from netloom.llm.store import cut, forget, map_batches, prepare, release
from netloom.llm.text import batch_texts, lower_table, mix

#: Buckets of n-gram hashes, as a power of two, and buckets that are counted as one row.
BITS, BLOCK = 22, 4096
#: Characters of an n-gram. Held out at sf0.1 (97 toxic): 4, 6, 8 recall 0.845, precision 0.988;
#: 3, 4, 5 recall 0.784, precision 1.000; 3, 4, 5, 6 recall 0.835, precision 0.988.
SIZES = (4, 6, 8)
#: Least G of a feature: one bucket in a hundred that has nothing to do with the label exceeds it.
LEAST_G = 6.63


class Grams:
    """Buckets of n-grams of characters; A-Z counts as a-z, each character of ASCII white space
    as one blank."""

    def __init__(self, sizes: tuple[int, ...]):
        self.sizes = sizes
        fold = lower_table()
        fold[9:14] = 32
        # a character's number is the sum of those of its bytes, by their place in it
        self.letters = mix((np.arange(4, dtype=np.uint64)[:, None] * np.uint64(256) + fold + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))

    def characters(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a number for each character, the first character of each text and their total). A
        byte that goes on with no character counts to the one before it."""
        first = (raw & 0xC0) != 0x80
        if first.all():
            return self.letters[0][raw], offsets
        first[offsets[:-1][offsets[:-1] < len(raw)]] = True
        starts = np.flatnonzero(first)
        place = np.minimum(np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw)))), 3)
        return np.add.reduceat(self.letters[place, raw], starts), np.append(0, np.cumsum(first))[offsets]

    def __call__(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each size, the bucket of the n-gram at each character, those across texts included."""
        with np.errstate(over="ignore"):
            h = np.zeros(len(x), np.uint64)
            for n in range(1, max(self.sizes) + 1):
                if len(x) < n:
                    return
                h = h[: len(x) - n + 1] * np.uint64(0xD6E8FEB86659FD93) + x[n - 1 :]
                if n in self.sizes:
                    g = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                    yield n, (g >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Model:
    """features[b] is the feature of bucket b, or -1; a text scores 1 / (1 + exp(-bias - sum of
    the weights of the features that it has))."""

    sizes: tuple[int, ...]
    features: np.ndarray
    weights: np.ndarray
    bias: float


def _buckets_of_texts(texts: pa.Array, grams: Grams) -> Iterator[tuple[int, np.ndarray]]:
    """(number, its different buckets) of each text."""
    for first, raw, offsets in batch_texts(texts):
        x, offsets = grams.characters(raw, offsets)
        sizes = list(grams(x))
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), first):
            own = np.sort(np.concatenate([np.zeros(0, np.int32), *(bucket[a : max(a, b - n + 1)] for n, bucket in sizes)]))
            yield i, own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own


def _count(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """(block, counts): how many texts of label 0 and of label 1 hold each bucket of a block."""
    grams = Grams(sizes)
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        labels = batch.column(1).to_pylist()
        for i, buckets in _buckets_of_texts(batch.column(0), grams):
            counts[labels[i], buckets] += 1
    for k in range(0, 1 << BITS, BLOCK):
        own = counts[:, k : k + BLOCK]
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK], pa.int32()), pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())], ["block", "counts"])


def likelihood_ratio(counts: np.ndarray, total: tuple[int, int]) -> np.ndarray:
    """G of each bucket: twice the log likelihood that its presence gains by the label. Unlike a
    z-score of the ratio it grows on with the texts of a bucket that one label never has."""
    big = np.array(total, float)[:, None]
    share = counts.sum(axis=0) / max(1.0, big.sum())
    g = np.zeros(counts.shape[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        for seen, even in ((counts, big * share), (big - counts, big * (1 - share))):
            g += np.where(seen > 0, seen * np.log(seen / even), 0).sum(axis=0)
    return 2 * g


def _ratios(batches: Iterator[pa.RecordBatch], total: tuple[int, int], least: float) -> Iterator[pa.RecordBatch]:
    """(bucket, r) of the buckets of each block that depend on the label, from rows sorted by block."""
    big = np.array(total, float) + 2
    for t in runs(batches, ["block"]):
        counts = sum(np.frombuffer(zlib.decompress(x), np.int32).reshape(2, -1).astype(np.int64) for x in t["counts"].to_pylist())
        at = np.flatnonzero(likelihood_ratio(counts, total) >= least)
        q, p = counts[:, at] + 1.0
        r = np.log(p / big[1]) - np.log(q / big[0])
        yield pa.RecordBatch.from_arrays([pa.array(at + t["block"][0].as_py() * BLOCK, pa.int64()), pa.array(r)], ["bucket", "r"])


def _fit(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], given) -> Iterator[pa.RecordBatch]:
    """(weights, bias) from all rows (text, label), as little-endian doubles."""
    features, scale = given.value
    grams = Grams(sizes)
    index, lengths, labels = [np.zeros(0, np.int32)], [0], [np.zeros(0)]
    for batch in batches:
        labels.append(batch.column(1).to_numpy().astype(float))
        for _, buckets in _buckets_of_texts(batch.column(0), grams):
            own = features[buckets]
            index.append(own[own >= 0])
            lengths.append(len(index[-1]))
    if len(labels) > 1:
        weights, bias = fit_logistic(np.concatenate(index), np.cumsum(lengths), np.concatenate(labels), scale)
        yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f8").tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])


def fit_logistic(index: np.ndarray, ends: np.ndarray, y: np.ndarray, scale: np.ndarray, l2: float = 1e-3, epochs: int = 30, batch: int = 1024) -> tuple[np.ndarray, float]:
    """Weights over present features x * scale, and the bias, by mini-batches (Adam) in a fixed
    random order. Row i has the features index[ends[i]:ends[i + 1]]."""
    n, rng = len(y), np.random.default_rng(3)
    w, b = np.zeros(len(scale)), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    m, v, t = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            rows, t = order[k : k + batch], t + 1
            own = np.concatenate([np.zeros(0, np.int64), *(index[ends[i] : ends[i + 1]] for i in rows)])
            row = np.repeat(np.arange(len(rows)), ends[rows + 1] - ends[rows])
            s = scale[own]
            e = (1 / (1 + np.exp(-np.clip(np.bincount(row, w[own] * s, len(rows)) + b, -35, 35))) - y[rows]) / len(rows)
            g = np.append(np.bincount(own, e[row] * s, len(scale)) + l2 * w, e.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            d = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - d[:-1], b - d[-1]
    return w * scale, float(b)


def logistic(z: np.ndarray) -> np.ndarray:
    return np.where(z > -700, 1 / (1 + np.exp(-np.clip(z, -700, 700))), 0.0)


def bounded_sample(labelled: DataFrame, rows: int) -> DataFrame:
    """At most `rows` rows, the first by a hash of their id: nearly all of `rows`, or all there are.
    Only rows under a hash bound that lets about a tenth more through are sorted."""
    total = max(1, labelled.count())
    place = F.xxhash64(F.col("id").cast("string"))
    some = labelled.where(F.pmod(place, F.lit(1 << 30)) < int(min(1, 1.1 * rows / total) * (1 << 30)))
    return some.orderBy(F.pmod(place, F.lit(1 << 30)), "id").limit(rows)


def train(labelled: DataFrame, sizes: tuple[int, ...] = SIZES, least: float = LEAST_G, fit_rows: int = 20_000) -> Model:
    """From (id, text, label) with label 0 or 1; rows with another label or none are left out.
    Without any, nothing is known to be of label 1, and every score is 0."""
    spark = labelled.sparkSession
    prepare(spark)
    labelled = labelled.where("label in (0, 1)").select("id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("long").alias("label"))
    total = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    counts = labelled.select("text", "label").transform(map_batches, partial(_count, sizes=sizes), "block int, counts binary")
    counts = counts.repartition("block").sortWithinPartitions("block")
    best = counts.transform(map_batches, partial(_ratios, total=(total.get(0, 0), total.get(1, 0)), least=least), "bucket long, r double").toArrow().sort_by("bucket")
    features = np.full(1 << BITS, -1, np.int32)
    features[best["bucket"].to_numpy()] = np.arange(len(best))
    given = spark.sparkContext.broadcast((features, best["r"].to_numpy()))
    rows = bounded_sample(labelled, fit_rows).select("text", "label").coalesce(1)
    found = rows.transform(map_batches, partial(_fit, sizes=sizes, given=given), "weights binary, bias double").collect()
    if not found:
        return Model(sizes, features, np.zeros(len(best)), -np.inf)
    return Model(sizes, features, np.frombuffer(found[0]["weights"], "<f8"), found[0]["bias"])


def _score(batches: Iterator[pa.RecordBatch], model, at: int, out: int) -> Iterator[pa.RecordBatch]:
    model = model.value
    grams, weights = Grams(model.sizes), np.append(model.weights, 0.0)[model.features]
    for batch in batches:
        z = np.full(batch.num_rows, model.bias)
        for i, buckets in _buckets_of_texts(batch.column(at), grams):
            z[i] += weights[buckets].sum()
        yield pa.RecordBatch.from_arrays([*batch.columns[:out], pa.array(logistic(z))], [*batch.schema.names[:out], "score"])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all, if not given) and a last column `score`, for a null or
    empty text, too; a column of that name already there is replaced. The text goes to Python
    once, whether it is kept or not."""
    prepare(docs.sparkSession)
    keep = [c for c in keep or docs.columns if c.lower() != "score"]
    at = [c.lower() for c in [*keep, "text"]].index("text")
    wide = docs.select(*(F.col(f"`{c}`") for c in keep), *([F.col("text")] if at == len(keep) else []))
    fields = StructType([*wide.schema.fields[: len(keep)], StructField("score", DoubleType())])
    return wide.transform(map_batches, partial(_score, model=docs.sparkSession.sparkContext.broadcast(model), at=at, out=len(keep)), fields)


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """(id, label): of a document's rows that have a label of 0 or 1, the largest counts."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy(F.col("doc_id").alias("id")).agg(F.max(column).cast("long").alias("label"))


def training_rows(docs: DataFrame, labels: DataFrame, column: str, held_out: Column, *more: str) -> DataFrame:
    """(id, text, label, *more) of labelled documents that are not held out, cut: a fit reads it
    more than once. Texts are shuffled once, those alone that Spark's Bloom filter of labelled
    ids lets through (8 MB at most); its setting is for large scans only and is lowered here."""
    rows = docs.where(~held_out).select(F.col("doc_id").alias("id"), "text", *more)
    labelled = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).select(F.col("doc_id").alias("id"))
    rows = rows.join(labelled, "id", "left_semi").join(labels_of(labels, column), "id")
    return _filtered_cut(rows.select("id", "text", "label", *more), f"train-{column}")


def _filtered_cut(rows: DataFrame, name: str) -> DataFrame:
    """cut() of a join of texts with few ids, of which Spark makes a Bloom filter for the texts."""
    spark = rows.sparkSession
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        out = cut(rows, name)
    finally:
        spark.conf.set(key, before)
    del rows
    release(spark)
    return out


def chosen_rows(docs: DataFrame, labels: DataFrame, column: str, held_out: Column, rows: int, *more: str) -> DataFrame:
    """bounded_sample() of training_rows(), cut, for a fit that reads no more than that: rows are
    chosen by ids and labels, and only the texts of the chosen ids are shuffled."""
    ids = docs.where(~held_out).select(F.col("doc_id").alias("id")).join(labels_of(labels, column), "id")
    chosen = cut(bounded_sample(ids, rows).groupBy("id").agg(F.first("label").alias("label")), f"chosen-{column}")
    texts = docs.where(~held_out).select(F.col("doc_id").alias("id"), "text", *more)
    # rows share an id at times, and then all of them come
    found = _filtered_cut(texts.join(chosen.select("id"), "id", "left_semi").join(chosen, "id").select("id", "text", "label", *more), f"train-{column}")
    forget(chosen)
    return found


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a document's id, as text, falls into the held-out fold; a null id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of `docs`.

    Learns from `labels` (doc_id, toxic) where crc32 of the id as text is not 0 modulo 5, and
    from nothing but texts. Null and empty texts are scored as texts without n-grams; repeated
    ids are scored row by row; unlabelled rows and null labels teach nothing. Without any
    labelled row, or without documents, every score is 0.5 or there are no rows.
    """
    fold = held_out(5, 0)
    model = train(training_rows(docs, labels, "toxic", fold))
    out = score(docs.select("doc_id", fold.alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
