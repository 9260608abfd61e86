"""A quality classifier: a factorisation machine over hashed words, structure and metadata.

  z = b + sum of w_i x_i + 1/2 sum over f of ((sum of v_if x_i)^2 - sum of v_if^2 x_i^2)

so all pairwise interactions cost time linear in a text's features. Features: which hashed
words a text has (a share of 1 / sqrt of their number each), and bins of structure numbers
(case, digits, symbols, repeated words and lines, lengths ...) with one more bin of the
table's character count as metadata. Words and numbers come from bytes of a whole batch
at once. The weights are fitted on at most `fit_rows` labelled training rows, the first by a
hash of their id; scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.store import map_batches, prepare
from netloom.llm.text import Words, batch_texts, graph_bytes
from netloom.llm.toxicity import bounded_sample, chosen_rows, held_out

#: Buckets of hashed words as a power of two, bins of a number, latent factors.
BITS, BINS, FACTORS = 16, 16, 8
#: Labelled rows that a model is fitted on at most.
FIT_ROWS = 20_000
#: Numbers of a text's structure, each in [0, 1], and the metadata number.
NUMBERS = ("upper", "digit", "symbol", "punctuation", "blank", "beyond_ascii", "word_length", "longest_word", "words", "different_words", "repeated_next", "repeated_pair", "capitalised", "stopped", "lines", "different_lines", "commonest_word", "table_chars")
_SIZE = (1 << BITS) + len(NUMBERS) * BINS


def _line_bytes() -> np.ndarray:
    t = np.ones(256, dtype=bool)
    t[[10, 13]] = False
    return t


class Features:
    def __init__(self):
        self.words, self.lines = Words(graph_bytes()), Words(_line_bytes())
        kind = np.zeros((6, 256), bool)
        kind[0, 65:91] = kind[1, 48:58] = kind[5, 128:] = True
        kind[2, [ord(c) for c in "#$%&*+/<=>@\\^_`{|}~"]] = True
        kind[3, [ord(c) for c in "!\"'(),-.:;?[]"]] = True
        kind[4, [32, *range(9, 14)]] = True
        self.kind = kind

    def numbers(self, raw: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts x numbers, hash of each word, each text's first word)."""
        n = len(offsets) - 1
        size = np.maximum(np.diff(offsets), 1).astype(float)

        def share(marks: np.ndarray, firsts: np.ndarray, of: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(marks)])
            return (sums[firsts[1:]] - sums[firsts[:-1]]) / of

        out = [share(k[raw], offsets, size) for k in self.kind]
        hashed, firsts = self.words(raw, offsets)
        _, s, e = self.words.spans(raw, offsets)
        count = np.diff(firsts)
        some = np.maximum(count, 1).astype(float)
        length = (e - s).astype(float)
        out.append(np.minimum(share(length, firsts, some) / 20, 1))
        longest = np.zeros(n)
        np.maximum.at(longest, np.repeat(np.arange(n), count), length)
        out.append(np.minimum(np.log1p(longest) / 8, 1))
        out.append(np.minimum(np.log1p(count) / 12, 1))
        text = np.repeat(np.arange(n), count)
        order = np.lexsort((hashed, text))
        new = np.ones(len(hashed), bool)
        new[1:] = (hashed[order][1:] != hashed[order][:-1]) | (text[order][1:] != text[order][:-1])
        different = np.bincount(text[order][new], minlength=n)
        out.append(different / some)
        inside = text[1:] == text[:-1]
        out.append(np.bincount(text[1:][inside & (hashed[1:] == hashed[:-1])], minlength=n) / some)
        inside = text[2:] == text[:-2]
        out.append(np.bincount(text[2:][inside & (hashed[2:] == hashed[:-2])], minlength=n) / some)
        out.append(share(self.kind[0][raw[s]], firsts, some) if len(s) else np.zeros(n))
        out.append(share(np.isin(raw[e - 1], np.frombuffer(b".!?:;", np.uint8)), firsts, some) if len(s) else np.zeros(n))
        line, line_firsts = self.lines(raw, offsets)
        lines = np.diff(line_firsts)
        out.append(np.minimum(np.log1p(lines) / 8, 1))
        own = np.repeat(np.arange(n), lines)
        line_order = np.lexsort((line, own))
        fresh = np.ones(len(line), bool)
        fresh[1:] = (line[line_order][1:] != line[line_order][:-1]) | (own[line_order][1:] != own[line_order][:-1])
        out.append(np.bincount(own[line_order][fresh], minlength=n) / np.maximum(lines, 1))
        run = np.diff(np.append(np.flatnonzero(new), len(new)))
        most = np.zeros(n)
        np.maximum.at(most, text[order][new], run.astype(float))
        out.append(most / some)
        out.append(np.minimum(np.log1p(np.maximum(n_chars, 0)) / 14, 1))
        return np.stack(out, axis=1), hashed, firsts

    def __call__(self, raw: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value) of all texts of a run, by text."""
        numbers, hashed, firsts = self.numbers(raw, offsets, n_chars)
        n = len(numbers)
        text = np.repeat(np.arange(n), np.diff(firsts))
        pairs = np.unique((text.astype(np.int64) << BITS) | (hashed >> np.uint64(64 - BITS)).astype(np.int64))
        text, word = pairs >> BITS, pairs & ((1 << BITS) - 1)
        share = 1 / np.sqrt(np.maximum(np.bincount(text, minlength=n), 1))
        bins = np.minimum((np.sqrt(np.clip(numbers, 0, 1)) * BINS).astype(np.int64), BINS - 1) + np.arange(len(NUMBERS)) * BINS + (1 << BITS)
        text = np.concatenate([text, np.repeat(np.arange(n), len(NUMBERS))])
        feature = np.concatenate([word, bins.ravel()])
        value = np.concatenate([share[pairs >> BITS], np.ones(bins.size)])
        order = np.argsort(text, kind="stable")
        return text[order], feature[order], value[order]


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # features x factors

    def z(self, n: int, text: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = self.bias + np.bincount(text, self.weights[feature] * value, n)
        for f in range(self.factors.shape[1]):
            vx = self.factors[feature, f] * value
            out += (np.bincount(text, vx, n) ** 2 - np.bincount(text, vx * vx, n)) / 2
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fit(features: np.ndarray, values: np.ndarray, ends: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 256, rate: float = 0.1, l2: float = 1e-5) -> Model:
    """Logistic loss by mini-batches with AdaGrad, in a fixed random order. Row i has the
    features and values from ends[i] to ends[i + 1]."""
    rng = np.random.default_rng(7)
    model = Model(0.0, np.zeros(_SIZE), rng.normal(0, 0.02, (_SIZE, FACTORS)))
    if not len(y):
        return model
    model.bias = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    seen_w, seen_v, seen_b = np.full(_SIZE, 1e-6), np.full((_SIZE, FACTORS), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            feature = np.concatenate([features[ends[i] : ends[i + 1]] for i in own])
            value = np.concatenate([values[ends[i] : ends[i + 1]] for i in own]).astype(float)
            text = np.repeat(np.arange(len(own)), ends[own + 1] - ends[own])
            e = (sigmoid(model.z(len(own), text, feature, value)) - y[own]) / len(own)
            used, at = np.unique(feature, return_inverse=True)
            g = np.bincount(at, e[text] * value, len(used)) + l2 * model.weights[used]
            seen_w[used] += g * g
            model.weights[used] -= rate * g / np.sqrt(seen_w[used])
            gb = e.sum()
            seen_b += gb * gb
            model.bias -= rate * gb / np.sqrt(seen_b)
            for f in range(FACTORS):
                vx = model.factors[feature, f] * value
                s = np.bincount(text, vx, len(own))
                g = np.bincount(at, e[text] * value * (s[text] - vx), len(used)) + l2 * model.factors[used, f]
                seen_v[used, f] += g * g
                model.factors[used, f] -= rate / 2 * g / np.sqrt(seen_v[used, f])
    return model


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bias, weights, factors) from all rows (text, label, n_chars), as little-endian doubles."""
    of = Features()
    features, shares, lengths, labels = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)], [[0]], [np.zeros(0)]
    for batch in batches:
        chars = batch.column(2).to_numpy(zero_copy_only=False)
        for first, raw, offsets in batch_texts(batch.column(0)):
            n = len(offsets) - 1
            text, feature, value = of(raw, offsets, chars[first : first + n])
            features.append(feature.astype(np.int32))
            shares.append(value.astype(np.float32))
            lengths.append(np.bincount(text, minlength=n))
        labels.append(batch.column(1).to_numpy(zero_copy_only=False).astype(float))
    model = fit(np.concatenate(features), np.concatenate(shares), np.cumsum(np.concatenate(lengths)).astype(np.int64), np.concatenate(labels))
    yield pa.RecordBatch.from_arrays([pa.array([model.bias]), *(pa.array([x.astype("<f8").tobytes()], pa.binary()) for x in (model.weights, model.factors))], ["bias", "weights", "factors"])


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """From (id, text, n_chars, label) with label 0 or 1; rows with another label are left out.
    One task fits on at most `fit_rows` rows; only the model comes to the driver."""
    prepare(labelled.sparkSession)
    chosen = bounded_sample(labelled.where("label in (0, 1)"), fit_rows)
    chosen = chosen.select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("long").alias("label"), F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)).alias("n_chars"))
    found = chosen.coalesce(1).transform(map_batches, _fit, "bias double, weights binary, factors binary").collect()
    if not found:
        return fit(np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(1, np.int64), np.zeros(0))
    bias, weights, factors = found[0]
    return Model(bias, np.frombuffer(weights, "<f8"), np.frombuffer(factors, "<f8").reshape(_SIZE, FACTORS))


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    model, features = model.value, Features()
    for batch in batches:
        chars = batch.column(3).to_numpy(zero_copy_only=False)
        for first, raw, offsets in batch_texts(batch.column(2)):
            n = len(offsets) - 1
            score = sigmoid(model.z(n, *features(raw, offsets, chars[first : first + n])))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(score)], ["doc_id", "held_out", "score"])


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of `docs` (doc_id, text, n_chars).

    Learns from `labels` (doc_id, quality) where crc32 of the id as text is not 2 modulo 4.
    Null and empty texts are scored as texts without words, long ones whole, a null n_chars
    counts as 0;
    repeated ids are scored row by row; unlabelled rows and null labels teach nothing.
    Without labelled rows scores are near 0.5; an empty table gives no rows. Other columns
    are not read.
    """
    prepare(docs.sparkSession)
    fold = held_out(4, 2)
    chars = F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0))
    model = train(chosen_rows(docs, labels, "quality", fold, FIT_ROWS, "n_chars"))
    wide = docs.select("doc_id", fold.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), chars.alias("n_chars"))
    out = wide.transform(map_batches, partial(_score, model=docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
