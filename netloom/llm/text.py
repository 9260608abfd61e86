"""Words of whole texts as 64-bit hashes, computed over the bytes of an Arrow batch at once.

A word is a maximal run of the bytes that a byte class marks, after A-Z became a-z; every
byte of a character beyond ASCII counts as marked by both classes below. A word's hash is
the sum of T[b_i] * P**i over its bytes modulo 2**64, mixed, so it is the same wherever the
word stands. Two different words share a hash with odds of about 2**-62.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15
_K = np.uint64(0xD6E8FEB86659FD93)
#: Bytes taken at once; longer texts are taken in pieces that end between words.
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def graph_bytes() -> np.ndarray:
    """All but space and \\x09-\\x0D."""
    t = np.ones(256, dtype=bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def alnum_bytes() -> np.ndarray:
    """Digits, a-z and all bytes beyond ASCII."""
    t = np.zeros(256, dtype=bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


def batch_texts(texts: pa.Array | pa.ChunkedArray, limit: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, bytes, offsets) for runs of texts of about `limit` bytes; a null is empty.
    Text i of a run, which is text first + i of the batch, is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64, count=texts.offset + n + 1)[texts.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Words:
    """Hashes the words of runs of texts."""

    def __init__(self, marked: np.ndarray):
        self.lower, self.marked = lower_table(), marked
        self.letters = mix(np.arange(1, 257, dtype=np.uint64) * _K)
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(SEGMENT, _P, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(SEGMENT, pow(_P, -1, 1 << 64), np.uint64)]), dtype=np.uint64)

    def spans(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lowered bytes, starts, ends) of all words in order; no word crosses texts."""
        low = self.lower[raw]
        m = self.marked[low]
        if not len(m):
            return low, np.zeros(0, np.int64), np.zeros(0, np.int64)
        s, e = m.copy(), m.copy()
        s[1:] &= ~m[:-1]
        e[:-1] &= ~m[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(m))]
        s[inner] = m[inner]
        e[inner - 1] = m[inner - 1]
        return low, np.flatnonzero(s), np.flatnonzero(e) + 1

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word in order, the number of the first word of each text, and their total)."""
        low, s, e = self.spans(raw, offsets)
        firsts = np.searchsorted(s, offsets)
        out = np.empty(len(s), np.uint64)
        w = 0
        while w < len(s):
            base = s[w]
            last = max(w + 1, int(np.searchsorted(e, base + SEGMENT, "right")))
            out[w:last] = self._hash(low[base : e[last - 1]], s[w:last] - base, e[w:last] - base)
            w = last
        return out, firsts

    def _hash(self, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        up, down = self.up, self.down
        with np.errstate(over="ignore"):
            if len(low) > SEGMENT:  # one word, longer than a segment
                parts = [self._hash(low[i : i + SEGMENT], np.array([0]), np.array([min(SEGMENT, len(low) - i)])) for i in range(0, len(low), SEGMENT)]
                h = np.uint64(len(low))
                for p in parts:
                    h = mix(np.atleast_1d(h * _K + p[0]))[0]
                return np.array([h], np.uint64)
            sums = np.empty(len(low) + 1, np.uint64)
            sums[0] = 0
            np.cumsum(self.letters[low] * up[: len(low)], out=sums[1:])
            h = (sums[e] - sums[s]) * down[s]
            return mix(h + (e - s).astype(np.uint64))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each word on; of the last k - 1, of what is left of none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n] * _K
        for j in range(1, k):
            h = (h + words[j : j + n]) * _K
        return mix(h + np.uint64(k))


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]
