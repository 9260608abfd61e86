"""Token ids of many words at once, for tokenizer files of byte-level BPE with word ends.

A file's merges are applied to a matrix with a row for each word part: in each round, every
row that has a pair left takes its best one, the leftmost of equals, as the tokenizers library
does for one word at a time. Ids are those of the library (tested against it); what is not of
the known form goes through the library itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Fixed values of the tokenizer file's format: its normalizer, how it parts words, its model.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PARTS = {
    "type": "Sequence",
    "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
}
MODEL = {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "byte_fallback": False, "ignore_merges": False}
#: Words of these characters alone are parted here: NFC leaves them, and there are no other numbers and spaces.
PLAIN = re.compile("[!-~À-ÿŒœ]+")
PLAIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^0-9a-zß-öø-ÿœ]+")
#: Bytes of a part that is merged here, and the widths of matrices; longer parts go to the library.
WIDTHS = (1, 4, 8, 12, 16, 24, 40, 64)
NONE = np.int32(0x7FFFFFFF)


def byte_characters() -> list[str]:
    """What byte-level tokenizers write for each byte: a printable character, itself where it is one."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    shown = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [shown[b] for b in range(256)]


class Merges:
    """A hash table from a pair of ids to its rank and the id that it becomes."""

    BITS = 18

    def __init__(self, vocabulary: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        key = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in pairs], np.uint32)
        self.becomes = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self.keys = np.full(1 << self.BITS, 0xFFFFFFFF, np.uint32)
        self.ranks = np.full(1 << self.BITS, NONE, np.int32)
        left, at = np.arange(len(key)), self._places(key)
        while len(left):  # the first of those that want a free place gets it, the others look at the next
            free = self.keys[at[left]] == 0xFFFFFFFF
            first = np.unique(at[left[free]], return_index=True)[1]
            won = left[free][first]
            self.keys[at[won]], self.ranks[at[won]] = key[won], won
            left = np.setdiff1d(left, won)
            at[left] = (at[left] + 1) & ((1 << self.BITS) - 1)

    def _places(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(0x9E3779B1) >> np.uint32(32 - self.BITS)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where there is none."""
        key = (a << 16 | b).astype(np.uint32)
        at = self._places(key)
        out, seen = self.ranks[at], self.keys[at]
        more = np.flatnonzero((seen != key) & (seen != 0xFFFFFFFF))
        out[seen != key] = NONE
        while len(more):
            at[more] = (at[more] + 1) & ((1 << self.BITS) - 1)
            seen = self.keys[at[more]]
            hit = seen == key[more]
            out[more[hit]] = self.ranks[at[more[hit]]]
            more = more[~hit & (seen != 0xFFFFFFFF)]
        return out


class WordIds(dict):
    """The ids of words as little-endian 32-bit numbers, for one task. The tokenizer splits at
    white space and drops it, so a text's ids are those of its words. What is held is bounded
    in bytes: once it is full, it starts anew."""

    HELD = 64 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            form = json.load(f)
        self.special = [t["content"].encode() for t in form.get("added_tokens") or []]
        self.bytes = 0
        model, shown = form["model"], byte_characters()
        vocabulary = model.get("vocab")
        self.known = form.get("normalizer") == NORMALIZER and form.get("pre_tokenizer") == PARTS and all(model.get(k) == v for k, v in MODEL.items())
        self.known = self.known and max(vocabulary.values()) < 0xFFFF and all(c + end in vocabulary for c in shown for end in ("", "</w>"))
        if self.known:
            self.merges = Merges(vocabulary, model["merges"])
            self.inner, self.last = (np.array([vocabulary[c + end] for c in shown], np.int32) for end in ("", "</w>"))

    def words(self, data: bytes, ends: list[int]) -> list[list[bytes]]:
        """The words of texts; A-Z as a-z if the tokenizer does not tell them apart."""
        if self.known:
            low = data.lower()
            if not any(t in low for t in self.special):
                data = low
        return [data[a:b].split() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def learn(self, words: set[bytes]) -> None:
        new = words.difference(self)
        if self.bytes > self.HELD:
            self.clear()
            self.bytes = 0
            new = words
        rest = [w for w in new if len(w) > WIDTHS[-1]] if self.known else list(new)
        joined = b" ".join(new)
        for t in self.special if self.known else ():
            if t in joined:
                rest += [w for w in new.difference(rest) if t in w]
        if rest:
            new = new.difference(rest)
        plain = [w for w in new if w.isalpha()]  # of bytes: a-z and A-Z alone
        parts, counts = [w.lower() for w in plain], [1] * len(plain)
        for w in new.difference(plain):
            text = w.decode()
            own = [p.encode() for p in PLAIN_PARTS.findall(text.lower())] if PLAIN.fullmatch(text) else []
            if own:
                plain.append(w)
                parts += own
                counts.append(len(own))
            else:
                rest.append(w)
        if plain:
            ids, ends = self.merged(parts)
            ends = np.append(0, ends)[np.append(0, np.cumsum(counts))].tolist()
            data = ids.astype("<u4").tobytes()
            for w, a, b in zip(plain, ends[:-1], ends[1:], strict=True):
                self[w] = data[4 * a : 4 * b]
            self.bytes += sum(map(len, plain)) + len(data)
        if rest:
            found = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
            for w, x in zip(rest, found, strict=True):
                self[w] = np.array(x.ids, "<u4").tobytes()
                self.bytes += len(w) + len(self[w])
        self.bytes += 180 * (len(plain) + len(rest))  # two objects and a place in the table

    def merged(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts in order, where each part's end)."""
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        raw = np.frombuffer(b"".join(parts), np.uint8)
        start = np.cumsum(length) - length
        n = np.zeros(len(parts), np.int64)
        out = np.zeros(len(raw), np.int32)  # at first, ids at the place of their first byte
        alive = np.zeros(len(raw), bool)
        for low, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            rows = np.flatnonzero((length > low) & (length <= width))
            if not len(rows):
                continue
            own, at = length[rows], start[rows][:, None] + np.arange(width)
            has = np.arange(width) < own[:, None]
            symbols = np.full((len(rows), width + 1), 0xFFFF, np.int64)
            symbols[:, :-1][has] = self.inner[raw[at[has]]]
            symbols[np.arange(len(rows)), own - 1] = self.last[raw[start[rows] + own - 1]]
            stay = self._merge(symbols, has, own)
            out[at[stay]], alive[at[stay]] = symbols[:, :-1][stay], True
            n[rows] = stay.sum(axis=1)
        return out[alive], np.cumsum(n)

    def _merge(self, symbols: np.ndarray, has: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Applies the merges to rows of symbols; says which places still hold one."""
        rows, width = has.shape
        stay = has.copy()
        rank = np.full((rows, width), NONE, np.int32)
        r, p = np.nonzero(has[:, 1:])  # a place and the next one
        rank[r, p] = self.merges(symbols[r, p], symbols[r, p + 1])
        after = np.broadcast_to(np.arange(1, width + 2), (rows, width + 1)).copy()
        before = after - 2
        while True:
            p = rank.argmin(axis=1)
            best = rank[np.arange(rows), p]
            r = np.flatnonzero(best != NONE)
            if not len(r):
                return stay
            p, best = p[r], best[r]
            q = after[r, p]
            beyond = after[r, q]
            own = symbols[r, p] = self.merges.becomes[best]
            stay[r, q] = False
            rank[r, q] = NONE
            after[r, p], before[r, beyond] = beyond, p
            rank[r, p] = self.merges(own, np.where(beyond < length[r], symbols[r, beyond], 0xFFFF))
            left = before[r, p]
            ok = left >= 0
            rank[r[ok], left[ok]] = self.merges(symbols[r[ok], left[ok]], own[ok])
