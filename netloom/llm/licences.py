"""Licence scan by conditional compression.

Lines that speak of licences, with near ones, are candidate blocks. A block is compressed by
zstandard alone and with each template as raw dictionary; the template that takes the most
off its size names it best. Each that takes any off is confirmed by its exact wording: words of
block and template are aligned, and a template holds if most of it, or most of the block
where it says so in a line, is there. The words that differ are reported.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.store import map_batches, prepare

# Public wordings of licences, (name, kind, text); a notice is a line that names
# a licence, a text is a grant itself.
TEMPLATES: list[tuple[str, str, str]] = [
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "This software is licensed under the MIT License."),
    ("MIT", "text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "text", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "text", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1", "notice", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "notice", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "notice", "Licensed under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "text", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "notice", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "text", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "notice", "Released under CC0 1.0, dedicated to the public domain."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "notice", "All rights reserved."),
]

#: What a candidate line speaks of.
SPEAKS = re.compile(r"(?i)licen[sc]|copyright|all\s{1,4}rights\s{1,4}reserved|permission|redistribut|public\s{1,4}domain|creative\s{1,4}commons|spdx|warrant|free\s{1,4}software|\bCC[ -](?:BY|0)|CC0")
#: Lines of other matter that a block may hold between candidate lines, and characters of a
#: line that are one piece; a longer line is taken in pieces that end at blanks.
GAP, PIECE = 2, 2000
#: Characters of a window of a long block, and how much the next one holds of it: more than any
#: template's wording, so that each lies whole in one.
SPAN, SHARED = 8000, 4000
#: How much of a template's wording must be there.
HELD_SHARE = 0.8


WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words(text: str) -> list[str]:
    """Words for comparison: letters, digits and inner points; case and layout don't count."""
    return [m.group().lower() for m in WORD.finditer(text)]


def pieces(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of lines; of long ones, pieces that end at a blank where there is one."""
    for m in re.finditer(r"[^\r\n]+", text):
        a, b = m.span()
        while b - a > PIECE:
            cut = text.rfind(" ", a + PIECE // 2, a + PIECE) + 1 or a + PIECE
            yield a, cut
            a = cut
        yield a, b


def blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of candidate blocks: pieces that speak of licences, joined over short gaps."""
    if not SPEAKS.search(text):
        return []
    out: list[list[int]] = []
    last = -GAP - 2
    for k, (a, b) in enumerate(pieces(text)):
        if SPEAKS.search(text, a, b):
            if out and k - last <= GAP + 1:
                out[-1][1] = b
            else:
                out.append([a, b])
            last = k
    return [(a, b) for a, b in out]


def windows(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(start, end) of what is looked at at once of a block: all of it, or if it is long, windows
    that begin and end at blanks where there are some."""
    while end - start > SPAN:
        cut = text.rfind(" ", start + SPAN - 1000, start + SPAN) + 1 or start + SPAN
        yield start, cut
        start = text.rfind(" ", cut - SHARED - 1000, cut - SHARED) + 1 or cut - SHARED
    yield start, end


def merged(rows: list[dict]) -> list[dict]:
    """Of rows of one licence that overlap, the one with more of the wording."""
    out: list[dict] = []
    for row in sorted(rows, key=lambda r: (r["start"], -r["length"])):
        near = next((i for i in range(len(out) - 1, -1, -1) if out[i]["licence"] == row["licence"]), None)
        if near is None or out[near]["start"] + out[near]["length"] <= row["start"]:
            out.append(row)
        elif (row["share"], row["reduction"]) > (out[near]["share"], out[near]["reduction"]):
            out[near] = row
    return sorted(out, key=lambda r: r["start"])


def parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """The candidate pieces of a block, or if it is one piece, its candidate sentences."""
    lines = [(start + a, start + b) for a, b in pieces(text[start:end])]
    if len(lines) == 1:
        ends = [m.end() for m in re.finditer(r"[.!?](?=\s+[^a-z\s])", text[start:end])]
        lines = [(start + a, start + b) for a, b in zip([0, *ends], [*ends, end - start], strict=True)]
    for a, b in lines:
        while a < b and text[a].isspace():
            a += 1
        if a < b and (a, b) != (start, end) and SPEAKS.search(text, a, b):
            yield a, b


class Matcher:
    def __init__(self):
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=19)
        self.words = [words(t) for _, _, t in TEMPLATES]
        folded = [" ".join(w).encode() for w in self.words]
        self.given = [zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(t.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in folded]
        self.best = lru_cache(1 << 12)(self._best)

    def _best(self, block: str) -> tuple[str, str, float, float, str, int, int] | None:
        """(licence, kind, size reduction, share of words in place, differences, first, last word)
        of the template that takes the most off among those whose wording holds."""
        own = words(block)
        data = " ".join(own).encode()
        if not data:
            return None
        alone = len(self.plain.compress(data))
        held, there = [], Counter(own)
        for i, c in enumerate(self.given):
            name, kind, _ = TEMPLATES[i]
            want = self.words[i]
            if (Counter(want) & there).total() < HELD_SHARE * len(want):
                continue
            reduction = 1 - len(c.compress(data)) / alone
            same = difflib.SequenceMatcher(None, want, own, autojunk=False)
            share = sum(m.size for m in same.get_matching_blocks()) / len(want)
            numbers = {w for w in want if any(c.isdigit() for c in w)}
            if reduction <= 0 or share < HELD_SHARE or not numbers <= set(own):
                continue
            changes = [f"-{' '.join(want[a:b])}+{' '.join(own[c:d])}" for op, a, b, c, d in same.get_opcodes() if op != "equal" and (b > a or c not in (0,) and d != len(own))]
            runs = [m for m in same.get_matching_blocks() if m.size > 2] or [m for m in same.get_matching_blocks() if m.size]
            held.append((reduction, share, -i, name, kind, "; ".join(changes), runs[0].b, runs[-1].b + runs[-1].size))
        if not held:
            return None
        reduction, share, _, name, kind, changes, first, last = max(held)
        return name, kind, round(reduction, 6), round(share, 6), changes, first, last


_FOUND = pa.list_(pa.struct([("licence", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("reduction", pa.float64()), ("share", pa.float64()), ("differences", pa.string())]))


def scan(text: str, matcher: Matcher) -> list[dict]:
    """The confirmed blocks of a text in order. Pieces of a block that a notice names, or that
    no template holds, are looked at first for themselves, and then their sentences; what stands
    before and behind the words of a licence's text is looked at as a block of its own."""

    def look(a: int, b: int) -> list[dict]:
        best = matcher.best(text[a:b])
        if not best or best[1] == "notice":
            inner = [x for part in parts(text, a, b) for x in look(*part)]
            return inner or ([_row(a, b - a, best[:5])] if best else [])
        places = [m.span() for m in WORD.finditer(text, a, b)]
        first, last = places[best[5]][0], places[best[6] - 1][1]
        rest = [look(x, y) if SPEAKS.search(text, x, y) else [] for x, y in ((a, first), (last, b))]
        if any(rest):
            return [*rest[0], _row(first, last - first, best[:5]), *rest[1]]
        return [_row(a, b - a, best[:5])]

    out = []
    for a, b in blocks(text):
        own = list(windows(text, a, b))
        found = [x for w in own for x in look(*w)]
        out += merged(found) if len(own) > 1 else found
    return out


def _row(start: int, length: int, best: tuple) -> dict:
    return dict(zip(("licence", "kind", "reduction", "share", "differences"), best, strict=True)) | {"start": start, "length": length}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    matcher = Matcher()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[] if t is None else scan(t, matcher) for t in batch.column(1).to_pylist()], _FOUND)], ["doc_id", "found"])


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_blocks, licences, found), a row for each row of `docs`: `found` has each
    confirmed block with its place in code points, `licences` the distinct names in order.

    Null and empty texts have none; long texts are scanned whole, a long block in windows that
    share more than a wording; repeated ids are scanned row by row; an empty table gives no
    rows; other columns are not read.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = "array<struct<licence: string, kind: string, start: int, length: int, reduction: double, share: double, differences: string>>"
    out = docs.transform(map_batches, _scan, f"doc_id long, found {found}")
    return out.select("doc_id", F.size("found").cast("long").alias("n_blocks"), F.array_sort(F.array_distinct(F.col("found.licence"))).alias("licences"), "found")
