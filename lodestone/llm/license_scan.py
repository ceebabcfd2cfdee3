"""License statements in documents, found by conditional compression.

Words that speak of licenses mark candidate blocks in the whole text.  Where a
part of a template is in a block word for word, a window of about the
template's length is cut out and compressed, alone and with the template as a
zstandard raw-content dictionary.  The bytes saved, less half of those that
are left, rank all windows of a block; in rank order they are confirmed by
wording, and the first that fits wins: the
template is aligned with its window word by word, and what differs (words
changed, missing or put in between) may be at most one word in ten, so that a
short statement must be there exactly.  Of windows of equal rank, that of
the longest template comes first.  A statement's words are taken out, and the
windows they were in are weighed again, so a block can hold several
statements.  Compression only ranks: every window has its turn.

The catalogue holds whole texts of the short licenses, the usual notices of
the long ones, and identifier lines; what is in none of them is not found.

One pass over the texts, without a shuffle.  Defined cases: null and empty
texts have no blocks; a block is bounded by its marks' distance and longer
runs of marks are cut into blocks of ``BLOCK_WORDS`` that overlap by the
longest template; repeated rows are scanned each; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, quoted, small_batches, text_or_empty, texts_of

# Wording of public licenses and of their usual notices.
_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ", provided that the above copyright notice and this permission notice appear in all copies.",
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
)
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        _MIT[0] + _MIT[1],
        " ".join((_MIT[0] + _MIT[1], _MIT[2])),
        "Licensed under the MIT license. See LICENSE in the project root for license information.",
    ],
    "MIT-0": [_MIT[0] + ".", " ".join((_MIT[0] + ".", _MIT[2]))],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", " ".join((*_BSD[:3], _WARRANTY))],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", " ".join((*_BSD, _WARRANTY))],
    "BSD": [_BSD[0]],  # what all its variants begin with
    "ISC": [_ISC[0] + _ISC[1], " ".join((_ISC[0] + _ISC[1], _ISC[2]))],
    "0BSD": [" ".join((_ISC[0] + ".", _ISC[2]))],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
}
#: Names that an identifier line may give beside those above.
IDENTIFIERS = ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "WTFPL", "Artistic-2.0", "Python-2.0")
IDENTIFIER = "SPDX-License-Identifier: {}"

MARK = re.compile(rb"licen[cs]|copyright|permission|redistribut|warrant|spdx|creative commons|public domain|free software", re.I)
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Words around a mark that belong to its block, and the most that one block holds.
AROUND, BLOCK_WORDS = 120, 2000
#: Of a template's words, one in so many may differ.
DIFFER = 10
LEVEL = 9


@dataclass(frozen=True)
class Template:
    license: str
    number: int
    words: tuple[bytes, ...]
    compressor: zstandard.ZstdCompressor

    @property
    def most(self) -> int:
        """Words that may differ."""
        return len(self.words) // DIFFER

    def window(self, at: int) -> tuple[int, int]:
        """The words that the template may take where it begins at a place, give or take the differences."""
        return max(0, at - self.most), at + len(self.words) + self.most


@cache
def _templates() -> tuple[Template, ...]:
    out = []
    every = {name: [*TEMPLATES.get(name, ()), *([] if name == "BSD" else [IDENTIFIER.format(name)])] for name in (*TEMPLATES, *IDENTIFIERS)}
    for name, texts in every.items():
        for k, text in enumerate(texts):
            words = tuple(w.lower() for w in WORD.findall(text.encode()))
            raw = zstandard.ZstdCompressionDict(b" ".join(words), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            out.append(Template(name, k, words, zstandard.ZstdCompressor(level=LEVEL, dict_data=raw)))
    return tuple(out)


@cache
def _plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL)


def blocks(text: bytes) -> list[tuple[int, list[bytes]]]:
    """(number of its first word in the text, lower-cased words) of each candidate block."""
    marks = [m.start() for m in MARK.finditer(text)]
    if not marks:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    spans: list[list[int]] = []
    at = 0
    for mark in marks:
        while at < len(places) and places[at][1] <= mark:
            at += 1
        a, b = max(0, at - AROUND), min(len(places), at + AROUND)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    longest = max(len(t.words) for t in _templates())
    out = []
    for a, b in spans:
        while a < b:
            end = min(b, a + BLOCK_WORDS)
            out.append((a, [text[x:y].lower() for x, y in places[a:end]]))
            a = end if end == b else end - longest - longest // DIFFER
    return out


def weighed(template: Template, at: int, words: list[bytes]) -> tuple[int, int]:
    """(bytes saved, bytes with the template) of the window of about the template's length at a place."""
    first, end = template.window(at)
    window = b" ".join(words[first:end])
    size = len(template.compressor.compress(window))
    return len(_plain().compress(window)) - size, size


def rank(saved: int, size: int) -> float:
    """What a window's compression speaks for its template: the bytes saved, less half of those that the template leaves."""
    return saved - size / 2


def aligned(template: Template, words: list[bytes], at: int) -> tuple[int, int, list[dict]] | None:
    """(first word, end word, differences) of the template in its window at a place, if it differs little enough."""
    shift, end = template.window(at)
    window = words[shift:end]
    same = [m for m in SequenceMatcher(None, template.words, window, autojunk=False).get_matching_blocks() if m.size]
    if not same:
        return None
    a, b = same[0].b, same[-1].b + same[-1].size
    inner = SequenceMatcher(None, template.words, window[a:b], autojunk=False)
    differences, count = [], 0
    for kind, i, j, k, m in inner.get_opcodes():
        if kind != "equal":
            count += max(j - i, m - k)
            differences.append({"template": b" ".join(template.words[i:j]).decode(), "text": b" ".join(window[a:b][k:m]).decode("utf-8", "replace")})
    return (shift + a, shift + b, differences) if count <= template.most else None


def _places(template: tuple[bytes, ...], words: list[bytes], most: int, at: dict[bytes, list[int]]) -> list[int]:
    """Where the template may begin: with at most so many differences, one of its most + 1 parts is there word for word."""
    n, found = len(template), set()
    for k in range(most + 1):
        a, b = n * k // (most + 1), n * (k + 1) // (most + 1)
        part = list(template[a:b])
        for i in at.get(template[a], ()):
            if words[i : i + b - a] == part:
                found.add(max(0, i - a))
    return sorted(found)


def _positions(words: list[bytes]) -> dict[bytes, list[int]]:
    out: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(w, []).append(i)
    return out


def statements(words: list[bytes]) -> Iterator[dict]:
    """A block's statements by rank: windows by their compression, the first that wording confirms taken out of the words (left as gaps), and so on.

    A window that a statement was taken out of is weighed again.  Every window
    has its turn, so that what compression ranks low is not lost.
    """
    positions, templates = _positions(words), _templates()
    taken: list[tuple[int, int]] = []

    def entry(k: int, at: int) -> tuple:
        t = templates[k]
        saved, size = weighed(t, at, words)
        return (-rank(saved, size), -len(t.words), k, at, saved, size, len(taken))

    waiting = [entry(k, at) for k, t in enumerate(templates) for at in _places(t.words, words, t.most, positions)]
    heapify(waiting)
    while waiting:
        _, _, k, at, saved, size, known = heappop(waiting)
        template = templates[k]
        first, end = template.window(at)
        gone = [(a, b) for a, b in taken[known:] if a < end and first < b]
        if gone:
            if sum(min(b, at + len(template.words)) - max(a, at) for a, b in gone) <= 2 * template.most:
                heappush(waiting, entry(k, at))
        elif fit := aligned(template, words, at):
            a, b, differences = fit
            taken.append((a, b))
            words[a:b] = [b"\x00"] * (b - a)  # stays in place, so that later words keep their numbers
            yield {"license": template.license, "template": template.number, "first": a, "end": b, "saved": saved, "size": size, "differences": differences}


def scan(text: bytes) -> tuple[int, list[dict]]:
    """How many candidate blocks a text has, and its confirmed statements in order, without repeats where blocks overlap."""
    candidates, found = blocks(text), {}
    for start, words in candidates:
        for s in statements(words):
            s["first"], s["end"] = start + s["first"], start + s["end"]
            found.setdefault((s["first"], s["license"]), s)
    return len(candidates), [found[k] for k in sorted(found)]


def license_statements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_blocks, statements) of every row: statements as structs of license, template, first and end word, bytes saved, size and differences."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    difference = pa.struct([("template", pa.string()), ("text", pa.string())])
    statement = pa.struct([("license", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("end", pa.int64()), ("saved", pa.int32()), ("size", pa.int32()), ("differences", pa.list_(difference))])

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [scan(t) for t in texts_of(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(statement))], [id_col, "n_blocks", "statements"])

    schema = f"{quoted(id_col)} {kind}, n_blocks long, statements array<struct<license:string,template:int,first:long,end:long,saved:int,size:int,differences:array<struct<template:string,text:string>>>>"
    return map_arrow(docs.select(F.col(quoted(id_col)), text_or_empty(quoted(text_col)).alias("t")), of, schema)
