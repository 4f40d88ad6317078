"""License scan by patience alignment against templates.

Words unique to both sides anchor the alignment; the longest increasing
subsequence of the anchors is kept and the gaps between are aligned in the same
way.  Coverage is the share of a template's words that the alignment matches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches
from .textkernel import Words, slices, utf8

# Texts of public licenses and of the notices that stand for one.
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GNU = (
    "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. "
    "{} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
)
TEMPLATES = {
    "MIT": f"{_MIT_GRANT} {_MIT_WARRANTY}",
    "MIT-grant": _MIT_GRANT,
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0": _GNU.format("This program", "General Public License", "2", "This program", "General Public License").replace("software: you", "software; you"),
    "GPL-3.0": _GNU.format("This program", "General Public License", "3", "This program", "General Public License"),
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": _GNU.format("This library", "Lesser General Public License", "2.1", "This library", "Lesser General Public License"),
    "LGPL-3.0": _GNU.format("This program", "Lesser General Public License", "3", "This program", "Lesser General Public License"),
    "AGPL-3.0": _GNU.format("This program", "Affero General Public License", "3", "This program", "Affero General Public License"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "BSD-2-Clause": f"{_BSD_CONDITIONS} {_BSD_WARRANTY}",
    "BSD-3-Clause": f"{_BSD_CONDITIONS} {_BSD_NAMES} {_BSD_WARRANTY}",
    "BSD-conditions": _BSD_CONDITIONS,
    "ISC": f"{_ISC_GRANT} {_ISC_WARRANTY}",
    "ISC-grant": _ISC_GRANT,
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
#: Versions and variants of one family share most of their words; of these the one
#: with most words aligned counts, of equals the one covered best.
FAMILIES = (("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"), ("BSD-3-Clause", "BSD-2-Clause", "BSD-conditions"), ("MIT", "MIT-grant"), ("ISC", "ISC-grant"), ("CC-BY-SA-4.0", "CC-BY-4.0"))
THRESHOLD = 0.8
_TO_SPACE = np.arange(256, dtype=np.uint8)
_TO_SPACE[[c for c in range(33, 127) if not chr(c).isalnum()]] = 0x20


def _words(column: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text, in lower case, ASCII punctuation as space."""
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        words = Words(_TO_SPACE[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], lower=True)
        for i in range(b - a):
            yield words.hash[words.row_words[i] : words.row_words[i + 1]]


def _once(words: list) -> dict:
    """Places of the words that occur once."""
    seen: dict = {}
    for i, w in enumerate(words):
        seen[w] = -1 if w in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first, that increases in the second."""
    tops: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        if at == len(tops):
            tops.append(y)
            last.append(k)
        else:
            tops[at], last[at] = y, k
        back.append(last[at - 1] if at else -1)
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(left: list, right: list) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and left[a] == right[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        x, y = _once(left[a:b]), _once(right[c:d])
        anchors = _increasing(sorted((a + i, c + y[w]) for w, i in x.items() if w in y))
        at, ct = a, c
        for i, j in anchors:
            out.append((i, j))
            todo.append((at, i, ct, j))
            at, ct = i + 1, j + 1
        if anchors:
            todo.append((at, b, ct, d))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str]):
        names = sorted(templates)
        words = list(_words(pa.array([templates[n] for n in names], pa.string())))
        self.templates = [(n, w.tolist(), np.unique(w)) for n, w in zip(names, words, strict=True) if len(w)]
        self.size = {n: len(t) for n, t, _ in self.templates}
        self.families = FAMILIES
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.empty(0, np.uint64)

    def scan(self, words: np.ndarray) -> Iterator[tuple[str, float, int, int]]:
        """(license, coverage, first word, word after the last) of each template's best place."""
        if not len(words) or not len(self.vocabulary):
            return
        found: dict[str, tuple[float, int, int]] = {}
        near = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[near] == words)
        present = np.unique(words[known])
        for name, template, distinct in self.templates:
            m = len(template)
            # Words that the text lacks cannot be covered.
            if np.isin(template, present).sum() < THRESHOLD * m:
                continue
            best = (0.0, 0, 0)
            own = known[np.isin(words[known], distinct)]
            # Windows of three times the template, a half template apart: a copy that is
            # spread over up to two and a half times its words lies whole in one.
            half = max(m // 2, 1)
            starts = np.maximum(np.unique(own // half)[:, None] - np.arange(6), 0) * half
            for start in np.unique(starts).tolist():
                window = words[start : start + 3 * m]
                if np.isin(template, window).sum() < THRESHOLD * m:
                    continue
                pairs = align(template, window.tolist())
                if pairs:
                    best = max(best, (len(pairs) / m, start + pairs[0][1], start + pairs[-1][1] + 1))
            if best[0] >= THRESHOLD:
                found[name] = best
        for family in self.families:
            rivals = [n for n in family if n in found]
            keep = max(rivals, key=lambda n: (round(found[n][0] * self.size[n]), found[n][0]), default=None)
            for n in rivals:
                # The same place only: a text may hold two licenses of a family.
                if n != keep and found[n][1] < found[keep][2] and found[keep][1] < found[n][2]:
                    del found[n]
        for name in sorted(found):
            yield name, *found[name]


def licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, coverage, first_word, end_word): every document and
    template with THRESHOLD of its words aligned, at the best place.  Words are
    counted over the whole text.  Of licenses of one family at one place the best
    aligned is given.  Null and empty texts match nothing; repeated rows give
    repeated rows."""
    bound_batches(docs.sparkSession)
    chosen = TEMPLATES if templates is None else templates

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        for batch in batches:
            found: list[list] = [[], [], [], [], []]
            for doc_id, words in zip(batch.column(0).to_pylist(), _words(batch.column(1)), strict=True):
                for match in scanner.scan(words):
                    for column, value in zip(found, (doc_id, *match), strict=True):
                        column.append(value)
            kinds = (batch.column(0).type, pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, kinds, strict=True)], ["doc_id", "license", "coverage", "first_word", "end_word"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, license string, coverage double, first_word bigint, end_word bigint")
