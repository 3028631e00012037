"""License scans (operator 5): an inverted index of winnowed template fingerprints, then banded alignment.

Templates are winnowed as in published document fingerprinting: of the hashes of
``GRAM`` words the smallest of every ``WINDOW`` in a row is kept. The inverted
index maps a fingerprint to the templates and places that have it. A document's
fingerprints pick candidates: places where a template may stand. There it is
aligned with the document's words by dynamic programming within a band around
the place, as wide as an alignment can stray; a match reports how much of the
template was found, and where, and what lies beside it is looked at again.
Short templates also have so many
single words in the index that every match shares one.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import common

GRAM, WINDOW = 3, 2
#: Templates of fewer words are also found by single words; in longer ones with a fifth of the words changed four in a row are left.
SHORT = 20
#: Half the width of the band at least.
BAND = 4
#: The share of a template's words that a match must have.
COVERAGE = 0.8
#: Bytes of templates that may be sent to every task.
TEMPLATE_BYTES = 16 << 20

#: Public licence texts and the notices by which works are put under a licence.
TEMPLATES = {
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-line": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-line": "Released under the MIT License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

_WORD = re.compile(r"[^\W_]+")


def word_spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The lower-cased words of a text and their spans in code points."""
    words, spans = [], []
    for m in _WORD.finditer(text):
        words.append(m[0].lower())
        spans.append(m.span())
    return words, spans


def _hashes(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64)


def fingerprints(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the winnowed gram hashes; fewer grams than a window give their smallest."""
    take = min(GRAM, len(h))
    if not take:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(h) - take + 1
    grams = np.full(n, take, np.uint64)
    for j in range(take):
        grams = (grams ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(29)
    w = min(WINDOW, n)
    windows = np.lib.stride_tricks.sliding_window_view(grams, w)
    at = np.unique(np.argmin(windows, axis=1) + np.arange(len(windows)))
    return at, grams[at]


def align(template: np.ndarray, words: np.ndarray, band: int) -> tuple[int, int, int, int, int]:
    """The best alignment of a template with a stretch of a document.

    ``words`` are the document's, the template's first word expected at index
    ``band``; only pairs within ``band`` of the diagonal are compared. Gives the
    number of equal words, and the first and last equal place in the template
    and in ``words``. A pair of equal words gains 2; a word of the document
    that the template has not costs 1, so that far-off chance pairs are left
    out; a word of the template that is left out costs nothing, as coverage
    counts it. Of equal scores the earliest end counts.
    """
    width = 2 * band + 1
    at = np.arange(width)
    padded = np.concatenate([words, np.zeros(max(0, len(template) + width - len(words)), words.dtype)])
    inside = len(words)
    best, where = 0, (0, 0, 0, 0, 0)
    # of each cell of the row above: score, equal words, and the first equal places
    score, equal, fi, fj = np.zeros(width, np.int64), np.zeros(width, np.int64), np.full(width, -1), np.full(width, -1)
    for i, word in enumerate(template):
        same = (padded[i : i + width] == word) & (at + i < inside)
        s = np.where(same, score + 2, score - 1)
        k, f, g = equal + same, np.where(same & (equal == 0), i, fi), np.where(same & (equal == 0), at + i, fj)
        # the template's word left out: from the cell of the row above at the same word of the document
        up = np.append(score[1:], -1)
        over = up > s
        s, k, f, g = np.where(over, up, s), np.where(over, np.append(equal[1:], 0), k), np.where(over, np.append(fi[1:], -1), f), np.where(over, np.append(fj[1:], -1), g)
        none = s < 0
        s, k, f, g = np.where(none, 0, s), np.where(none, 0, k), np.where(none, -1, f), np.where(none, -1, g)
        # words of the document put in: the best cell to the left, less one for each word; of equal ones the nearest
        source = np.maximum.accumulate((s + at) * width + at) % width
        score, equal, fi, fj = s[source] - (at - source), k[source], f[source], g[source]
        top = int(np.argmax(np.where(source == at, score, -1)))
        if score[top] > best:
            best, where = int(score[top]), (int(equal[top]), int(fi[top]), i, int(fj[top]), top + i)
    return where


class TemplateIndex:
    """The inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.names, self.words = [], []
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        single: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, text in sorted(templates.items()):
            words = word_spans(text)[0]
            h = _hashes(words)
            if not len(h):
                continue
            for at, value in zip(*(x.tolist() for x in fingerprints(h)), strict=True):
                places[value].append((len(self.names), at))
            if len(h) < SHORT:
                # a match lacks at most so many words that one of these is in it; longer ones are rarer
                lacking = len(h) - math.ceil(coverage * len(h) - 1e-9)
                for at in sorted(range(len(h)), key=lambda i: -len(words[i]))[: lacking + 1]:
                    single[int(h[at])].append((len(self.names), at))
            self.names.append(name)
            self.words.append(h)
        self.places = dict(places)
        self._sorted = np.array(sorted(places), dtype=np.uint64)
        self.single = dict(single)
        self._words = np.array(sorted(single), dtype=np.uint64)

    def candidates(self, h: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each template the places in the text of its fingerprints and single words, each with the expected place of its first word."""
        found: dict[int, set[tuple[int, int]]] = defaultdict(set)
        if len(self._words):
            hit = np.flatnonzero(self._words[np.minimum(np.searchsorted(self._words, h), len(self._words) - 1)] == h)
            for p in hit.tolist():
                for t, q in self.single[int(h[p])]:
                    found[t].add((p, p - q))
        at, values = fingerprints(h)
        if len(at) and len(self._sorted):
            i = np.minimum(np.searchsorted(self._sorted, values), len(self._sorted) - 1)
            hit = self._sorted[i] == values
            for p, v in zip(at[hit].tolist(), values[hit].tolist(), strict=True):
                for t, q in self.places[v]:
                    found[t].add((p, p - q))
        return {t: sorted(places) for t, places in found.items()}

    def band(self, t: int) -> int:
        """As far as an alignment of the template can leave its diagonal: what is put in costs less than what it joins gains."""
        return max(BAND, 2 * len(self.words[t]))

    def _found(self, t: int, h: np.ndarray, places: list[tuple[int, int]], coverage: float) -> Iterator[tuple[int, int, int, int, int, int]]:
        """The matches of a template, which do not overlap. Around each place the best alignment is taken, then what is left on both sides of it."""
        n, band = len(self.words[t]), self.band(t)
        taken: list[tuple[int, int]] = []  # ascending, from and to
        tried: tuple[int, int, int] | None = None
        for p, d in places:
            while True:
                i = bisect.bisect(taken, (p, len(h)))
                low = taken[i - 1][1] if i else 0
                high = taken[i][0] if i < len(taken) else len(h)
                if p < low or tried is not None and tried[:2] == (low, high) and abs(tried[2] - d) <= band // 2:
                    break  # in a match, or seen from a place near by, whose band reaches far enough beyond it
                begin = max(low, d - band)
                pad = np.zeros(max(0, begin - (d - band)), np.uint64)  # places before the text, or in a match, equal nothing
                stretch = np.concatenate([pad, h[begin : min(high, d + n + band)]])
                equal, first, last, x, y = align(self.words[t], stretch, band)
                if equal < max(1, coverage * n):
                    tried = (low, high, d)
                    break
                shift = begin - len(pad)
                yield t, equal, x + shift, y + shift, first, last
                bisect.insort(taken, (x + shift, y + shift + 1))

    def matches(self, text: str | None, coverage: float) -> list[tuple[str, float, int, int, int, int, int]]:
        """name, coverage, equal words, span in the text (code points), span in the template (words) of all matches."""
        words, spans = word_spans(text) if text else ([], [])
        if not words:
            return []
        h = _hashes(words)
        found = {m for t, places in self.candidates(h).items() for m in self._found(t, h, places, coverage)}
        # of overlapping matches the one with the most equal words stays
        kept: list[tuple] = []
        for m in sorted(found, key=lambda m: (-m[1], -m[1] / len(self.words[m[0]]), m[2], m[0])):
            if all(m[3] < k[2] or m[2] > k[3] for k in kept):
                kept.append(m)
        return [(self.names[t], equal / len(self.words[t]), equal, spans[x][0], spans[y][1], first, last + 1) for t, equal, x, y, first, last in sorted(kept, key=lambda m: m[2])]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """All matches of licence templates in ``docs`` (doc_id, text), a row each.

    Columns: doc_id, license, coverage (share of the template's words), matched
    (their number), start and end in the text (code points), template_start and
    template_end (words). Of matches that overlap in a document, the one with the
    most words stays. Whole texts are scanned; null and empty ones and those
    without words have no match, and templates without words match nothing.
    Words changed or left out anywhere, in one run or in many, leave a match as
    long as coverage holds; so does a run of words put in that is shorter than
    twice the template's words on either side of it. Ties go to the earliest.
    Repeated rows give repeated matches; extra columns are left out; an empty
    table gives no rows. Templates beyond TEMPLATE_BYTES are refused, as every
    task holds their index.
    """
    templates = TEMPLATES if templates is None else templates
    if sum(len(t.encode()) for t in templates.values()) > TEMPLATE_BYTES:
        raise ValueError("too many templates for every task to hold")
    sent = docs.sparkSession.sparkContext.broadcast(templates)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("template_start", pa.int64()), ("template_end", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(sent.value, coverage)
        for b in batches:
            rows = [(doc_id, *m) for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True) for m in index.matches(text.as_py(), coverage)]
            if rows:
                yield common.batch(schema, *zip(*rows, strict=True))

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(work, "doc_id long, license string, coverage double, matched long, start long, end long, template_start long, template_end long")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of the public licence texts in all documents."""
    return scan(common.table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op5_license_scan": op5_license_scan}
ORACLE_SQL: dict[str, str] = {}
