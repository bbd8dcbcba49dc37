"""License scans: winnowed fingerprints, an inverted index, banded alignment.

Templates are cut into hashes of ``K`` words; of each ``WINDOW`` consecutive
hashes the smallest is a fingerprint, so texts that share WINDOW + K - 1 words
in a row share a fingerprint. The templates' fingerprints form an inverted
index (fingerprint to template and position), whose size depends on the
templates alone. Documents are winnowed alike. Fingerprints found in the index
lie on diagonals (place in the text less place in the template); those of one
template that are near each other in the text and whose diagonals differ by at
most a band make a candidate, whose band reaches from the least to the greatest
diagonal and a quarter of the template (``BAND`` words at least, half of a short
template) beyond. In that
band the best local alignment (a word matched 1, a word left out of the text or
the template -``GAP``) gives the span, the longest common subsequence with the
span the matched words.

A row (doc_id, license, coverage, matched_words, start, end, complete) per
region; start and end are code points of the text; coverage is the share of the
template's words. A region is reported if it covers ``MIN_COVERAGE`` of its
template (complete), or in part if it has ``MIN_MATCHED`` matched words. Of
regions that overlap the one with most matched words stays, then the greater
coverage, then the first template by order, then the first place.

Defined cases: null, empty and word-less texts give no row; rows that repeat
give their rows again; texts are scanned whole, in memory that grows with the
text; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm.words import NOT_ALNUM, Piece, counts_of, grams, lcs_bits, pieces

K, WINDOW, BAND, GAP = 3, 3, 8, 0.2
MIN_COVERAGE, MIN_MATCHED = 0.8, 20
OUT = "doc_id long, license string, coverage double, matched_words int, start int, end int, complete boolean"

# Public license notices.
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "BSD-2-Clause": f"{_BSD_GRANT} {_BSD_DISCLAIMER}",
    "BSD-3-Clause": f"{_BSD_GRANT} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_DISCLAIMER}",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
}


def winnow(hashes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and their word positions. A text of k words or more has one at least."""
    g = grams(hashes, k)
    if len(g) <= window:
        at = np.array([int(g.argmin())]) if len(g) else np.zeros(0, np.int64)
        return g[at], at
    low = np.lib.stride_tricks.sliding_window_view(g, window).min(axis=1)
    keep = np.zeros(len(g), bool)
    for j in range(window):
        keep[j : len(g) - window + 1 + j] |= g[j : len(g) - window + 1 + j] == low
    at = np.flatnonzero(keep)
    return g[at], at


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words = [next(pieces([t], NOT_ALNUM)).hash for t in templates.values()]
        rows = sorted((int(f), t, int(p)) for t, w in enumerate(self.words) for f, p in zip(*winnow(w), strict=True))
        self.prints = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.at = np.array([r[2] for r in rows], np.int64)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.prints & np.uint64(0xFFFF)).astype(np.int64)] = True


@lru_cache(maxsize=4)
def _index(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


def _local(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, float]:
    """Where in template and text the best local alignment ends (words counted before there), and its score. Cells lie on
    diagonals (place in text less place in template) low to high; of equal scores the first."""
    at = np.arange(len(text) + 1)
    fall = GAP * at
    row, best = np.zeros(len(text) + 1), (0, 0, 0.0)
    for i in range(1, len(template) + 1):
        a, b = max(0, i + low), min(len(text), i + high) + 1  # cells of this row
        if a >= b:
            continue
        fresh = np.maximum(row[a:b] - GAP, 0)
        first = max(a, 1)
        match = text[first - 1 : b - 1] == template[i - 1]
        fresh[first - a :] = np.maximum(fresh[first - a :], np.where(match, row[first - 1 : b - 1] + 1, 0))
        fresh = np.maximum.accumulate(fresh + fall[a:b]) - fall[a:b]
        row = np.zeros(len(text) + 1)
        row[a:b] = fresh
        j = int(fresh.argmax())
        if fresh[j] > best[2] + 1e-9:
            best = (i, a + j, float(fresh[j]))
    return best


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Words matched in order, and the first and last + 1 word of text they lie on, of the best alignment in the band."""
    i, j, score = _local(template, text, low, high)
    if not score:
        return 0, 0, 0
    # Read backwards from the end, diagonal d becomes (j - text place) - (i - template place) = (j - i) - d.
    back_i, back_j, _ = _local(template[:i][::-1], text[:j][::-1], (j - i) - high, (j - i) - low)
    part, span = template[i - back_i : i], text[j - back_j : j]
    return lcs_bits(part.tolist(), span.tolist()), j - back_j, j


def _candidates(places: np.ndarray, diagonals: np.ndarray, n: int, band: int) -> Iterator[tuple[int, int]]:
    """(least, greatest diagonal) of the hits of one template of n words in one text; each hit is in one candidate."""
    order = np.lexsort((places, diagonals))
    places, diagonals = places[order], diagonals[order]
    a = 0
    for b in range(1, len(places) + 1):
        if b == len(places) or diagonals[b] - diagonals[b - 1] > band or diagonals[b] - diagonals[a] > n:
            yield int(diagonals[a]), int(diagonals[b - 1])
            a = b


def _scan(piece: Piece, index: Index, min_coverage: float) -> Iterator[tuple[int, str, float, int, int, int, bool]]:
    """(text's number, license, coverage, matched words, first byte, last byte + 1, complete)."""
    prints, at = winnow(piece.hash)
    hit = np.flatnonzero(index.sieve[(prints & np.uint64(0xFFFF)).astype(np.int64)])
    lo = np.searchsorted(index.prints, prints[hit], "left")
    times = np.searchsorted(index.prints, prints[hit], "right") - lo
    entry = np.repeat(lo, times) + counts_of(times)
    word = np.repeat(at[hit], times)
    doc = np.searchsorted(piece.of, word, "right") - 1
    template, diagonal = index.template[entry], word - index.at[entry]
    order = np.lexsort((word, template, doc))
    doc, template, word, diagonal = doc[order], template[order], word[order], diagonal[order]
    if not len(doc):
        return
    edge = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (template[1:] != template[:-1])))
    found: list[tuple[int, float, int, int, int, int]] = []
    for a, b in zip(edge, [*edge[1:], len(doc)], strict=True):
        d, t = int(doc[a]), int(template[a])
        words = index.words[t]
        band = max(min(BAND, len(words) // 2), len(words) // 4)  # copies of a short template side by side are far apart
        base, top = int(piece.of[d]), int(piece.of[d + 1])
        for least, greatest in _candidates(word[a:b], diagonal[a:b], len(words), band):
            first, last = max(base, least - band), min(top, greatest + len(words) + band)
            score, s, e = align(words, piece.hash[first:last], least - band - first, greatest + band - first)
            if score >= min(min_coverage * len(words), MIN_MATCHED):
                found.append((d, score / len(words), score, t, first + s, first + e))
    taken: dict[int, list[tuple[int, int]]] = {}
    for d, coverage, score, t, s, e in sorted(found, key=lambda x: (x[0], -x[2], -x[1], x[3], x[4])):
        if all(e <= a or s >= b for a, b in taken.setdefault(d, [])):
            taken[d].append((s, e))
            yield d, index.names[t], coverage, score, int(piece.start[s]), int(piece.end[e - 1]), coverage >= min_coverage


def scan_frames(batches: Iterable[pd.DataFrame], templates: dict[str, str], min_coverage: float) -> Iterator[pd.DataFrame]:
    index = _index(tuple(templates.items()))
    for batch in batches:
        out = []
        ids = batch["doc_id"].tolist()
        for piece in pieces(batch["text"].tolist(), NOT_ALNUM):
            for doc, name, coverage, score, a, b, complete in _scan(piece, index, min_coverage):
                begin = int(piece.begin[doc])
                point = lambda at, begin=begin, piece=piece: int(np.count_nonzero((piece.buf[begin:at] & 0xC0) != 0x80))
                out.append((ids[piece.first + doc], name, coverage, score, point(a), point(b), complete))
        yield pd.DataFrame(out, columns=["doc_id", "license", "coverage", "matched_words", "start", "end", "complete"])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    given = templates or TEMPLATES
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # pandas keeps text whole beside nulls
    return named.mapInPandas(lambda b: scan_frames(b, given, min_coverage), OUT.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))
