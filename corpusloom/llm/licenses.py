"""Operator 6: license scans by patience alignment.

A template is the words of a license notice. Where a text may hold one is found first, without loss: the words that a template
shares with the text have to make up the required coverage, so windows lie around each occurrence of the template's rarest
words and only windows with enough common words are aligned. What is found is taken out and the windows are read again, until
nothing more is found, so notices that follow each other do not hide each other. Alignment is patience diff: words that are
unique to both sides are anchors, the longest increasing subsequence of their places is kept, and the gaps between anchors
are aligned in the same way; a gap without anchors takes its equal words at both ends. Coverage is the share of the
template's words that are aligned.

A covered notice has its template's name only if the words that tell it from its neighbours are aligned too: all names and
versions, and over half of a condition that only it has. Otherwise it is a notice of some license that is not known here,
and is reported as ``unidentified`` where no notice with a name overlaps.

Words are lower case, without punctuation around them. Defined results: null, empty and word-less texts have no notices;
repeated rows are reported once each; null ids are reported like others; an empty table gives no rows; other columns are
ignored. A text with several notices gets a row for each; of overlapping notices the one with more aligned words stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text

#: Disclaimers and conditions that notices share.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_GNU = (("GPL-2.0", "General", "2"), ("GPL-3.0", "General", "3"), ("LGPL-2.1", "Lesser General", "2.1"), ("LGPL-3.0", "Lesser General", "3"), ("AGPL-3.0", "Affero General", "3"))
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
_CC_VERSIONS = (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International"))


def _gnu(name: str, kind: str, version: str) -> list[tuple[str, str]]:
    """Notices of a GNU license, for the version alone and for later ones."""
    free = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU"
    later = f"{free} {kind} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    only = f"{free} {kind} Public License version {version} as published by the Free Software Foundation."
    end = f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details. You should have received a copy of the GNU {kind} Public License along with this program. If not, see https://www.gnu.org/licenses/."
    line = f"This work is licensed under the GNU {kind} Public License, version {version}"
    return [(f"{name}-only", f"{line}."), (f"{name}-or-later", later), (f"{name}-or-later", f"{line} or later."), (f"{name}-only", f"Licensed under the GNU {kind} Public License, version {version}."), (f"{name}-only", only), (f"{name}-or-later", f"{later} {end}"), (f"{name}-only", f"{only} {end}")]


def _cc(kind: str, long: str) -> list[tuple[str, str]]:
    lines = [(f"CC-{kind}-{v}", f"Licensed under CC {kind} {v}.") for v, _ in _CC_VERSIONS]
    return lines + [(f"CC-{kind}-{v}", f"This work is licensed under the Creative Commons {long} {v} {port} License.") for v, port in _CC_VERSIONS]


#: Whole notices in common use, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MIT-0", f"{_MIT}. {_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_ENDORSE} {_BSD_END}"),
    ("BSD-4-Clause", f"{_BSD} {_ADVERTISING} {_ENDORSE} {_BSD_END}"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_END}"),
    ("ISC", "Released under the ISC License."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("reserved", "All rights reserved."),
    *(t for args in _GNU for t in _gnu(*args)),
    *(t for args in _CC for t in _cc(*args)),
)
#: Words that tell a license from its neighbours, besides versions: names, and conditions that only some of them have.
TELLING = frozenset("apache mit bsd 2-clause 3-clause isc mozilla gnu general lesser affero later creative cc cc0 reserved".split()) | {w.lower() for pair in _CC for w in pair}
CONDITIONS = ("shall be included in all copies or substantial portions", "may be used to endorse or promote products derived from", "all advertising materials mentioning features or use of", "notice and this permission notice appear in all copies")
UNIDENTIFIED = "unidentified"
_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„…"


def words_of(text: str | None) -> list[str]:
    """Words in lower case without punctuation around them; a word of punctuation alone is an empty string and matches nothing."""
    return [w.strip(_PUNCT) for w in (text or "").lower().split()]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], both increasing."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        count_a, count_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if w and count_b[w] == 1 and count_a[w] == 1}
        pairs = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place]
        anchors = longest_increasing(pairs)
        if not anchors:
            continue
        found += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)]):
            if i + 1 < k and j + 1 < m:
                todo.append((i + 1, k, j + 1, m))
    return sorted(found)


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, in the order of their first places, with increasing second places (patience sorting)."""
    tops: list[int] = []
    top_of: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        back.append(top_of[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(j)
            top_of.append(k)
        else:
            tops[pile], top_of[pile] = j, k
    out, k = [], top_of[-1] if top_of else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


class Scanner:
    """Templates as words; each is looked for at the words of which fewest texts have many."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        self.least = least
        self.names = [name for name, _ in templates]
        self.words = [[w for w in words_of(t) if w] for _, t in templates]
        self.counts = [Counter(w) for w in self.words]
        self.spots: list[dict[str, list[int]]] = [defaultdict(list) for _ in self.words]
        for spots, words in zip(self.spots, self.words):
            for i, w in enumerate(words):
                spots[w].append(i)
        self.telling = [self._telling(w) for w in self.words]
        spread = Counter(w for c in self.counts for w in c)
        self.keys: dict[str, list[int]] = defaultdict(list)
        for k, words in enumerate(self.words):
            # a covered template lacks at most n - ceil(least * n) words, so one of any n - ceil(least * n) + 1 places is there
            need = len(words) - self.needed(k) + 1
            order = sorted(range(len(words)), key=lambda i: (len(words[i]) < 4, spread[words[i]], -len(words[i]), i))
            for w in {words[i] for i in order[:need]}:
                self.keys[w].append(k)

    @staticmethod
    def _telling(words: list[str]) -> list[tuple[list[int], int]]:
        """Places, and how many of them have to be aligned."""
        at: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in TELLING or w.replace(".", "", 1).isdigit():
                at[w].append(i)
        out = [(places, 1) for places in at.values()]
        for phrase in map(str.split, CONDITIONS):
            for i in range(len(words) - len(phrase) + 1):
                if words[i : i + len(phrase)] == phrase:
                    out.append((list(range(i, i + len(phrase))), len(phrase) // 2 + 1))
        return out

    def named(self, k: int, pairs: list[tuple[int, int]]) -> bool:
        aligned = {i for i, _ in pairs}
        return all(len(aligned.intersection(places)) >= least for places, least in self.telling[k])

    def needed(self, k: int) -> int:
        n = len(self.words[k])
        return max(1, -int(-self.least * n // 1))

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, int]]:
        """(name, first word, last word + 1, aligned words, template words) of each notice, in the order of the text."""
        words = words_of(text)
        if self.keys.keys().isdisjoint(words):
            return []
        taken: list[tuple[str, int, int, int, int]] = []
        named = True
        while found := self._round(words):
            before = len(taken)
            found.sort(key=lambda f: (-f[3], -f[3] / f[4], f[1], f[0]))
            for f in found:
                if (f[0] != UNIDENTIFIED) == named and all(words[i] for i in (f[1], f[2] - 1)) and all(f[2] <= t[1] or f[1] >= t[2] for t in taken):
                    taken.append(f)
                    words[f[1] : f[2]] = [""] * (f[2] - f[1])
            if len(taken) == before:  # what is left overlaps or has no name; the unnamed come when all named are taken
                if not named:
                    break
                named = False
        return sorted(taken, key=lambda f: f[1])

    def _round(self, words: list[str]) -> list[tuple[str, int, int, int, int]]:
        """Notices in windows around the key words that are left."""
        places: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            for k in self.keys.get(w, ()):
                places[k].append(i)
        found = []
        present = set(words)
        for k, at in places.items():
            template, n, need = self.words[k], len(self.words[k]), self.needed(k)
            if sum(c for w, c in self.counts[k].items() if w in present) < need:
                continue
            slack = n // 2 + 2
            windows = {(max(0, i - p - slack), i - p + n + slack) for i in at for p in self.spots[k][words[i]]}
            for low, high in sorted(windows):
                part = words[low:high]
                if sum((Counter(part) & self.counts[k]).values()) < need:
                    continue
                pairs = self._dense(patience(template, part), n)
                if len(pairs) >= need:
                    found.append((self.names[k] if self.named(k, pairs) else UNIDENTIFIED, low + pairs[0][1], low + pairs[-1][1] + 1, len(pairs), n))
        return found

    @staticmethod
    def _dense(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
        """The longest part of an alignment without a gap of over half the template in the text."""
        best, start = [], 0
        for k in range(1, len(pairs) + 1):
            if k == len(pairs) or pairs[k][1] - pairs[k - 1][1] > n // 2 + 2:
                if k - start > len(best):
                    best = pairs[start:k]
                start = k
        return best


def _scan(batches, templates, least: float):
    scanner = Scanner(templates, least)
    for batch in batches:
        rows = [(k, *f) for k, text in enumerate(batch.column(1)) for f in scanner.scan(text.as_py())]
        cols = list(zip(*rows)) if rows else [[]] * 6
        coverage = [a / n for a, n in zip(cols[4], cols[5])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(coverage, pa.float64())],
            names=["doc_id", "license", "first_word", "end_word", "aligned", "coverage"],
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """(doc_id, license, first_word, end_word, aligned, coverage) of each notice in each row's whole text."""
    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_scan, templates=templates, least=least), f"doc_id {kind}, license string, first_word int, end_word int, aligned int, coverage double")
