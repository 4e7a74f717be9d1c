"""Licence scans by the Dice coefficient over word bigrams.

A text is normalised (lower case, words of letters and digits) and compared
with licence templates: 2 * common / (bigrams of one + bigrams of the other),
over sets.  Compared is every run of words of the text, so that a notice is found
inside a line, over several lines or in a long document; texts, paragraphs,
lines and sentences are runs.  A run that begins or ends with a bigram of no
template gains by losing it, so only runs between shared bigrams are tried.  A
run reaches t only if it shares t / (2 - t) of a template's bigrams and has at
most (2 - t) / t of their number: a template that shares fewer with the whole text
is left out, and so is each start after which fewer are in reach.  Starts are
tried by the best coefficient they could give, until none is above what was found.
Any choice of over 1 - t / (2 - t) of a template's bigrams has one that appears
in whatever reaches t: a text without a word of the choice (those with the
longest words) has no licence and is not compared.

A place names one licence: of two runs that share over half of the longer one's
words the better counts, and a run of which over half of the shared bigrams are
shared by a longer run of another licence too is part of that one (BSD-3-Clause
holds the conditions of BSD-2-Clause).  The other template is then sought before
and after it.

The full texts are in ``license_texts``; the CC BY family has notices only.

Defined cases: a null text counts as empty and has no licence; of equal
coefficients the template first by name wins; repeated rows are repeated; an empty table
gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import slices
from quarry.runtime import column

THRESHOLD = 0.8
WORDS = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?;])\s+(?=[A-Z])")

_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
    " conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the"
    " following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and"
    " the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"
    " from this software without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT'
    " NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL"
    " THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
    " (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS"
    " INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE"
    " OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
]
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files'
    ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,'
    " merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
    " furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be"
    " included in all copies or substantial portions of the Software."
)
_MIT_END = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF'
    " MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE"
    " FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
    " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
    " that the above copyright notice and this permission notice appear in all copies."
)
_ISC_END = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED'
    " WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR"
    " CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,"
    " NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any"
    " damages arising from the use of this software."
)
_ZLIB_END = (
    " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and"
    " redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you"
    " must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product"
    " documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be"
    " misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)


def _full(name: str) -> str:
    return pkgutil.get_data("quarry.llm", f"license_texts/{name}.txt").decode()


def _affero() -> str:
    """The full AGPL-3.0: the text of GPL-3.0 with a preamble and a section 13 of its own, under its own name."""
    gpl, preamble, section = _full("GPL-3.0"), _full("AGPL-3.0-preamble"), _full("AGPL-3.0-section-13")
    head, terms = gpl[: gpl.index("Preamble")], gpl[gpl.index("TERMS AND CONDITIONS") :]
    before, after = terms[: terms.index("  13. Use with")], terms[terms.index("  14. Revised Versions") :]
    named = [x.replace("GENERAL PUBLIC", "AFFERO GENERAL PUBLIC").replace("GNU General", "GNU Affero General") for x in (head, before, after)]
    return f"{named[0]}Preamble\n\n{preamble}\n{named[1]}{section}{named[2]}"


def _gnu(kind: str, version: int) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as"
        f" published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )


#: Public licence texts and the notices by which they are named.
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", _gnu("Affero ", 3), _affero()],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed"
        ' to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF'
        " ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the"
        " License.",
        _full("Apache-2.0"),
    ],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        _BSD[0],
        f"{_BSD[0]} {_BSD[2]}",
    ],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", " ".join(_BSD)],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal.", _full("CC0-1.0")],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", _gnu("", 2), _full("GPL-2.0")],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        _gnu("", 3),
        _full("GPL-3.0"),
    ],
    "ISC": [_ISC, _ISC + _ISC_END],
    "LGPL-2.0": ["This work is licensed under the GNU Library General Public License, version 2.", _full("LGPL-2.0")],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", _full("LGPL-2.1")],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", _gnu("Lesser ", 3), _full("LGPL-3.0")],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        _MIT,
        _MIT + _MIT_END,
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with"
        " this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        _full("MPL-2.0"),
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", _full("Unlicense")],
    "Zlib": [_ZLIB, _ZLIB + _ZLIB_END],
}


#: ASCII letters and digits in lower case, all other bytes to a space.
_WORD_BYTES = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256))


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    words = WORDS.findall(text.lower())
    return frozenset(zip(words, words[1:]))


class Matcher:
    """Templates by size, ready for comparison."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold, ratio = threshold, threshold / (2 - threshold)
        self.named = sorted(((n, g) for n, texts in templates.items() for t in texts if (g := bigrams(t))), key=lambda x: (x[0], len(x[1])))
        # the tolerance keeps runs at the threshold itself; the Dice test decides
        self.least = [math.ceil(ratio * len(g) - 1e-9) for _, g in self.named]
        self.most = [int(len(g) / ratio + 1e-9) for _, g in self.named]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for k, (_, grams) in enumerate(self.named):
            for gram in grams:
                self.holders.setdefault(gram, []).append(k)
        anchors = set()
        for _, grams in self.named:
            longest = sorted(grams, key=lambda b: (-max(map(len, b)), b))
            for gram in longest[: int((1 - ratio) * len(grams) + 1e-9) + 1]:
                anchors.add(max(gram, key=lambda w: (len(w), w)))
        self.anchors = frozenset(anchors)
        self.anchor_bytes = frozenset(w.encode() for w in anchors)

    def possible(self, text: str) -> bool:
        """Whether a text has an anchor word; without one, no part of it reaches the threshold."""
        if "\u212a" in text or "\u0130" in text:  # their lower case has ASCII letters
            return True
        return not self.anchor_bytes.isdisjoint(text.encode("utf-8", "replace").translate(_WORD_BYTES).split())

    def runs(self, text: str) -> list[tuple[float, str, int, int]]:
        """The templates that a text holds: ``(dice, name, first word, last word)`` of each place found."""
        if not self.possible(text):
            return []
        words = WORDS.findall(text.lower())
        grams = list(zip(words, words[1:]))
        shared = Counter(k for gram in dict.fromkeys(grams) for k in self.holders.get(gram, ()))
        chosen = sorted(k for k, n in shared.items() if n >= self.least[k])
        if not chosen:
            return []
        numbers: dict[tuple[str, str], int] = {}
        ids = np.array([numbers.setdefault(g, len(numbers)) for g in grams])
        searches = [_Search(self.named[k], self.least[k], self.most[k], self.threshold, ids, numbers) for k in chosen]
        found = []
        for search in searches:
            others = [o for o in searches if o.name != search.name]
            todo = [(0, len(ids))]
            while todo:
                lo, hi = todo.pop()
                if not (run := search.best(lo, hi)):
                    continue
                if rival := self._rival(search, run, others, len(ids)):
                    todo += [(lo, rival[1]), (rival[2], hi)]
                else:
                    found.append((run[0], search.name, run[1], run[2]))
        return found

    @staticmethod
    def _rival(search: _Search, run: tuple[float, int, int], others: list[_Search], n: int) -> tuple[float, int, int] | None:
        """A run of another licence that takes this one's place."""
        dice, start, end = run
        for other in others:
            margin = max(end - start, 2 * other.most)
            todo = [(max(0, start - margin), min(n, end + margin))]
            while todo:
                lo, hi = todo.pop()
                if hi <= start or lo >= end or not (mine := other.best(lo, hi)):
                    continue
                size = mine[2] - mine[1]
                overlap = min(end, mine[2]) - max(start, mine[1])
                if 2 * overlap > max(end - start, size):
                    if (-mine[0], other.name) < (-dice, search.name):
                        return mine
                elif overlap > 0 and size > end - start:
                    shared = np.flatnonzero(search.hit[start:end]) + start
                    inside = shared[(shared >= mine[1]) & (shared < mine[2])]
                    if 2 * np.count_nonzero(other.hit[inside]) > len(shared):
                        return mine
                todo += [(lo, mine[1]), (mine[2], hi)]
        return None

    def scan(self, text: str) -> list[tuple[str, float]]:
        """The templates that a text holds with their best coefficients, best first."""
        best: dict[str, float] = {}
        for dice, name, _, _ in self.runs(text):
            best[name] = max(best.get(name, 0), dice)
        return sorted(best.items(), key=lambda x: (-x[1], x[0]))


class _Search:
    """The runs of one text that reach one template. Positions are those of bigrams."""

    def __init__(self, named: tuple[str, frozenset], least: int, most: int, threshold: float, ids: np.ndarray, numbers: dict):
        self.name, grams = named
        self.size, self.most, self.threshold = len(grams), most, threshold
        known = np.zeros(len(numbers), bool)
        known[[numbers[g] for g in grams if g in numbers]] = True
        self.hit = known[ids]
        order = np.argsort(ids, kind="stable")
        same = ids[order[1:]] == ids[order[:-1]]
        self.before = np.full(len(ids), -1)
        self.before[order[1:][same]] = order[:-1][same]
        # from each start: the first position at which a run is too large, and the template's bigrams in reach
        ends, reach = np.zeros(len(ids), int), np.zeros(len(ids), int)
        counts, hits, end, distinct, common = [0] * len(numbers), known.tolist(), 0, 0, 0
        numbered = ids.tolist()
        for start, leaving in enumerate(numbered):
            while end < len(numbered) and (counts[numbered[end]] or distinct < most):
                gram = numbered[end]
                if not counts[gram]:
                    distinct += 1
                    common += hits[gram]
                counts[gram] += 1
                end += 1
            ends[start], reach[start] = end, common
            counts[leaving] -= 1
            if not counts[leaving]:
                distinct -= 1
                common -= hits[leaving]
        starts = np.flatnonzero(self.hit & (reach >= least))
        self.starts = starts[np.lexsort((-starts, -reach[starts]))]
        self.ends, self.reach = ends, reach

    def best(self, lo: int, hi: int) -> tuple[float, int, int] | None:
        """``(dice, start, end)`` of the best run between two positions."""
        found = None
        for start in self.starts[(self.starts >= lo) & (self.starts < hi)].tolist():
            top = int(self.reach[start])
            if found and 2 * top / (top + self.size) <= found[0]:
                break
            end = min(int(self.ends[start]), hi)
            new = self.before[start:end] < start
            dice = 2 * np.cumsum(new & self.hit[start:end]) / (np.cumsum(new) + self.size)
            k = int(np.argmax(dice))
            if dice[k] >= self.threshold and (found is None or dice[k] > found[0]):
                found = (float(dice[k]), start, start + k + 1)
        return found


@cache
def _matcher() -> Matcher:
    return Matcher()


def units(text: str) -> Iterator[str]:
    """The whole text, its paragraphs, its lines, the sentences of its lines, and
    the runs of words (in lower case) that reach a template."""
    yield text
    lines, paragraph = text.split("\n"), []
    for line in [*lines, ""]:
        if line.strip():
            paragraph.append(line)
            continue
        if len(paragraph) > 1:
            yield "\n".join(paragraph)
        paragraph = []
    for line in lines:
        yield line
        parts = SENTENCE.split(line)
        if len(parts) > 1:
            yield from parts
    if runs := _matcher().runs(text):
        low = text.lower()
        spans = [m.span() for m in WORDS.finditer(low)]
        for _, _, first, last in runs:
            yield low[spans[first][0] : spans[last][1]]


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """A row for each document: ``license`` (the best, or null), ``dice``, and
    ``licenses``, all that reach the threshold."""
    slim = docs.select(column(id_col).alias("id"), column(text).alias("text"))
    schema = f"id {dict(slim.dtypes)['id']}, license string, dice double, licenses array<struct<name:string,dice:double>>"
    hits = pa.list_(pa.struct([("name", pa.string()), ("dice", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates, threshold)
        for batch in (p for b in batches for p in slices(b, 1)):
            found = [matcher.scan(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([f[0][0] if f else None for f in found], pa.string()),
                    pa.array([f[0][1] if f else None for f in found], pa.float64()),
                    pa.array([[{"name": n, "dice": d} for n, d in f] for f in found], hits),
                ],
                ["id", "license", "dice", "licenses"],
            )

    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    found = find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array_join(F.transform("licenses", lambda x: x["name"]), ",")
    return found.select("doc_id", "license", F.round("dice", 6).alias("dice"), names.alias("licenses"))
