"""Licence scan: Dice coefficient over word bigrams of normalised text against licence templates.

Normalisation: A-Z lower-cased, everything but a-z and 0-9 a space. A template and a segment are compared as
sets of word bigrams by Dice = 2 |A and B| / (|A| + |B|). Segments of a document are its lines, its paragraphs
(between blank lines) and the whole text, where the latter differ from the former; so a notice on a line of
its own, a licence in a paragraph and a file that is a licence are all found.

Runs. A notice of several paragraphs, or one that shares its line with prose, is no segment. So all stretches of
a text's words are compared too: of those that match, the one of highest score (then the shortest, the first, the
first template's) is a run; then the best that shares no word with it, and so on. A run inside a segment that
matched is that segment's finding and is not repeated. The best stretch from a word on is found by counting, up to
each end, the bigrams that are new since its start; one that ends or starts with a bigram the template lacks is
never the best, so only a template's own bigrams start one, and only where the text has t / (2 - t) of them at all.

Size bounds. Dice >= t needs t / (2 - t) <= |A| / |B| <= (2 - t) / t. A segment with fewer words than any template
could match goes before its bigrams are made, and a template outside the bounds of a segment is not compared.
Anchors. Within the bounds at least t / (2 - t) of a template's bigrams are shared, so the segment has one of any
set that holds more than the rest of them. The words of such a set are the template's anchors; a text or a
segment without an anchor of any template matches none, and goes without being cut into words.

One pass of Arrow batches over (id, text): no join, no shuffle and no group; templates travel with the code.

Defined cases: null and empty texts hold no licence; of two templates with equal scores on a segment the
first listed is given; repeated rows give their findings each; whole texts are scanned; empty tables give
empty results. Only the id and text columns are read. ``sql`` has the segments; runs are tested by brute force.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import parts
from .common import ship

THRESHOLD = 0.8
#: Bounds are products of doubles; a whole number must not fall below itself.
_EPS = 1e-9

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
    "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
    "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
    "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
    'portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS '
    "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version 3 of the License, "
    "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
    "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
    'CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE '
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
    "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
    "permission. "
)
_BOOST = (
    'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to '
    "use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished "
    "to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following "
    "disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form "
    'of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
    "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE "
    "FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ZLIB = (
    'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission '
    "is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The "
    "origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
    "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This "
    "notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
    "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software "
    "dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and "
    "successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "
    '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO '
    "EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
#: (licence, text): one-line notices, headers and short licences as their authors publish them.
TEMPLATES = (
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _WARRANTY,
    ),
    ("AGPL-3.0", _GNU.format("Affero General Public License")),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD.format("")),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD.format(_BSD_NAMES)),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", _BOOST),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "CC-BY-NC-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "CC-BY-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    (
        "CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    ("GPL-3.0", _GNU.format("General Public License")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _WARRANTY,
    ),
    ("LGPL-3.0", _GNU.format("Lesser General Public License")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
)


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


class Templates:
    def __init__(self, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD):
        self.threshold, self.ratio = threshold, threshold / (2 - threshold)
        self.names = [name for name, _ in templates]
        self.sets = [frozenset(bigrams_of(text)) for _, text in templates]
        self.least = math.ceil(min(len(b) for b in self.sets) * self.ratio - _EPS)
        self.most = math.floor(max(len(b) for b in self.sets) / self.ratio + _EPS)
        self.holders: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for k, b in enumerate(self.sets):
            for pair in b:
                self.holders[tuple(pair.split())].append(k)
        self.anchors: set[str] = set()
        for b in self.sets:
            # Cover more bigrams than a match may lack by as few and as long words as a greedy choice finds.
            open_ = set(b)
            while len(open_) > len(b) - (math.floor(len(b) * (1 - self.ratio) + _EPS) + 1):
                words = Counter(w for pair in open_ for w in set(pair.split()))
                best = max(words, key=lambda w: (w in self.anchors, min(words[w], 3) * len(w), w))
                self.anchors.add(best)
                open_ = {pair for pair in open_ if best not in pair.split()}
        self.anchored = re.compile("|".join(sorted(map(re.escape, self.anchors)))).search

    def best(self, segment: str) -> tuple[int, float] | None:
        """The template that a normalised segment matches best, and its score."""
        words = segment.split()
        if len(words) <= self.least or self.anchors.isdisjoint(words):
            return None
        mine = {f"{a} {b}" for a, b in zip(words, words[1:])}
        n, found = len(mine), None
        if n > self.most:
            return None
        for k, b in enumerate(self.sets):
            if n >= len(b) * self.ratio - _EPS and len(b) >= n * self.ratio - _EPS:
                dice = round(2 * len(mine & b) / (n + len(b)), 6)
                if dice >= self.threshold and (found is None or dice > found[1]):
                    found = (k, dice)
        return found

    def runs(self, words: list[str]) -> list[tuple[int, int, int, float]]:
        """(first word, word after the last, template, dice) of the stretches that match, best first, none sharing a word with another."""
        pairs = list(zip(words, words[1:]))
        held = Counter(k for pair in self.holders.keys() & set(pairs) for k in self.holders[pair])
        near = [k for k, c in held.items() if c >= len(self.sets[k]) * self.ratio - _EPS]
        if not near:
            return []
        before, last = np.empty(len(pairs), np.int64), {}
        spots: dict[int, list[int]] = {k: [] for k in near}
        for i, pair in enumerate(pairs):
            before[i] = last.get(pair, -1)
            last[pair] = i
            for k in self.holders.get(pair, ()):
                if k in spots:
                    spots[k].append(i)
        own = {k: np.zeros(len(pairs), bool) for k in near}
        for k in near:
            own[k][spots[k]] = True

        def best(start: int, stop: int, k: int) -> tuple[float, int, int, int] | None:
            """The best stretch of pairs from start that ends before stop, as an entry of the heap."""
            size, most = len(self.sets[k]), len(self.sets[k]) / self.ratio + _EPS
            end = start
            while end < stop:
                end = min(stop, start + 2 * (end - start) if end > start else start + 4 * size)
                new = before[start:end] < start
                n, m = np.cumsum(new), np.cumsum(new & own[k][start:end])
                if n[-1] > most or m[-1] == held[k]:
                    break
            if end == start:
                return None
            length = int((2 * m / (n + size)).argmax())
            dice = round(2 * int(m[length]) / (int(n[length]) + size), 6)
            return (-dice, length + 2, start, k) if dice >= self.threshold else None

        heap = [x for k in near for at in spots[k] if (x := best(at, len(pairs), k))]
        heapq.heapify(heap)
        taken: list[tuple[int, int]] = []
        out = []
        while heap:
            dice, length, start, k = heapq.heappop(heap)
            i = bisect(taken, (start, len(words)))
            if i and taken[i - 1][1] > start:
                continue
            if i < len(taken) and taken[i][0] < start + length:
                if again := best(start, taken[i][0] - 1, k):
                    heapq.heappush(heap, again)
                continue
            taken.insert(i, (start, start + length))
            out.append((start, start + length, k, -dice))
        return out

    def findings(self, text: str | None) -> Iterator[tuple[str, int, int, float]]:
        """(kind, place, template, dice) of a text's segments and runs."""
        if not text or not self.anchored(text.lower()):
            return
        clean = re.sub(r"[^a-z0-9\n]+", " ", text.translate(_LOWER))
        lines, paragraphs = clean.split("\n"), re.split(r"\n *\n[ \n]*", clean)
        segments = [("line", lines)]
        if len(paragraphs) < len(lines):
            segments.append(("paragraph", paragraphs))
        if len(paragraphs) > 1:
            segments.append(("document", [clean]))
        given = []
        for kind, parts in segments:
            found = []
            for place, part in enumerate(parts):
                if self.anchored(part) and (hit := self.best(part)):
                    found.append(place)
                    yield kind, place, *hit
            if found:
                ends = list(accumulate(len(part.split()) for part in parts))
                given += [(ends[place - 1] if place else 0, ends[place]) for place in found]
        for start, end, k, dice in self.runs(clean.split()):
            if not any(a <= start and end <= b for a, b in given):
                yield "run", start, k, dice


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id_col, kind, place, license, template, dice): for each segment that matches, its best template, and for each run. place counts the segments of a kind from 0; a run's is its first word's."""
    ship(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        for batch in batches:
            rows = [
                (i, *hit) for a, b in parts(batch.column(1)) for i, text in enumerate(
                    batch.column(1).slice(a, b - a).to_pylist(), a,
                ) for hit in known.findings(text)
            ]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(
                        pa.array(columns[0], pa.int64())
                    ), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()),
                    pa.array(
                        [known.names[k] for k in columns[3]], pa.string(),
                    ), pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.float64()),
                ],
                names=["id", "kind", "place", "license", "template", "dice"],
            )

    return kept.mapInArrow(
        run, f"id {kind}, kind string, place int, license string, template int, dice double",
    ).withColumnRenamed("id", id_col)


def sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same scan of table ``documents`` in DuckDB's SQL, without the pruning."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(
        f"({k}, {quote(n)}, [{', '.join(quote(b) for b in bigrams_of(t))}])" for k, (n, t) in enumerate(templates)
    )
    return f"""WITH t(k, name, b) AS (VALUES {rows}),
    d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\n]+', ' ', 'g') AS c FROM documents),
    cut AS (SELECT *, string_split(c, chr(10)) AS l, regexp_split_to_array(c, '\\n *\\n[ \\n]*') AS p FROM d),
    s AS (SELECT doc_id, rid, 'line' AS kind, unnest(range(len(l))) AS place, unnest(l) AS x FROM cut
        UNION ALL SELECT doc_id, rid, 'paragraph', unnest(range(len(p))), unnest(p) FROM cut WHERE len(p) < len(l)
        UNION ALL SELECT doc_id, rid, 'document', 0, c FROM cut WHERE len(p) > 1),
    w AS (SELECT doc_id, rid, kind, place, list_filter(string_split(translate(x, chr(10), ' '), ' '), lambda y: y <> '') AS w FROM s),
    b AS (SELECT doc_id, rid, kind, place, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
    m AS (SELECT doc_id, rid, kind, place, name, k, round(2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)), 6) AS dice FROM b, t WHERE len(g) * 3 > len(b) AND len(b) * 3 > len(g)),
    r AS (SELECT *, row_number() OVER (PARTITION BY rid, kind, place ORDER BY dice DESC, k) AS n FROM m WHERE dice >= {threshold})
    SELECT doc_id, kind, place::INT AS place, name AS license, k AS template, dice FROM r WHERE n = 1"""
