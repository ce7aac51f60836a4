"""License scans by patience alignment.

For each template, places where enough of its words stand close together are aligned with it: words that occur once in
the place and once in the template are anchors, the longest increasing subsequence of anchors is kept, and the gaps
between anchors are aligned in the same way; a gap without such words is matched word by word from both its ends. The
share of the template's words that are aligned is its coverage; at ``COVERAGE`` or more the license is reported.

Whole texts are scanned, however long, where they lie. Null, empty and wordless texts hold none. A license found in
several places counts each place; of overlapping places, of whatever licenses, the one with the most words aligned, times
its coverage, counts, of equal ones the first in the text, then by name. Repeated rows give repeated results. Other
columns, whatever their names, are passed on; a result column whose name is taken gets another. An empty table gives an
empty result.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sheaf.llm import textkit as tk
from sheaf.llm.exact_dedup import unused

COVERAGE = 0.8
#: A place may be this much longer than its template.
SLACK = 1.3

WORD = re.compile(r"[0-9a-z]+(?:[.\-][0-9a-z]+)*")

# License texts and notices, in lower case, punctuation aside.
BSD_CONDITIONS = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_NAMES = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
BSD_WARRANTY = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
BSD_LIABILITY = "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
GNU_HEADER = "this {work} is free software you can redistribute it and or modify it under the terms of the {license} as published by the free software foundation either version {version} of the license or at your option any later version this {work} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {license} for more details you should have received a copy of the {license} along with this {work}"
GNU_LICENSES = {
    "GPL-2.0-or-later-header": ("program", "gnu general public license", "2"),
    "GPL-3.0-or-later-header": ("program", "gnu general public license", "3"),
    "LGPL-2.1-or-later-header": ("library", "gnu lesser general public license", "2.1"),
    "LGPL-3.0-or-later-header": ("program", "gnu lesser general public license", "3"),
    "AGPL-3.0-or-later-header": ("program", "gnu affero general public license", "3"),
}
TEMPLATES = {name: GNU_HEADER.format(work=work, license=license_, version=version) for name, (work, license_, version) in GNU_LICENSES.items()} | {
    "BSD-3-Clause": f"{BSD_CONDITIONS} {BSD_NAMES} {BSD_WARRANTY} {BSD_LIABILITY}",
    "MPL-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    "CC0-1.0-notice": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "zlib": "this software is provided as-is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution",
    "Unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "BSL-1.0": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third-parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non-infringement in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "MIT-notice": "released under the mit license",
    "Apache-2.0-notice": "licensed under the apache license version 2.0",
    "GPL-3.0-notice": "this work is licensed under the gnu general public license version 3",
    "GPL-2.0-notice": "this work is licensed under the gnu general public license version 2",
    "CC-BY-NC-4.0-notice": "licensed under cc by-nc 4.0",
    "CC-BY-4.0-notice": "licensed under cc by 4.0",
    "CC-BY-SA-4.0-notice": "licensed under cc by-sa 4.0",
    "all-rights-reserved": "all rights reserved",
    "MIT": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "ISC": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "BSD-2-Clause": f"{BSD_CONDITIONS} {BSD_WARRANTY} {BSD_LIABILITY}",
    "Apache-2.0-header": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses license-2.0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
}


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for i, value in enumerate(values):
        at = bisect.bisect_left(tops, value)
        before[i] = piles[at - 1] if at else -1
        if at == len(tops):
            tops.append(value)
            piles.append(i)
        else:
            tops[at], piles[at] = value, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def aligned(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in the text, place in the template) of aligned words, increasing in both."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(template[c:d], c) if theirs[w] == 1 and ours[w] == 1}
        both = [(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place]
        anchors = [both[k] for k in increasing([j for _, j in both])]
        if not anchors:
            continue
        pairs += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
    return sorted(pairs)


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE):
        self.templates = {name: WORD.findall(text.lower()) for name, text in templates.items()}
        self.coverage = coverage
        self.vocabulary = {w for words in self.templates.values() for w in words}
        #: A template's rarer words (in few templates), so many that all their places together are more than may be missing:
        #: a text without any of them cannot reach the coverage.
        uses = Counter(w for words in self.templates.values() for w in set(words))
        self.wanted = {name: Counter(words) for name, words in self.templates.items()}
        self.triggers = {name: self._triggers(name, uses) for name in self.templates}

    def _triggers(self, name: str, uses: Counter[str]) -> list[str]:
        wanted, missing = self.wanted[name], len(self.templates[name]) - math.ceil(self.coverage * len(self.templates[name]))
        out: list[str] = []
        for word in sorted(wanted, key=lambda w: (uses[w], -len(w), w)):
            if missing < 0:
                break
            out.append(word)
            missing -= wanted[word]
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, past-last word) of each place, by place."""
        words = WORD.findall((text or "").lower())
        known = [(i, w) for i, w in enumerate(words) if w in self.vocabulary]
        present = Counter(w for _, w in known)
        found = []
        for name, template in self.templates.items():
            if not any(t in present for t in self.triggers[name]):
                continue
            wanted = self.wanted[name]
            if sum(min(n, present[w]) for w, n in wanted.items()) < self.coverage * len(template):
                continue
            mine = [i for i, w in known if w in wanted]
            span = int(len(template) * SLACK) + 2
            least = self.coverage * len(template)
            best: tuple[float, int, int] | None = None
            for k, start in enumerate(mine):
                if k + least - 1 >= len(mine) + 1e-9 or mine[min(len(mine), int(k + least)) - 1] >= start + span:
                    continue
                end = min(len(words), start + span)
                pairs = aligned(words[start:end], template)
                if len(pairs) >= least:
                    share = (len(pairs) / len(template), start + pairs[0][0], start + pairs[-1][0] + 1)
                    if best and share[1] < best[2]:
                        best = max(best, share, key=lambda x: (x[0], -x[1]))
                        continue
                    if best:
                        found.append((name, *best))
                    best = share
            if best:
                found.append((name, *best))
        taken: list[tuple[str, float, int, int]] = []
        for x in sorted(found, key=lambda x: (-x[1] * x[1] * len(self.templates[x[0]]), x[2], x[0])):
            if all(x[3] <= y[2] or y[3] <= x[2] for y in taken):
                taken.append(x)
        return sorted(taken, key=lambda x: (x[2], x[0]))


FOUND = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def scanned(docs: DataFrame, text_col: str = "text", into: str = "licenses", scanner: Scanner | None = None) -> DataFrame:
    """All rows and columns, and the licenses found with their coverage and word places."""
    into = unused(docs, into)
    scanner = scanner or Scanner()
    column = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tk.slices(batch, text_col):
                found = [[dict(zip(("license", "coverage", "start", "end"), x)) for x in scanner.scan(t)] for t in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind)], [*part.schema.names, into])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(into, FOUND)]))
