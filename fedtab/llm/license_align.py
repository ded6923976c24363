"""License scans by patience alignment.

A text region and a license template are anchored on the words that occur once in
both; the longest increasing subsequence of the anchors is kept and the gaps between
them are aligned in the same way. Coverage is the share of the template's words that
are aligned; where the anchors leave it just below the limit, the longest common
subsequence decides, so that a region matches exactly if it has one long enough. The
words that tell licenses apart (names, versions, NC, SA, Lesser, ...) must be aligned
besides, and none of another license may stand between. A short notice has to stand
together: between its words only connecting words may lie, or names of other licenses
that are listed with it ("the MIT and ISC License").

Every text is scanned whole, in Spark tasks and without any shuffle; the templates
are a fixed table.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a template's words that must be aligned.
LEAST = 0.8
#: Templates with fewer words are notices.
NOTICE = 13
WORD = re.compile(r"[a-z0-9]+")

# Spoken names of public licenses. A notice is a way of saying it with a name in it.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 license"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3", "GPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL version 2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL version 3", "LGPLv3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPLv3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License v2.0", "Eclipse Public License 2.0", "EPL-2.0"],
    "EUPL-1.2": ["European Union Public Licence, Version 1.2", "European Union Public Licence v1.2", "EUPL-1.2"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0"],
    "CC-BY-3.0": ["CC BY 3.0", "Creative Commons Attribution 3.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"],
}
#: Ways of saying it, besides the identifier line; a name without digits needs the first words to be one.
SAYINGS = ("under {}", "under the {}", "License: {}")

# Beginnings or whole texts of public licenses.
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
           "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
           "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
           "conditions: The above copyright notice and this permission notice shall be included in all copies or "
           "substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
                  "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                  "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                  "permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met: Redistributions of source code must retain the above "
                    "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
                    "form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
                    "in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
               "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
               "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "GPL-2.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation, either version 2 of the License, or (at your "
               "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
               "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-2.1": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
               "Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your "
               "option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY "
               "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General "
               "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
               "option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY "
               "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
               "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
               "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
               "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met: Redistributions of source code must retain the above "
                    "copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
                    "form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
                    "in the documentation and/or other materials provided with the distribution. Neither the name of "
                    "the copyright holder nor the names of its contributors may be used to endorse or promote products "
                    "derived from this software without specific prior written permission.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
               "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
                    "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
                    "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
                    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
                    "DEALINGS IN THE SOFTWARE.",
    "BSD-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
                    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
                    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
                    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
                    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
                    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
                    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
            "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
            "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
            "following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote "
            "the original software. If you use this software in a product, an acknowledgment in the product documentation would "
            "be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be "
            "misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
                 "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
                 "purpose, commercial or non-commercial, and by any means.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
               "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
               "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
               "to whom the Software is furnished to do so.",
}


def templates_of(names: dict[str, list[str]] | None = None, texts: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Wordings by license: its texts; its notices (``…-notice``), made of its spoken names; and its identifier, which
    stands for itself where it has a number."""
    found: dict[str, list[str]] = {k: [v] for k, v in (TEXTS if texts is None else texts).items()}
    for license_, spoken in (NAMES if names is None else names).items():
        bare = [license_] if any(c.isdigit() for c in license_) else []
        found[f"{license_}-notice"] = [f"SPDX-License-Identifier: {license_}", *bare, *(w.format(n) for n in spoken for w in SAYINGS)]
    return found | {"reserved-notice": ["All rights reserved."]}


TEMPLATES = templates_of()
#: Words too common to mark a region.
COMMON = frozenset("a an and any are at be by for from in is it of on or that the this to under with you".split())
#: Words that tell licenses apart, as far as a template has them, besides all numbers; each must be aligned.
#: (Version 2.1 is the Lesser license's alone, so its number is enough.)
DECIDING = frozenset("mit apache mozilla gnu general lesser affero isc cc nc sa nd bsd boost eclipse european zlib unlicense cc0 "
                     "gpl lgpl agpl gplv2 gplv3 lgplv2 lgplv3 agplv3 mpl epl eupl creative attribution sharealike noncommercial "
                     "noderivatives".split())
#: Words that a notice must have besides.
SAID = frozenset("under spdx identifier reserved".split())
#: Words that may lie between those of a notice.
CONNECTING = frozenset("a an are free in is of or s terms the this v version".split())
#: Names that may be listed with another license's.
LISTED = frozenset("mit isc zlib bsd apache 2 3 0 clause boost".split())
#: Words that make another license of a template with the first word, if they stand unaligned between its words.
FOREIGN = {"cc": frozenset("nc sa nd".split()), "public": frozenset("lesser affero mozilla library".split()),
           "attribution": frozenset("sharealike noncommercial noderivatives".split())}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (already increasing in the first) that increases in the second."""
    tails, at, back = [], [], []
    for k, (_, y) in enumerate(pairs):
        i = bisect_left(tails, y)
        back.append(at[i - 1] if i else -1)
        if i == len(tails):
            tails.append(y)
            at.append(k)
        else:
            tails[i], at[i] = y, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def longest(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence, a row of the table as the bits of one number.

    Bit j of row i is 0 where the length rises at the j-th word of ``b``; so the table takes ``len(a) * len(b)`` bits.
    """
    where: dict[str, int] = {}
    for j, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << j
    every = (1 << len(b)) - 1
    rows = [every]
    for w in a:
        v = rows[-1]
        u = v & where.get(w, 0)
        rows.append(((v + u) | (v - u)) & every)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions of two word lists, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i >= i2 or j >= j2:
            continue
        left, right = Counter(a[i:i2]), Counter(b[j:j2])
        where = {w: k for k, w in enumerate(b[j:j2], j) if right[w] == 1}
        anchors = _increasing([(k, where[w]) for k, w in enumerate(a[i:i2], i) if left[w] == 1 and w in where])
        if not anchors:
            out += [(i + x, j + y) for x, y in longest(a[i:i2], b[j:j2])]
            continue
        out += anchors
        ends = [(i - 1, j - 1), *anchors, (i2, j2)]
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


@dataclass(frozen=True)
class Template:
    """One wording of a license: its words, how many must be aligned, and within how many words of a text."""

    name: str
    words: tuple[str, ...]
    need: int
    span: int
    marks: frozenset[str]
    reach: int
    deciding: frozenset[str]
    foreign: frozenset[str]

    @staticmethod
    def of(name: str, text: str, least: float = LEAST) -> Template:
        words = tuple(WORD.findall(text.lower()))
        marks = frozenset(words) - COMMON or frozenset(words)
        at = [i for i, w in enumerate(words) if w in marks]
        gap = max([b - a for a, b in zip(at, at[1:], strict=False)] + [at[0] + 1, len(words) - at[-1]])
        # as many foreign or missing words as coverage allows may lie between two marks
        reach = gap + 2 + int((1 - least) * len(words))
        return Template(name, words, math.ceil(least * len(words) - 1e-9), len(words) + len(words) // 2 + 4 + reach, marks, reach,
                        frozenset(w for w in words if w.isdigit() or (w in SAID and len(words) < NOTICE)
                                  or (w in DECIDING and not (w == "lesser" and "1" in words))),
                        frozenset().union(*(v for k, v in FOREIGN.items() if k in words)) - frozenset(words))

    @property
    def notice(self) -> bool:
        return len(self.words) < NOTICE


def _regions(words: list[str], t: Template) -> Iterator[tuple[int, int]]:
    """Stretches of the text that may hold the template: marks close to each other.

    A copy takes up ``t.span`` words at most. A longer stretch is scanned by windows that overlap by as many, so that
    every copy lies whole in one of them, as it does in a text of its own.
    """
    hits = [i for i, w in enumerate(words) if w in t.marks]
    groups: list[list[int]] = []
    for i in hits:
        if not groups or i - groups[-1][1] > t.reach:
            groups.append([i, i])
        groups[-1][1] = i
    step = max(1, len(t.words) // 4)
    for first, last in groups:
        start, end = max(0, first - t.reach), min(len(words), last + t.reach + 1)
        yield start, min(end, start + t.span + step)
        yield from ((i, min(end, i + t.span + step)) for i in range(start + step, end - t.span, step))


def _gathered(pairs: list[tuple[int, int]], t: Template) -> list[tuple[int, int]]:
    """An alignment without outer words that lie further from the rest than a copy's words do."""
    while len(pairs) > 1 and pairs[1][0] - pairs[0][0] > t.reach + t.need:
        pairs = pairs[1:]
    while len(pairs) > 1 and pairs[-1][0] - pairs[-2][0] > t.reach + t.need:
        pairs = pairs[:-1]
    return pairs


def _covering(words: list[str], t: Template) -> list[tuple[int, int]]:
    """An alignment that covers enough of the template within its span, or none."""
    common = Counter(words) & Counter(t.words)
    if sum(common.values()) < t.need:
        return []
    for way in (align, longest):
        pairs = way(words, list(t.words))
        for found in (_gathered(pairs, t), pairs):
            if len(found) >= t.need and found[-1][0] - found[0][0] < t.span:
                return found
    if len(pairs) >= t.need:  # the longest one is spread too wide; one within the span may be long enough
        for k in range(len(words) - t.span + 1):
            found = longest(words[k:k + t.span], list(t.words))
            if len(found) >= t.need:
                return [(k + i, j) for i, j in found]
    return []


def _other(words: list[str], pairs: list[tuple[int, int]], t: Template) -> int | None:
    """The place from which an alignment belongs to another license than the template's, or None if it is its own."""
    aligned = {i for i, _ in pairs}
    first, last = pairs[0][0], pairs[-1][0]
    between = [i for i in range(first, last) if i not in aligned]
    listed = {"and", "or"} & {words[i] for i in between}
    for i in between:
        if (words[i] in t.foreign and (words[i] != "library" or words[i + 1] == "general")) or (
                words[i].isdigit() and t.deciding and i > 0 and not (t.notice and listed)
                and (words[i - 1] in ("version", "v") or (words[i - 1].isdigit() and i - 1 in aligned))):
            return i
        if t.notice and words[i] not in CONNECTING and not (listed and (words[i] in LISTED or words[i] in ("and", "or"))):
            return i
    return None if t.deciding <= {words[i] for i in aligned} else first


def _together(words: list[str], a: int, b: int, t: Template) -> Iterator[list[tuple[int, int]]]:
    """Copies of a notice among many of its words: from each place on, the words that follow soonest."""
    while a < b:
        pairs = []
        if words[a] in t.words:
            part = words[a:min(b, a + t.span)]
            pairs = [(len(part) - 1 - i, len(t.words) - 1 - j) for i, j in longest(part[::-1], list(t.words[::-1]))][::-1]
        if len(pairs) >= t.need and pairs[0][0] == 0 and _other(part, pairs, t) is None:
            yield [(a + i, j) for i, j in pairs]
            a += pairs[-1][0]
        a += 1


def _matches(words: list[str], t: Template) -> Iterator[list[tuple[int, int]]]:
    """Alignments of all copies of a template in a text's words."""
    for a, b in _regions(words, t):
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            pairs = _covering(words[a:b], t) if b - a >= t.need else []
            if not pairs:
                continue
            other = _other(words[a:b], pairs, t)
            if other is None:
                yield [(a + i, j) for i, j in pairs]
                todo += [(a, a + pairs[0][0]), (a + pairs[-1][0] + 1, b)]  # another copy may stand beside it
            elif t.notice:
                yield from _together(words, a, b, t)
            else:
                todo += [(a, a + other), (a + other + 1, b)]  # its own license may stand beside it


def scan(text: str | None, templates: list[Template]) -> list[tuple[str, float, int, int]]:
    """``(license, coverage, start, end)`` of every region that covers enough of a template, in code points.

    Of matches that overlap only the one with most aligned words stays, but for notices of licenses that are listed
    together: they share words, not names.
    """
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # rare letters change length in lower case; keep the places right
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    words = WORD.findall(low)
    here, spans, found = set(words), None, []
    for t in templates:
        if not t.deciding <= here or len(set(t.words) - here) > len(t.words) - t.need:
            continue  # each missing word leaves at least one of the template's words unaligned
        spans = spans or [m.span() for m in WORD.finditer(low)]
        for pairs in _matches(words, t):
            names = frozenset(i for i, j in pairs if t.words[j] in t.deciding and t.words[j] != "under")
            found.append((len(pairs), t.name, len(pairs) / len(t.words), spans[pairs[0][0]][0], spans[pairs[-1][0]][1], names, t.notice))
    kept: list = []
    for n, name, cover, start, end, names, notice in sorted(found, key=lambda x: (-x[0], -x[2], x[1], x[3])):
        if all(end <= k[2] or start >= k[3] or (notice and k[5] and name != k[0] and names and k[4] and not names & k[4]) for k in kept):
            kept.append((name, cover, start, end, names, notice))
    return sorted((k[:4] for k in kept), key=lambda k: (k[2], k[0]))


def known_templates(templates: dict[str, list[str]] | None = None, least: float = LEAST) -> list[Template]:
    """All wordings, in order; those without a word never match and are left out."""
    return [Template.of(name, text, least) for name, texts in sorted((TEMPLATES if templates is None else templates).items())
            for text in texts if WORD.search(text.lower())]


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None,
                  least: float = LEAST) -> DataFrame:
    """``(key, matches)`` of every row: ``matches`` are ``(license, coverage, start, end)`` in order of start.

    A null or empty text, or one without a license, has none. Equal texts give
    equal rows; null keys are kept; an empty table gives an empty one. An empty
    template never matches.
    """
    known = known_templates(templates, least)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    match = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"license": a, "coverage": b, "start": c, "end": d} for a, b, c, d in scan(t.as_py(), known)]
                     for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, match)], ["key", "matches"])
    out = rows.mapInArrow(run, f"key {kind}, matches array<struct<license:string,coverage:double,start:bigint,end:bigint>>")
    return out.withColumnRenamed("key", key)
