"""Operator 10, license scans by patience alignment.

A text and a license template are lists of lower-cased words. Words that occur once in both are anchors; the longest
increasing run of anchors (patience sorting) is kept, and the gaps between them are aligned the same way, after equal
words at a gap's ends are paired. Coverage is the share of the template's words that are paired.

Only stretches of a text that can reach ``least`` coverage are aligned. A template's *keys* are distinctive words
with so many occurrences in it that any alignment reaching ``least`` uses one of them; a text without keys is done
after one linear search. Around its keys a text is cut into stretches; one with keys over more than three template
lengths is cut into windows of four lengths that overlap by two, and where several copies may stand short windows are
tried too. So a repeated or very long text costs time in proportion to its length. Separate places are taken from the
dense windows first, those with the most paired words before others (ties: the shorter, then the first).

Each partition is scanned by itself, without a shuffle. Defined results: a null or empty text has no hits; repeated
rows have hits each; a text that holds a template several times has a hit for each copy; hits of different templates may
overlap, and one that another holds (BSD's two clauses in the three, a notice in a header) names it in ``within``; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_slices

# Public license texts and the notices by which works name their license.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
        OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
        AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR
        OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
        WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE
        IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
        License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "gpl-2.0-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
        more details. You should have received a copy of the GNU General Public License along with this program; if not, write
        to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "lgpl-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
        Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
        your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser
        General Public License for more details. You should have received a copy of the GNU Lesser General Public License along
        with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA
        02110-1301 USA""",
    "agpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the
        GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
        your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero
        General Public License for more details. You should have received a copy of the GNU Affero General Public License along
        with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS
        AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
        NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
        HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the
        names of its contributors may be used to endorse or promote products derived from this software without specific prior
        written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
        IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
        OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
        authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
        dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
        dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
        copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
        FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information,
        please refer to <https://unlicense.org>""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
        held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
        is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
        original software. 3. This notice may not be removed or altered from any source distribution.""",
    "cc0-1.0-notice": """To the extent possible under law, the author(s) have dedicated all copyright and related and
        neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.""",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
        of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
# Frequent words that are no keys unless nothing else is left.
COMMON = frozenset("""a all an and any are at be by can either following for free from if in including is it list may
    more must no not of on one or other out person provided see source subject such that the this to under use will
    with without work you your version""".split())
WORD = re.compile(r"\w+")


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(at[pile - 1] if pile else -1)
        tops[pile:pile + 1], at[pile:pile + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, increasing in both lists."""
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
        times, times_there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: j for j, w in enumerate(template[c:d], c) if times_there[w] == 1 and times.get(w) == 1}
        anchors = [(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place]
        anchors = [anchors[k] for k in longest_increasing([j for _, j in anchors])]
        pairs += anchors
        if anchors:
            ends = [(a - 1, c - 1), *anchors, (b, d)]
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    return sorted(pairs)


class Template:
    def __init__(self, name: str, text: str, least: float):
        self.name, self.words = name, WORD.findall(text.lower())
        times, spare = Counter(self.words), len(self.words) * (1 - least)
        keys, held = set(), 0
        for word in sorted(times, key=lambda w: (w in COMMON, -len(w), w)):
            if held > spare + 1e-9:
                break
            keys.add(word)
            held += times[word]
        self.keys = frozenset(keys)

    def windows(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """Stretches of a text around its key words."""
        n, start, last = len(self.words), None, 0
        for i, word in enumerate([*words, None]):
            if word is not None and word not in self.keys:
                continue
            if start is not None and (word is None or i - last > 2 * n):
                a, b = max(0, start - n), min(len(words), last + n + 1)
                if last - start <= 3 * n:
                    yield a, b
                else:
                    for at in range(a, b - 2 * n, 2 * n):
                        yield at, min(b, at + 4 * n)
                if last - start > n:  # more than one copy may stand here: short stretches hold mostly one
                    for at in range(a, b, max(1, n // 2)):
                        yield at, min(b, at + n + n // 2)
                start = None
            if word is not None:
                start, last = (i if start is None else start), i

    def places(self, words: list[str], least: float) -> list[tuple[int, int, int]]:
        """Separate places that reach ``least`` coverage: paired words, and the text's places from the first to past the last."""
        n, found = len(self.words), set()
        for a, b in self.windows(words):
            pairs = align(words[a:b], self.words)
            if len(pairs) >= least * n - 1e-9:
                found.add((len(pairs), a + pairs[0][0], a + pairs[-1][0] + 1))
        # a wide place may join parts of two copies, so it comes after the dense ones
        taken: list[tuple[int, int, int]] = []
        starts: list[int] = []  # of the places taken, ascending
        for matched, a, b in sorted(found, key=lambda x: (x[2] - x[1] > n + n // 2, -x[0], x[2] - x[1], x[1])):
            i = bisect_left(starts, a)
            if (i == len(starts) or taken[i][1] >= b) and (i == 0 or taken[i - 1][2] <= a):
                starts.insert(i, a)
                taken.insert(i, (matched, a, b))
        return taken


def holders(hits: list[tuple[str, int, int, int, int]]) -> list[str | None]:
    """Per hit (license, paired words, template's words, from, to) of a text: the license whose hit holds it, if any does.

    That hit's place covers this one's, and more words are paired (or as many of a shorter template): the text is the
    other license's, which this one's is a part of or much like. The largest such hit names it.
    """
    best: list[str | None] = [None] * len(hits)
    rank = lambda h: (h[1], -h[2])
    open_hits: list[int] = []
    # by start, the widest first: all that may hold a hit come before it, and those that ended before it are let go
    for i in sorted(range(len(hits)), key=lambda i: (hits[i][3], -hits[i][4], -hits[i][1], hits[i][2])):
        open_hits = [j for j in open_hits if hits[j][4] > hits[i][3]]
        over = [j for j in open_hits if hits[j][4] >= hits[i][4] and rank(hits[j]) > rank(hits[i])]
        if over:
            best[i] = hits[max(over, key=lambda j: (rank(hits[j]), hits[j][0]))][0]
        open_hits.append(i)
    return best


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.8, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per text, template and separate place with a coverage of ``least`` or more.

    Columns: id, license_id, coverage, matched (words), template_words, start and length (characters of the place in
    the text), verbatim (every word of the template, and nothing between them), within (license_id of the hit that holds this
    one, see ``holders``, else null).
    """
    ship(df.sparkSession)
    known = [Template(name, text, least) for name, text in templates.items()]
    search = "|".join(sorted({w for t in known for w in t.keys}))
    kind = df.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, license_id string, coverage double, matched long, template_words long, start long, "
              "length long, verbatim boolean, within string")
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            types = [part.schema.field(0).type, pa.string(), pa.float64(), *[pa.int64()] * 4, pa.bool_(), pa.string()]
            texts = pc.fill_null(part.column(1).cast(pa.string()), "")
            hits = pc.match_substring_regex(pc.utf8_lower(texts), search)
            out: list[tuple] = []
            for doc, text in zip(part.column(0).filter(hits).to_pylist(), texts.filter(hits).to_pylist()):
                places = [m.span() for m in WORD.finditer(text)]
                words = [text[a:b].lower() for a, b in places]
                present = set(words)
                hits_here = []
                for template in known:
                    if not template.keys.isdisjoint(present):
                        hits_here += [(template.name, matched, len(template.words), a, b)
                                      for matched, a, b in template.places(words, least)]
                for (name, matched, n, a, b), within in zip(hits_here, holders(hits_here)):
                    begin = places[a][0]
                    out.append((doc, name, matched / n, matched, n, begin, places[b - 1][1] - begin, matched == n == b - a, within))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(rows, schema)
