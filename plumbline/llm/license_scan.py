"""Licence scan: normalised text against licence templates, by Dice coefficient over word bigrams.

Units are every line of a text, if it has more than one line the whole text, and passages. A unit is lower-cased (A-Z),
cut into words ``[a-z0-9]+``, and becomes the set of its distinct pairs of neighbouring words (one word: that word alone).
With a bigrams in the unit and b in a template, Dice is 2 * shared / (a + b); a unit matches its best template (ties: the
first identifier) if that is at least THRESHOLD percent.

Passages are what a licence takes up in a longer text: runs of as many words as the template has (fewer at the end of the
text), wherever lines break, that begin with one of its bigrams. Of matching passages that overlap, the one that shares
most bigrams stays (ties: higher Dice, earlier, first identifier); none is given that overlaps a matching line which
shares as many, that is most of a text which matches as a whole, or that lies in a line which stands alone (no text in the
lines next to it) and has at most LONG words - such a line is one unit.

Pruning is exact. Sizes: Dice can't reach t unless a lies between b*t/(2-t) and b*(2-t)/t. Anchors: shared must be at
least b*t/(2-t), so a match holds one of any larger part of the template's bigrams; each template keeps such a part, of
those with the longest words. A template takes part in a text that holds one of these and enough of all its bigrams.

The templates (TEMPLATES, or a mapping of one's own) are a fixed, short list and travel with the function.

Defined cases: null and empty texts and units without words match nothing; repeated rows each give their matches; a null
doc_id is kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from plumbline.llm.common import clashing, keys, longs

THRESHOLD = 80  # percent
LONG = 16  # words
_WORD = re.compile(rb"[a-z0-9]+")

_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
    "PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE."
)
_APACHE_HEADER = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required '
    'by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
    "language governing permissions and limitations under the License."
)
_GPL_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
    "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
    "more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
)
_AGPL_HEADER, _LGPL_HEADER = (_GPL_HEADER.replace("General Public", f"{x} General Public") for x in ("Affero", "Lesser"))
_GPL2_HEADER = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
    "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
    "more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
)
_LGPL21_HEADER = (
    "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
    "any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General "
    "Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA "
    "02110-1301 USA"
)
_BSD_USE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_1_2 = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
    "and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE '
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_CC0_NOTICE = (
    "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have "
    "received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
    "commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
    "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software "
    'under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO '
    "EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE. For more information, please refer to https://unlicense.org"
)


def _full(name: str) -> str:
    """A long text from the folder beside this file, in one line."""
    return " ".join((Path(__file__).parent / "licences" / f"{name}.txt").read_text("utf-8").split())


#: Template id (SPDX identifier, form) to text: short notices, and file headers or full texts.
TEMPLATES: dict[str, str] = {
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": _APACHE_HEADER,
    "Apache-2.0/text": _full("Apache-2.0"),
    "AGPL-3.0/header": _AGPL_HEADER,
    "BSD-2-Clause/text": _BSD_USE + _BSD_1_2 + _BSD_END,
    "BSD-3-Clause/notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause/text": _BSD_USE + _BSD_1_2 + _BSD_3 + _BSD_END,
    "CC0-1.0/notice": _CC0_NOTICE,
    "CC0-1.0/text": _full("CC0-1.0"),
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0/long-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0/notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0/header": _GPL2_HEADER,
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": _GPL_HEADER,
    "ISC/text": _ISC,
    "LGPL-2.1/header": _LGPL21_HEADER,
    "LGPL-3.0/header": _LGPL_HEADER,
    "LicenseRef-all-rights-reserved/notice": "All rights reserved.",
    "MIT/notice": "Released under the MIT License.",
    "MIT/text": _MIT,
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MPL-2.0/text": _full("MPL-2.0"),
    "Unlicense/text": _UNLICENSE,
}


def bigrams(raw: bytes) -> set[tuple[bytes, ...]]:
    """Of lower-cased bytes."""
    words = _WORD.findall(raw)
    return set(zip(words, words[1:])) if len(words) > 1 else {(words[0],)} if words else set()


class Templates:
    def __init__(self, texts: Mapping[str, str], threshold: int):
        self.threshold = threshold
        words = {n: _WORD.findall(t.encode().lower()) for n, t in texts.items()}
        self.sets = sorted((name, b) for name, b in ((n, bigrams(t.encode().lower())) for n, t in texts.items()) if b)
        self.sizes = {name: max(len(w) - 1, 1) for name, w in words.items()}
        self.needs, self.anchors = {}, {}
        for name, b in self.sets:
            self.needs[name] = need = -(-threshold * len(b) // (200 - threshold))  # least number shared
            for x in sorted(b, key=lambda x: (-max(map(len, x)), x))[: len(b) - need + 1]:
                self.anchors.setdefault(x, []).append(name)
        self.single = any(len(x) == 1 for x in self.anchors)

    def fits(self, both: int, n: int) -> bool:
        return 200 * both >= self.threshold * n

    def held(self, words: list[bytes]) -> list[tuple[str, set]]:
        """Templates that a unit of these words may match."""
        unit = set(zip(words, words[1:]))
        if self.single or len(words) == 1:
            unit |= {(w,) for w in words}
        names = {name for x in unit & self.anchors.keys() for name in self.anchors[x]}
        return [(name, b) for name, b in self.sets if name in names and len(unit) >= self.needs[name] <= len(unit & b)]

    def best(self, raw: bytes, sets: list[tuple[str, set]]) -> tuple[str, int, int] | None:
        """Template, shared bigrams and the sum of both sizes."""
        unit, found = bigrams(raw), None
        for name, b in sets:
            n = len(unit) + len(b)
            if not self.fits(min(len(unit), len(b)), n):
                continue
            both = len(unit & b)
            if self.fits(both, n) and (found is None or both * found[2] > found[1] * n):
                found = (name, both, n)
        return found

    def passages(self, words: list[bytes], sets: list[tuple[str, set]]) -> list[tuple[int, int, str, int, int]]:
        """(first bigram, the one after the last, template, shared, sum of sizes) of every passage that matches."""
        pairs, out = list(zip(words, words[1:])), []
        for name, b in sets:
            count: dict[tuple, int] = {}
            end = both = 0
            for start, first in enumerate(pairs):
                while end < min(start + self.sizes[name], len(pairs)):
                    x = pairs[end]
                    count[x] = count.get(x, 0) + 1
                    both += count[x] == 1 and x in b
                    end += 1
                if first in b and self.fits(both, len(count) + len(b)):
                    out.append((start, end, name, both, len(count) + len(b)))
                if count[first] == 1:
                    del count[first]
                    both -= first in b
                else:
                    count[first] -= 1
        return out

    def scan(self, text: str | None) -> list[tuple[int, str, float]]:
        """(line number from 1 where the unit begins, or 0 for the whole text; template; Dice)."""
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        words = _WORD.findall(raw)
        if not words or not (sets := self.held(words)):
            return []
        lines = raw.split(b"\n")
        sizes = [len(_WORD.findall(line)) for line in lines]
        of = [i for i, n in enumerate(sizes) for _ in range(n)]  # the line of each word
        hits = {i: hit for i, line in enumerate(lines) if (hit := self.best(line, sets))}
        whole = self.best(raw, sets) if len(lines) > 1 else None
        alone = [n <= LONG and not any(0 <= k < len(lines) and lines[k].strip() for k in (i - 1, i + 1)) for i, n in enumerate(sizes)]
        taken: list[tuple[int, int, str, int, int]] = []
        for p in sorted(self.passages(words, sets), key=lambda p: (-p[3], p[4], p[0], p[2])):  # of equal shared, a smaller sum is a higher Dice
            start, end, _, both, _ = p
            a, z = of[start], of[end]
            if a == z and alone[a] or whole and 2 * (end - start + 1) >= len(words):
                continue
            if any(hits[i][1] >= both for i in range(a, z + 1) if i in hits) or any(start <= q[1] and q[0] <= end for q in taken):
                continue
            taken.append(p)
        out = [(i + 1, *hit) for i, hit in hits.items()] + [(of[p[0]] + 1, *p[2:]) for p in sorted(taken)] + ([(0, *whole)] if whole else [])
        return [(i, name, 2 * both / n) for i, name, both, n in out]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, line, template, dice of each unit of docs(doc_id, text) that matches; line 0 is the whole text,
    and a passage has the line in which it begins."""
    templates = dict(templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Templates(templates, threshold)
        for b in batches:
            rows = [(doc, *hit) for doc, text in zip(b["doc_id"], b["text"], strict=True) for hit in known.scan(text)]
            out = pd.DataFrame(rows, columns=["doc_id", "line", "template", "dice"])
            yield out.assign(doc_id=longs(out["doc_id"]))

    return keys(clashing(docs, ["doc_id", "text"]), "doc_id").mapInPandas(run, "doc_id long, line int, template string, dice double")


def sql(templates: Mapping[str, str] = TEMPLATES, threshold: int = THRESHOLD) -> str:
    """Lines and whole texts (not passages) by joins on bigrams, without pruning."""
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in templates.items())
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    pairs = "unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)"
    return f"""
WITH t(template, body) AS (VALUES {values}),
tb AS (SELECT DISTINCT template, {pairs} AS g FROM (SELECT template, regexp_extract_all({low.format('body')}, '[a-z0-9]+') AS w FROM t)),
ts AS (SELECT template, count(*) AS b FROM tb GROUP BY template),
lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
units AS (
  SELECT doc_id, CAST(i AS INTEGER) AS line, l[i] AS body FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lines)
  UNION ALL SELECT doc_id, 0 AS line, text AS body FROM lines WHERE len(l) > 1),
ub AS (SELECT DISTINCT doc_id, line, {pairs} AS g FROM (SELECT doc_id, line, regexp_extract_all({low.format('body')}, '[a-z0-9]+') AS w FROM units) WHERE len(w) > 0),
us AS (SELECT doc_id, line, count(*) AS a FROM ub GROUP BY ALL),
s AS (SELECT doc_id, line, template, count(*) AS c FROM ub JOIN tb USING (g) GROUP BY ALL),
d AS (SELECT doc_id, line, template, 2 * c / (a + b) AS dice, 200 * c >= {threshold} * (a + b) AS fits FROM s JOIN us USING (doc_id, line) JOIN ts USING (template))
SELECT doc_id, line, template, dice FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, template) AS r FROM d WHERE fits) WHERE r = 1
"""
