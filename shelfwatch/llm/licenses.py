"""License scans by patience alignment.

A text and a template are compared word by word. Words that occur once in both are anchors; the longest run of anchors in the
order of both is kept, and the gaps between them are aligned in the same way, after the equal words at their ends. The
template's share of aligned words is its coverage.

A template's deciding phrases (name, version, by-sa or by-nc) must stand in the text word by word, whatever the coverage: the first is
looked up, and the words before and after each of its places are aligned with those before and after it in the template. Templates
of fewer than `SHORT` words may lack one word besides. Templates without phrases are looked for in overlapping windows of twice their
length; the number of words that window and template share bounds the coverage from above.

Defined cases: a null or empty text has no license; rows with equal doc_id or text are scanned each; every place is told, of overlapping
places of one template the best covered; of templates with equal coverage the longer wins, then the first by name; extra columns
are passed by; texts of any length are scanned whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shelfwatch.llm.common import table

#: Notices of well-known licenses, as they stand in files.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied."
    ),
    "BSD redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software"
    ),
}
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
SHORT = 20
#: The words of a template that must stand in a text as they are and side by side.
DECIDING = {
    "Apache-2.0": ["Apache License, Version 2.0"],
    "Apache-2.0 notice": ["Apache License, Version 2.0"],
    "BSD redistribution": ["source and binary forms"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "GPL-3.0": ["GNU General Public License, version 3"],
    "GPL notice": ["GNU General Public License", "version 3 of the License"],
    "MIT": ["MIT License"],
    "MIT permission": ["in the Software without restriction"],
}
#: Names under which licenses are granted in one line.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License version 3", "GNU AGPL v3", "AGPLv3", "AGPL-3.0"],
    "Apache-1.1": ["Apache License, Version 1.1", "Apache License 1.1", "Apache Software License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "Artistic-2.0": ["Artistic License 2.0"],
    "BSD": ["BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
    "CC0-1.0": ["CC0 1.0", "CC0-1.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License v. 2.0"],
    "GPL-2.0": ["GNU General Public License version 2", "GNU GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License version 3", "GNU GPL v3", "GPLv3", "GPL-3.0"],
    "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License version 2.1", "GNU LGPL v2.1", "LGPLv2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License version 3", "GNU LGPL v3", "LGPLv3", "LGPL-3.0"],
    "MIT": ["MIT License"],
    "MPL-1.1": ["Mozilla Public License version 1.1", "Mozilla Public License 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v. 2.0", "MPL 2.0"],
}
SPDX = "AGPL-3.0-only AGPL-3.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later 0BSD Unlicense Zlib BSL-1.0"
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
           "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
GNU_NOTICE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free "
    "Software Foundation, either version {} of the License, or (at your option) any later version."
)
BSD_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
    "this software without specific prior written permission. "
)
BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Longer wordings, each with its deciding phrases.
LONG = {
    "AGPL-3.0 notice": (GNU_NOTICE.format("Affero General Public License", 3), ["GNU Affero General Public License", "version 3 of the License"]),
    "GPL-2.0 notice": (GNU_NOTICE.format("General Public License", 2), ["GNU General Public License", "version 2 of the License"]),
    "LGPL-2.1 notice": (GNU_NOTICE.format("Lesser General Public License", 2.1), ["GNU Lesser General Public License", "version 2.1 of the License"]),
    "LGPL-3.0 notice": (GNU_NOTICE.format("Lesser General Public License", 3), ["GNU Lesser General Public License", "version 3 of the License"]),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["Mozilla Public License, v. 2.0"]),
    "BSD-2-Clause text": (BSD_CLAUSES + BSD_DISCLAIMER, ["provided with the distribution. This software is provided"]),
    "BSD-3-Clause text": (BSD_CLAUSES + BSD_THIRD + BSD_DISCLAIMER, ["endorse or promote products derived from this software"]),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
        "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", ["this permission notice appear in all copies"]),
    "MIT text": (
        TEMPLATES["MIT permission"].replace("associated documentation files, ", 'associated documentation files (the "Software"), ')
        + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS '
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE.", ["in the Software without restriction", "shall be included in all copies"]),
}
#: Files of whole license texts and the phrases that decide them.
TEXTS = {
    "Apache-2.0": ["Apache License Version 2.0, January 2004"],
    "Artistic": ['The "Artistic License"'],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "GPL-1": ["GNU General Public License Version 1, February 1989"],
    "GPL-2": ["GNU General Public License Version 2, June 1991"],
    "GPL-3": ["GNU General Public License Version 3, 29 June 2007"],
    "LGPL-2": ["GNU Library General Public License Version 2, June 1991"],
    "LGPL-2.1": ["GNU Lesser General Public License Version 2.1, February 1999"],
    "LGPL-3": ["GNU Lesser General Public License Version 3, 29 June 2007"],
    "MPL-1.1": ["Mozilla Public License Version 1.1"],
    "MPL-2.0": ["Mozilla Public License Version 2.0"],
}


def all_templates() -> tuple[dict[str, str], dict[str, list[str]]]:
    """Wordings by key, and their deciding phrases; a key is the reported name, with #number where a name has several wordings."""
    texts, phrases = dict(TEMPLATES), dict(DECIDING)

    def add(name: str, wordings: list[tuple[str, list[str]]]) -> None:
        for n, (wording, deciding) in enumerate(wordings):
            texts[f"{name}#{n}"], phrases[f"{name}#{n}"] = wording, deciding

    commons = {}
    for parts, title in COMMONS.items():
        for version in ("2.0", "2.5", "3.0", "4.0"):
            commons[f"CC-{parts}-{version}"] = [f"CC {parts} {version}", f"CC-{parts} {version}", f"CC-{parts}-{version}", f"Creative Commons {title} {version}"]
    for name, titles in (NAMES | commons).items():
        # any verb may stand before it, and a few words between
        add(f"{name} named", [(f"under {t}", [t, "under"]) for t in titles])
    for name in {*SPDX.split(), *NAMES, *commons} - {"BSD"}:
        add(f"{name} SPDX", [(f"SPDX-License-Identifier: {name}", [f"SPDX-License-Identifier: {name}"])])
    for name, wording in LONG.items():
        add(name, [wording])
    for name, deciding in TEXTS.items():
        add(f"{name} text", [(Path(__file__).with_name("license_texts").joinpath(f"{name}.txt").read_text(), deciding)])
    return texts, phrases


def patience_align(text: list, template: list) -> list[tuple[int, int]]:
    """Pairs of places with equal words, rising in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        place = {w: j for j, w in enumerate(template[c:d], c) if in_template[w] == 1 and in_text.get(w) == 1}
        anchors = rising([(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place])
        if not anchors:
            continue
        found += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(edges, edges[1:])]
    return sorted(found)


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by their first, whose second rises."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        if pile == len(tops):
            tops.append(j)
            last.append(k)
        else:
            tops[pile], last[pile] = j, k
        back[k] = last[pile - 1] if pile else -1
    chosen, k = [], last[-1] if last else -1
    while k >= 0:
        chosen.append(pairs[k])
        k = back[k]
    return chosen[::-1]


def places_of(phrase: list, words: list, at: dict[str, list[int]] | None = None) -> list[int]:
    """Where `phrase` stands in `words`; `at` has the places of every word."""
    starts = range(len(words)) if at is None else at.get(phrase[0], [])
    return [i for i in starts if words[i : i + len(phrase)] == phrase]


class Scanner:
    def __init__(self, templates: dict[str, str], least: float, deciding: dict[str, list[str]] | None = None):
        self.least = least
        self.templates = []
        for key, text in sorted(templates.items()):
            words = WORD.findall(text.lower())
            phrases = [WORD.findall(p.lower()) for p in (DECIDING if deciding is None else deciding).get(key, [])]
            phrases = [(p, places_of(p, words)[0]) for p in phrases if places_of(p, words)]
            fewest = max(least * len(words), len(words) - 1 if len(words) < SHORT else 0)
            self.templates.append((key.split("#")[0], words, Counter(words), phrases, frozenset(w for p, _ in phrases for w in p), fewest))

    def scan(self, text: str) -> list[tuple[float, str, int, int]]:
        """(coverage, name, first and last character) of every place of every template that is covered well enough."""
        lower = text.lower()
        words, hits = None, []
        present = set(WORD.findall(lower))
        for name, template, needed, phrases, must, fewest in self.templates:
            if not must <= present or sum(n for w, n in needed.items() if w in present) < fewest:
                continue
            if words is None:
                spans = [(m.start(), m.end()) for m in WORD.finditer(lower)]
                words = [lower[a:b] for a, b in spans]
                at: dict[str, list[int]] = {}
                for i, w in enumerate(words):
                    at.setdefault(w, []).append(i)
            size = len(template)
            found = []
            for pairs in self.pinned(words, at, template, phrases) if phrases else self.windows(words, template, needed, fewest):
                if pairs and len(pairs) >= fewest:
                    found.append((-len(pairs), pairs[-1][0] - pairs[0][0], pairs[0][0], pairs[-1][0]))
            taken: list[tuple[int, int]] = []
            for covered, _, first, last in sorted(found):
                if all(last < a or first > b for a, b in taken):
                    taken.append((first, last))
                    hits.append((-size, (-covered / size, name, spans[first][0], spans[last][1])))
        hits = sorted(hits, key=lambda h: (-h[1][0], h[0], *h[1][1:]))
        return list(dict.fromkeys(h for _, h in hits))

    def pinned(self, words, at, template, phrases):
        """Alignments around each place of the first phrase that hold the others as they are too."""
        (phrase, begin), others = phrases[0], phrases[1:]
        size, end, slack = len(template), begin + len(phrase), max(4, len(template) // 2)
        for place in places_of(phrase, words, at):
            after = place + len(phrase)
            low = max(0, place - begin - slack)
            pairs = [(low + i, j) for i, j in patience_align(words[low:place], template[:begin])]
            pairs += [(place + n, begin + n) for n in range(len(phrase))]
            pairs += [(after + i, end + j) for i, j in patience_align(words[after : after + size - end + slack], template[end:])]
            stands = {j: i for i, j in pairs}
            if all(stands.get(b + n, -1) == stands.get(b, -2) + n for p, b in others for n in range(len(p))):
                yield pairs

    def windows(self, words, template, needed, fewest):
        size = len(template)
        starts = sorted({i // size * size for i, w in enumerate(words) if w in needed})
        for start in sorted({s for i in starts for s in (max(0, i - size), i)}):
            window = words[start : start + 2 * size]
            if sum((Counter(w for w in window if w in needed) & needed).values()) >= fewest:
                yield [(start + i, j) for i, j in patience_align(window, template)]


PLACES = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_char", pa.int64()), ("last_char", pa.int64())]))
SCAN_FIELDS = {
    "license string": pa.string(), "coverage double": pa.float64(), "first_char long": pa.int64(), "last_char long": pa.int64(), "licenses string": pa.string(),
    "places array<struct<license: string, coverage: double, first_char: long, last_char: long>>": PLACES,
}


def scan_licenses(docs: DataFrame, keep: list[str], templates: dict[str, str] | None = None, least: float = 0.8, deciding: dict[str, list[str]] | None = None) -> DataFrame:
    """`keep`, and for every document its best covered license with the place, null where none is, and all with all their places.

    `deciding` has the phrases of own `templates` that must stand in a text as they are.
    """
    chosen, phrases = (templates, deciding or {}) if templates else all_templates()
    names, kinds = [f.split()[0] for f in SCAN_FIELDS], list(SCAN_FIELDS.values())

    def run(batches):
        scanner = Scanner(chosen, least, phrases)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows = []
                for text in part.column(part.schema.get_field_index("text")).to_pylist():
                    hits = scanner.scan(text or "")
                    coverage, name, first, last = hits[0] if hits else (0.0, None, None, None)
                    places = [{"license": h[1], "coverage": h[0], "first_char": h[2], "last_char": h[3]} for h in hits]
                    rows.append((name, coverage, first, last, ", ".join(dict.fromkeys(h[1] for h in hits)), places))
                made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                kept = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays(kept + made, names=[*keep, *names])

    kept_types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{kept_types}, {', '.join(SCAN_FIELDS)}")


def op10_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"), ["doc_id"])
