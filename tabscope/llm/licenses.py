"""License scans by patience alignment.

A text may hold a license notice anywhere, with words changed, left out or put in. Its
words are aligned with those of each template: words that occur once in both are
anchors, the longest increasing subsequence of anchors is kept, and the gaps between
them are aligned in the same way, where words are unique again that were not before.
The coverage is the share of the template's words that are aligned.

Only stretches that can reach the least coverage are aligned: a stretch of at most
``STRETCH`` times the template's length with enough of its words, counted as a bag,
which bounds the coverage from above. So prose costs one look at each word.

Defined cases: null and empty texts have no hit; every hit of a text is reported, of
overlapping hits of one template the best, then the first; a hit that lies inside a
hit of a longer template, with no higher number of aligned words, is part of that one;
repeated rows and null ids give rows of their own; an empty table gives no rows;
further columns are passed through.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tabscope.llm.common import map_columns, texts

LEAST_COVERAGE, STRETCH = 0.8, 1.5

#: Common notices, as public texts have them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution."
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of "
        "its contributors may be used to endorse or promote products derived from this software without specific "
        "prior written permission."
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means."
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
}
MARKS = ".,;:!?\"'()[]{}<>*_`"


def words(text: str) -> list[str]:
    return [w.strip(MARKS) for w in text.lower().split()]


@dataclass
class Template:
    name: str
    words: list[str]

    def __post_init__(self):
        self.bag = Counter(self.words)
        self.least = LEAST_COVERAGE * len(self.words)
        self.reach = max(len(self.words), int(STRETCH * len(self.words)))


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by the first) that increases in the second."""
    tails: list[int] = []
    places: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back.append(places[k - 1] if k else -1)
        if k == len(tails):
            tails.append(b)
            places.append(i)
        else:
            tails[k], places[k] = b, i
    out, i = [], places[-1] if places else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both.

    Equal ends are matched first, as a gap without unique words has nothing else to
    hold on to. A stack stands in for recursion.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        count_a, count_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if count_b[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if count_a[w] == 1 and w in place])
        edge_a, edge_b = a0, b0
        for i, j in anchors:
            out.append((i, j))
            todo.append((edge_a, i, edge_b, j))
            edge_a, edge_b = i + 1, j + 1
        if anchors:
            todo.append((edge_a, a1, edge_b, b1))
    return sorted(out)


def _stretches(doc: list[str], t: Template) -> list[tuple[int, int]]:
    """Maximal stretches of the text whose windows hold enough words of the template."""
    at = [i for i, w in enumerate(doc) if w in t.bag]
    out: list[list[int]] = []
    have: Counter = Counter()
    covered, first = 0, 0
    for i in at:
        w = doc[i]
        have[w] += 1
        covered += have[w] <= t.bag[w]
        while at[first] <= i - t.reach:
            old = doc[at[first]]
            covered -= have[old] <= t.bag[old]
            have[old] -= 1
            first += 1
        if covered >= t.least:
            if out and at[first] <= out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([at[first], i + 1])
    return [(s, e) for s, e in out]


def hits(text: str, templates: list[Template]) -> list[tuple[int, int, str, int, float]]:
    """(first word, end word, template, aligned words, coverage) of all notices in a text."""
    present = {w.strip(MARKS) for w in set(text.lower().split())}
    doc: list[str] | None = None
    found = []
    for t in templates:
        if sum(n for w, n in t.bag.items() if w in present) < t.least:
            continue
        doc = words(text) if doc is None else doc
        for start, end in _stretches(doc, t):
            while start < end:
                best = None
                # every window of a stretch that starts at a word of the template
                for s in range(start, end):
                    if doc[s] not in t.bag:
                        continue
                    pairs = align(t.words, doc[s : min(end, s + t.reach)])
                    if len(pairs) >= t.least and (best is None or len(pairs) > best[3]):
                        best = (s + pairs[0][1], s + pairs[-1][1] + 1, t.name, len(pairs), len(pairs) / len(t.words))
                        if len(pairs) == len(t.words):
                            break
                    if best is not None and s >= best[1]:
                        break
                if best is None:
                    break
                found.append(best)
                start = best[1]
    found.sort(key=lambda h: (h[0], -h[1], h[2]))
    return [
        h
        for h in found
        if not any(o is not h and o[0] <= h[0] and h[1] <= o[1] and o[3] > h[3] for o in found)
    ]


def scan_licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(``_doc``, n_hits, licenses, best_coverage, hits) of every row.

    ``licenses`` are the names found, sorted, comma-joined; ``hits`` are
    name:first word:end word:aligned words, in order, comma-joined.
    """
    ready = [Template(n, words(t)) for n, t in (templates or TEMPLATES).items()]
    wide = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{text}`").cast("string").alias("_text")
    )
    fields = [("n_hits", LongType()), ("licenses", StringType()), ("best_coverage", DoubleType()), ("hits", StringType())]

    def run(batch, _) -> dict:
        found = [hits(t, ready) for t in texts(batch, "_text")]
        return {
            "_doc": batch.column(0),
            "n_hits": [len(f) for f in found],
            "licenses": [",".join(sorted({h[2] for h in f})) for f in found],
            "best_coverage": [max((h[4] for h in f), default=0.0) for f in found],
            "hits": [",".join(f"{h[2]}:{h[0]}:{h[1]}:{h[3]}" for h in f) for f in found],
        }

    return map_columns(wide, run, StructType([wide.schema["_doc"], *[StructField(n, t) for n, t in fields]]))
