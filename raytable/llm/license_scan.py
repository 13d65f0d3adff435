"""License scans: patience alignment of license templates with whole texts.

At least one of a few telling words of a template must stand in any text that covers it (``needed`` below), so only windows
around those words are aligned: the place of the template as the word implies it, and a quarter of its length on either side. An alignment anchors on words unique to both window and template, takes the longest
increasing subsequence of anchors and aligns the gaps between them in the same way; equal words at the ends of a gap count
as they stand. Where that gives no whole copy, the longest common subsequence is taken from every first word in reach of the
density, by bit-parallel rows. A span is reported when it covers ``COVERAGE`` of the template, is no longer than the template over
``DENSITY`` and holds the phrases of ``MUST``, which tell versions apart.

Templates are a table of constants (name, text) and can be replaced; a broadcast closure of fixed size carries them. The scan
is one map over the documents. Defined cases: null, empty and word-less texts have no license; repeated rows are scanned one
by one; spans of one template do not overlap, the better one (then the earlier) stays; extra columns pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once, prepare, utf8

COVERAGE, DENSITY = 0.85, 0.5
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+(?:\.[0-9]+)*")
_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

# Public license notices as their authors publish them.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published
by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "LGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSD-3-Clause-terms": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.""",
    "CC-BY-4.0": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
}
_SPDX = "MIT ISC BSD-2-Clause BSD-3-Clause Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MPL-2.0 CC-BY-4.0 CC-BY-SA-4.0".split()
TEMPLATES |= {f"SPDX-{x}": f"SPDX-License-Identifier: {x}" for x in _SPDX}
#: Phrases that tell versions and kin apart; a span must hold all of its template's, word for word.
MUST = {
    "Apache-2.0-notice": ["apache license version 2.0"], "Apache-2.0": ["apache license version 2.0"], "GPL-3.0-notice": ["gnu general public license", "version 3"],
    "GPL-3.0": ["gnu general public license", "version 3"], "GPL-2.0": ["gnu general public license", "version 2"], "LGPL-2.1": ["gnu lesser general public license", "version 2.1"],
    "LGPL-3.0": ["gnu lesser general public license", "version 3"], "MPL-2.0": ["mozilla public license v 2.0"], "CC-BY-4.0": ["attribution 4.0"], "CC-BY-SA-4.0": ["attribution sharealike 4.0"],
} | {f"SPDX-{x}": [f"spdx license identifier {x.lower().replace('-', ' ')}"] for x in _SPDX}
_COMMON = set(b"the of and to in is for or any this that with be by on it as an at are all you may not from".split())
SPANS = "array<struct<license:string,first:int,last:int,matched:int,coverage:double>>"


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.translate(_UPPER))


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience alignment of two word lists: increasing pairs of positions of equal words."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        in_a, in_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        at = {w: j for j, w in enumerate(b[blo:bhi], blo) if in_b[w] == 1 and in_a[w] == 1}
        anchors = _increasing([(i, at[w]) for i, w in enumerate(a[alo:ahi], alo) if w in at])
        if not anchors:
            continue
        i0, j0 = alo, blo
        for i, j in anchors:
            todo.append((i0, i, j0, j))
            i0, j0 = i, j
        todo.append((i0, ahi, j0, bhi))  # each gap but the first starts with its anchor, which the equal-ends rule takes
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence with increasing second parts, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        before[k] = piles[p - 1] if p else -1
        if p == len(tops):
            tops.append(j)
            piles.append(k)
        else:
            tops[p], piles[p] = j, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, density: float = DENSITY):
        self.density = density
        self.templates = {n: words(t.encode()) for n, t in templates.items()}
        self.needed = {n: max(1, -(-round(len(t) * coverage * 1000) // 1000)) for n, t in self.templates.items()}
        self.must = {n: [m.encode().split() for m in MUST.get(n, ()) if TEMPLATES.get(n) == t] for n, t in templates.items()}
        self.masks = {n: {w: sum(1 << i for i, x in enumerate(t) if x == w) for w in set(t)} for n, t in self.templates.items()}
        self.own = {n: Counter(t) for n, t in self.templates.items()}
        used = Counter(w for t in self.templates.values() for w in set(t))
        self.seeds: dict[bytes, list[tuple[str, int]]] = {}
        for name, t in self.templates.items():
            own = Counter(t)
            # a text that covers the template lacks at most len - needed of its words: one more telling words than that must do
            order = sorted(own, key=lambda w: (w in _COMMON, used[w], own[w], -len(w), w))
            taken = 0
            for w in order:
                if taken > len(t) - self.needed[name]:
                    break
                taken += own[w]
                for j, x in enumerate(t):
                    if x == w:
                        self.seeds.setdefault(w, []).append((name, j))

    def scan(self, text: bytes) -> list[dict]:
        """Spans of licenses in word positions, by template and place."""
        lower = text.translate(_UPPER)
        if not any(w in lower for w in self.seeds):
            return []
        own = _WORD.findall(lower)
        found: dict[str, list[dict]] = {}
        tried: dict[str, set[int]] = {}
        for p, w in enumerate(own):
            for name, j in self.seeds.get(w, ()):
                span = self._at(own, name, p, j)
                if span and span not in found.setdefault(name, []):
                    found[name].append(span)
                if not span or span["matched"] < len(self.templates[name]):
                    found.setdefault(name, []).extend(self._reach(own, name, p, tried.setdefault(name, set())))
        out = []
        for spans in found.values():
            kept: list[dict] = []
            for s in sorted(spans, key=lambda s: (-s["matched"], s["last"] - s["first"], s["first"])):
                if all(s["last"] < k["first"] or s["first"] > k["last"] for k in kept):
                    kept.append(s)
            out += kept
        return sorted(out, key=lambda s: (s["license"], s["first"]))

    def _at(self, own: list[bytes], name: str, p: int, j: int) -> dict | None:
        t = self.templates[name]
        slack = max(2, len(t) // 4)
        low, high = max(0, p - j - slack), min(len(own), p - j + len(t) + slack)
        pairs = align(own[low:high], t)
        if len(pairs) < self.needed[name]:
            return None
        first, last = low + pairs[0][0], low + pairs[-1][0]
        if len(t) < self.density * (last - first + 1) or not self._told(own[first:last + 1], name):
            return None
        return {"license": name, "first": first, "last": last, "matched": len(pairs), "coverage": len(pairs) / len(t)}


    def _told(self, span: list[bytes], name: str) -> bool:
        return all(any(span[k:k + len(m)] == m for k in range(len(span) - len(m) + 1)) for m in self.must[name])

    def _reach(self, own: list[bytes], name: str, p: int, tried: set[int]) -> list[dict]:
        """Per first word, the longest common subsequence in any span around ``p`` that the density allows, by bit-parallel rows."""
        t, masks, needed = self.templates[name], self.masks[name], self.needed[name]
        width = int(len(t) / self.density)
        near = own[max(0, p - width + 1):p + width]
        if (self.own[name] & Counter(w for w in near if w in masks)).total() < needed:
            return []
        out, full = [], (1 << len(t)) - 1
        for first in range(max(0, p - width + 1), p + 1):
            if own[first] not in masks or first in tried:
                continue
            tried.add(first)
            row, best = full, None
            for last in range(first, min(len(own), first + width)):
                m = masks.get(own[last])
                if m:
                    u = row & m
                    row = ((row + u) | (row - u)) & full
                    matched = len(t) - row.bit_count()
                    if matched >= needed and (best is None or matched > best[0]) and self._told(own[first:last + 1], name):
                        best = matched, last
            if best:
                out.append({"license": name, "first": first, "last": best[1], "matched": best[0], "coverage": best[0] / len(t)})
        return out


def scanned(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, density: float = DENSITY) -> DataFrame:
    """``docs`` with an array column ``__licenses`` of spans in words."""
    prepare(docs.sparkSession)
    scanner = Scanner(templates, coverage, density)

    def scan(text: pa.Array) -> pa.Array:
        rows = [scanner.scan(t) for t in utf8(text)]
        kind = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("matched", pa.int32()), ("coverage", pa.float64())]))
        return pa.array(rows, kind)

    return docs.withColumn("__licenses", once(scan, SPANS)(F.col("text").cast("string")))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: how many license spans, the names found and the spans."""
    out = scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", F.size("__licenses").alias("n_spans"), F.array_join(F.array_sort(F.array_distinct("__licenses.license")), ",").alias("licenses"), F.col("__licenses").alias("spans"))
