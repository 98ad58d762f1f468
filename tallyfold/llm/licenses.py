"""License scans: winnowed fingerprints find candidates, banded alignment decides.

Templates and texts become words; hashes of GRAM words in a row are winnowed (the
smallest of every WINDOW neighbours stays), which keeps one common fingerprint of any
common run of GRAM + WINDOW - 1 words. The fingerprints of the templates are an
inverted index (hash to template and place; its size is that of the template
list, never of the data). A hit of a template is a candidate diagonal;
a local alignment inside a band around it gives the words matched, the share of
the template that they cover, and the span in the text. The words that tell a license from its
neighbours (name, version) must all be there, in a row and in place, whatever the coverage. Of
matches that overlap in a text the best stays. The full texts of the long licenses (folder
license_texts) are templates by section, so that a part of one is found where it stands and a whole
one is covered from its first section to its last; lines with an SPDX identifier are found by it.

Long templates share phrases with many others, so a band must hold a fingerprint for every
PER_FINGERPRINT words of its template (one at least) before it is aligned: half of what stays in common
where a fifth of the words are changed, missing or new, wherever they are.

Defined cases: null and empty texts match nothing; ids (null, repeated) are carried along;
every row is scanned whole; rows without a match are not reported.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import columns, documents, places_in, small_batches, texts_of
from tallyfold.llm.decontaminate import _WORD, seeds
from tallyfold.llm.shingles import hashes_of

GRAM, WINDOW, BAND = 3, 2, 6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of a template's words that a match must cover.
COVERAGE = 0.8
#: Words of a template for each fingerprint that its band must hold.
PER_FINGERPRINT = 20
#: Sections of fewer words are no templates.
SECTION_WORDS = 20
#: Words of a text whose candidates are counted at a time.
PIECE = 50_000

# License notices and texts, by license.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION "
        '1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and "
        "distribute verbatim copies of this license document, but changing it is not allowed.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and "
        "distribute verbatim copies of this license document, but changing it is not allowed.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and "
        "distribute verbatim copies of this license document, but changing it is not allowed.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and "
        "distribute verbatim copies of this license document, but changing it is not allowed.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and "
        "distribute verbatim copies of this license document, but changing it is not allowed.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the '
        "creation of, or owns Covered Software.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-3.0": ["Licensed under CC BY-NC 3.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-SA-3.0": ["Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-ND-3.0": ["Licensed under CC BY-ND 3.0.", "This work is licensed under a Creative Commons Attribution-NoDerivs 3.0 Unported License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-SA-3.0": ["Licensed under CC BY-NC-SA 3.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY-NC-ND-3.0": ["Licensed under CC BY-NC-ND 3.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-3.0": ["Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
}
# Words of every match of a license, in a row; alternatives are separated by |.
_THREE, _TWO = "version 3|v3|license 3", "version 2|v2|license 2"
DECIDING: dict[str, list[str]] = {
    "Apache-2.0": ["apache license version 2 0|apache license 2 0|apache license v2 0"],
    "MIT": ["mit|shall be included in all copies"],
    "BSD-3-Clause": ["endorse or promote"],
    "Unlicense": ["unencumbered software|public domain"],
    "ISC": ["permission notice appear"],
    "GPL-3.0": ["gnu general", _THREE],
    "GPL-2.0": ["gnu general", _TWO],
    "LGPL-3.0": ["gnu lesser general", _THREE],
    "LGPL-2.1": ["gnu lesser general", "version 2 1|v2 1|license 2 1"],
    "AGPL-3.0": ["gnu affero general", _THREE],
    "MPL-2.0": ["mozilla public license v 2 0|mozilla public license v2 0|mozilla public license version 2 0|mozilla public license 2 0"],
    "CC-BY-NC-4.0": ["cc by nc 4 0|attribution noncommercial 4 0"],
    "CC-BY-NC-3.0": ["cc by nc 3 0|attribution noncommercial 3 0"],
    "CC-BY-SA-4.0": ["cc by sa 4 0|attribution sharealike 4 0"],
    "CC-BY-SA-3.0": ["cc by sa 3 0|attribution sharealike 3 0"],
    "CC-BY-ND-4.0": ["cc by nd 4 0|attribution noderivatives 4 0|attribution noderivs 4 0"],
    "CC-BY-ND-3.0": ["cc by nd 3 0|attribution noderivatives 3 0|attribution noderivs 3 0"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0|attribution noncommercial sharealike 4 0"],
    "CC-BY-NC-SA-3.0": ["cc by nc sa 3 0|attribution noncommercial sharealike 3 0"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0|attribution noncommercial noderivatives 4 0|attribution noncommercial noderivs 4 0"],
    "CC-BY-NC-ND-3.0": ["cc by nc nd 3 0|attribution noncommercial noderivatives 3 0|attribution noncommercial noderivs 3 0"],
    "CC-BY-4.0": ["cc by 4 0|attribution 4 0"],
    "CC-BY-3.0": ["cc by 3 0|attribution 3 0"],
}
#: Words between a match and the next one, or the end, that make it another license.
NOT_BEFORE = {"BSD-2-Clause": ["endorse or promote", "advertising materials mentioning"]}
#: A line that only names a license by its identifier, as the licenses are named here.
IDENTIFIER = "SPDX-License-Identifier: "
#: Licenses with a full text in the folder, and what ends the terms in it.
FULL_TEXTS = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]
_TERMS_END = re.compile(r"^ *END OF TERMS AND CONDITIONS|^Exhibit A - ", re.M)
_HEADING = re.compile(r"^[ *]*(\d+)\. ", re.M)
#: Sections of a license that are another's too, if that one's notice or title is the last before them.
SHARED_SECTIONS = {"GPL-3.0": "AGPL-3.0"}


def full_texts() -> dict[str, str]:
    folder = resources.files("tallyfold.llm") / "license_texts"
    return {name: (folder / f"{name}.txt").read_text(encoding="utf-8") for name in FULL_TEXTS}


def sections(text: str) -> list[tuple[str, str]]:
    """(number, text) of the sections of a full license text, up to the end of its terms; ``preamble`` is what comes before them."""
    end = _TERMS_END.search(text)
    text = text[: end.start()] if end else text
    names, starts = ["preamble"], [0]
    for m in _HEADING.finditer(text):
        number = int(m[1])
        if number == int(names[-1]) + 1 if len(names) > 1 else number < 2:
            names.append(str(number))
            starts.append(m.start())
    return [(name, text[a:b]) for name, a, b in zip(names, starts, [*starts[1:], len(text)], strict=True)]


def winnow(h: np.ndarray) -> np.ndarray:
    """Places of the fingerprints among the gram hashes: the last smallest of each window."""
    if len(h) <= WINDOW:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, dtype=np.int64)
    stack = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    return np.unique(np.arange(len(stack)) + WINDOW - 1 - np.argmin(stack[:, ::-1], axis=1))


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates: dict[str, list[str]], deciding: dict[str, list[str]] | None = None, full: dict[str, str] | None = None):
        phrases = {name: [[f" {p} " for p in w.split("|")] for w in (deciding or {}).get(name, [])] for name in templates}
        self.names, self.words, self.deciding, self.sections = [], [], [], []
        for name, texts in templates.items():
            for t in texts:
                self._add(name, t, phrases[name])
        if deciding is not None:
            for name in templates:
                # The identifier, whole and in a row.
                self._add(name, IDENTIFIER + name, [[f" {' '.join(_WORD.findall(name.lower()))} "]])
        for name, text in (full or {}).items():
            for number, part in sections(text):
                if len(_WORD.findall(part.lower())) >= SECTION_WORDS:
                    self._add(name, part, [], number)
        self.least = np.array([max(1, len(w) // PER_FINGERPRINT) for w in self.words], dtype=np.int64)
        self.longest = max(map(len, self.words), default=0)
        places = []
        for t, words in enumerate(self.words):
            if len(words) < GRAM + WINDOW - 1:
                raise ValueError(f"template of {self.names[t]} is too short to be found for certain")
            grams = seeds(hashes_of(words), "1" * GRAM)
            places += [(int(grams[p]), t, p) for p in winnow(grams).tolist()]
        places.sort()
        self.keys, first = np.unique(np.array([x[0] for x in places], dtype=np.uint64), return_index=True)
        self.first = np.append(first, len(places))
        self.template = np.array([x[1] for x in places], dtype=np.int64)
        self.place = np.array([x[2] for x in places], dtype=np.int64)

    def _add(self, name: str, text: str, deciding: list, section: str = "") -> None:
        self.names.append(name)
        self.words.append(_WORD.findall(text.lower()))
        self.deciding.append(deciding)
        self.sections.append(section)

    def decided(self, t: int, text: list[str], matched: int, first: int, last: int) -> bool:
        """True if the template's deciding words are in the match; those at its ends may be beside it."""
        missing = len(self.words[t]) - matched
        span = f" {' '.join(text[max(0, first - missing) : last + missing])} "
        return all(any(p in span for p in each) for each in self.deciding[t])

    def continues(self, t: int, text: list[str], last: int, end: int) -> bool:
        """True if the words from ``last`` to ``end`` make the match another license."""
        unlike = NOT_BEFORE.get(self.names[t])
        return bool(unlike) and any(f" {p} " in f" {' '.join(text[last:end])} " for p in unlike)

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Places among the gram hashes of a text that are fingerprints of a template."""
        at = winnow(h)
        if not len(at):
            return at
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        return at[self.keys[k] == h[at]]

    def candidates(self, at: np.ndarray, h: np.ndarray, piece: int = PIECE) -> Iterator[tuple[int, int, int]]:
        """(place in the text, template, place in it) of the hits whose band holds enough of them, by place in the text."""
        reach = self.longest + 2 * BAND
        for start in range(0, int(at[-1]) + 1, piece):
            hits = at[slice(*np.searchsorted(at, [start - reach, start + piece + reach]))]
            k = np.searchsorted(self.keys, h[hits])
            many = self.first[k + 1] - self.first[k]
            p = np.repeat(hits, many)
            each = np.arange(len(p)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.first[k], many)
            t, q = self.template[each], self.place[each]
            # Templates far apart, so that no band reaches from one into the next.
            line = t * (int(h.size) + 2 * reach) + p - q
            in_order = np.sort(line)
            near = np.searchsorted(in_order, line + BAND, side="right") - np.searchsorted(in_order, line - BAND)
            ok = (near >= self.least[t]) & (p >= start) & (p < start + piece)
            yield from zip(p[ok].tolist(), t[ok].tolist(), q[ok].tolist(), strict=True)


def align(text: list[str], template: list[str], diagonal: int) -> tuple[int, int, int, int] | None:
    """(score, matched, first word, last word + 1) of the best local alignment in the band.

    Row i of the template meets words i + diagonal - BAND to i + diagonal + BAND.
    """
    width = 2 * BAND + 1
    empty = (0, 0, -1, -1)
    before, best, off = [empty] * width, empty, width
    for i, word in enumerate(template):
        row = [empty] * width
        for b in range(width):
            j = i + diagonal + b - BAND
            if not 0 <= j < len(text):
                continue
            s, m, f, _ = before[b]
            if text[j] == word:
                cell = (s + MATCH, m + 1, f if s else j, j + 1)
            else:
                cell = (s + MISMATCH, m, f, j + 1) if s + MISMATCH > 0 else empty
            if b + 1 < width and before[b + 1][0] + GAP > cell[0]:  # a template word is missing
                s, m, f, e = before[b + 1]
                cell = (s + GAP, m, f, e)
            if b and row[b - 1][0] + GAP > cell[0]:  # the text has one word more
                s, m, f, e = row[b - 1]
                cell = (s + GAP, m, f, e)
            row[b] = cell
            if (cell[0], cell[1], -abs(b - BAND)) > (best[0], best[1], -off):  # of equals the one nearest to the hit
                best, off = cell, abs(b - BAND)
        before = row
    return best if best[0] else None


def scan_text(text: str, index: Index, hit_at: np.ndarray, grams: np.ndarray) -> list[tuple[str, float, int, int, int, str]]:
    """(license, coverage, matched words, start, end, section) of one text, in order of place."""
    lower = text.lower()
    found = [m for m in _WORD.finditer(lower)]
    words = [m[0] for m in found]
    results, seen, last = set(), set(), {}
    for p, t, q in index.candidates(hit_at, grams):
        if (t, p - q) in seen or p < last.get(t, 0):
            continue  # this diagonal, or a match over this place, is known
        seen.add((t, p - q))
        a = align(words, index.words[t], p - q)
        if a and a[1] >= COVERAGE * len(index.words[t]) and index.decided(t, words, *a[1:]):
            results.add((a[0], a[1], t, a[2], a[3]))
            last[t] = a[3]
    kept: list = []  # by place; none overlaps another, so a match is held against its two neighbours
    for r in sorted(results, key=lambda r: (-r[0], -r[1], r[3], r[2])):
        at = bisect(kept, r[3], key=lambda k: k[3])
        if (at == 0 or kept[at - 1][4] <= r[3]) and (at == len(kept) or r[4] <= kept[at][3]):
            kept.insert(at, r)
    # Up to the next match, whose own words these are, or to the end of the text.
    ends = [*(r[3] for r in kept[1:]), len(words)][: len(kept)]
    kept = [r for r, end in zip(kept, ends, strict=True) if not index.continues(r[2], words, r[4], end)]
    place = places_in(text, lower)
    out, named = [], {}
    for _, m, t, f, e in kept:
        name, section = index.names[t], index.sections[t]
        for of, other in SHARED_SECTIONS.items():
            if section in ("", "preamble") and name in (of, other):
                named[of] = name
            elif section and name == of:
                name = named.get(of, of)
        span = place(found[f].start(), found[e - 1].end())
        out.append((name, m / len(index.words[t]), m, *span, section))
    return out


def license_matches(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, full: dict[str, str] | None = None
) -> DataFrame:
    """``doc_id, license, coverage, matched, span_start, span_end, section``: one row per match.

    ``section`` is empty for notices, openings and identifiers, else the part of the full text.
    ``templates`` and ``full`` (full texts by license) replace those built in.
    """
    own = templates is not None or full is not None
    shared = docs.sparkSession.sparkContext.broadcast((templates or {}, None, full) if own else (TEMPLATES, DECIDING, full_texts()))
    schema = "doc_id long, license string, coverage double, matched int, span_start int, span_end int, section string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for b in small_batches(batches):
            ids, rows = b.column(0).to_pylist(), []
            for i, text in zip(ids, texts_of(b.column(1)), strict=True):
                grams = seeds(hashes_of(_WORD.findall(text.lower())), "1" * GRAM)
                at = index.hits(grams)
                if len(at):
                    rows += [(i, *m) for m in scan_text(text, index, at, grams)]
            cols = list(zip(*rows, strict=True)) or [[]] * len(names)
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices and texts in every whole document."""
    return license_matches(documents(spark, sf_dir))
