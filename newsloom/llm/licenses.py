"""License scans by patience alignment of texts with license notices.

Words that occur once in both the text and the notice are anchors; the longest run of anchors in the same order is kept,
and the gaps between them are aligned the same way, after equal words at their ends. The aligned share of the notice's
words is its coverage. A text is aligned only where enough of a notice's words lie close together, which is necessary
for the coverage asked for.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import table
from newsloom.llm.words import sliced, text_bytes, word_hashes, word_spans
from newsloom.session import tune

COVERAGE = 0.8

# Public license notices, as their licenses word them.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "Apache-2.0-text": (
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."
    ),
    "Apache-2.0-short": "Released under the Apache License 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-short": "Licensed under the GPL, version 3.",
    "GPL-3.0-title": "Licensed under the GNU GPL v3.",
    "GPL-3.0-text": (
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> "
        "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software"
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT-terms": "This project is licensed under the terms of the MIT License.",
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "BSD-2-Clause-line": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written permission."
    ),
    "BSD-3-Clause-line": "Released under the BSD 3-Clause License.",
    "ISC-line": "Released under the ISC License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-line": "Released under the Mozilla Public License 2.0.",
    "MPL-2.0-text": (
        "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to "
        "the creation of, or owns Covered Software."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
} | {
    f"CC-{code}-4.0-{form}": text.format(name)
    for code, name in (
        ("BY", "Attribution"),
        ("BY-SA", "Attribution-ShareAlike"),
        ("BY-NC", "Attribution-NonCommercial"),
        ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
        ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    )
    for form, text in (
        ("name", "Licensed under a Creative Commons {} 4.0 International License."),
        (
            "text",
            "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this "
            "Creative Commons {} 4.0 International Public License (\"Public License\").",
        ),
    )
}

#: Notices of at most so many words are single lines: the words that tell one license from another must all be aligned,
#: as the rest of such a line is the same for every license. In longer notices the word after "version" must be.
LINE_WORDS = 14
NAMING = frozenset("apache mit bsd isc gnu gpl mozilla cc by nc sa nd creative commons attribution noncommercial sharealike noderivatives clause".split())

_BORDER = np.ones(256, dtype=bool)
_BORDER[48:58] = _BORDER[65:91] = _BORDER[97:123] = _BORDER[128:] = False


def words_of(text: str) -> list[str]:
    """Runs of ASCII letters, digits and other non-ASCII characters, A-Z lower-cased."""
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text)]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first number, whose second numbers rise: patience piles with links."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        pile = bisect.bisect_left(tops, b)
        before[k] = at[pile - 1] if pile else -1
        tops[pile : pile + 1] = [b]
        at[pile : pile + 1] = [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(text: list, notice: list) -> list[tuple[int, int]]:
    """Places of equal words, in order in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(notice))]
    while todo:
        a, a_end, b, b_end = todo.pop()
        while a < a_end and b < b_end and text[a] == notice[b]:
            found.append((a, b))
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and text[a_end - 1] == notice[b_end - 1]:
            a_end, b_end = a_end - 1, b_end - 1
            found.append((a_end, b_end))
        if a == a_end or b == b_end:
            continue
        once_a, once_b = Counter(text[a:a_end]), Counter(notice[b:b_end])
        where = {w: k for k, w in enumerate(notice[b:b_end], b) if once_b[w] == 1}
        anchors = _rising([(k, where[w]) for k, w in enumerate(text[a:a_end], a) if once_a[w] == 1 and w in where])
        if not anchors:
            continue
        found.extend(anchors)
        borders = [(a - 1, b - 1), *anchors, (a_end, b_end)]
        todo.extend((x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(borders[:-1], borders[1:], strict=True) if x + 1 < x2 and y + 1 < y2)
    return sorted(found)


class Scanner:
    def __init__(self, notices: dict[str, str], coverage: float) -> None:
        self.coverage = coverage
        self.notices = []
        for name, text in notices.items():
            data, ends = text_bytes(pa.array([text]))
            begin, end, _ = word_spans(data, ends, _BORDER)
            hashes, words = word_hashes(data, begin, end).tolist(), words_of(text)
            naming = [w in NAMING or w.strip("v").isdigit() if len(words) <= LINE_WORDS else before == "version" for before, w in zip(["", *words], words)]
            needed = {k for k, named in enumerate(naming) if named}
            self.notices.append((name, hashes, needed))
        self.known = np.unique(np.array([w for _, n, _ in self.notices for w in n], dtype=np.uint64))

    def find(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first byte, end byte) of the notices in one text, the longest of those that overlap."""
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        held = np.flatnonzero(self.known[at] == words)
        if not len(held):
            return []
        present = set(words[held].tolist())
        found = []
        for name, notice, needed in self.notices:
            if not all(notice[k] in present for k in needed):
                continue
            vocabulary = set(notice)
            # At most the words of the notice that the text holds can be aligned.
            if sum(w in present for w in notice) < self.coverage * len(notice):
                continue
            places = [p for p in held.tolist() if int(words[p]) in vocabulary]
            reach, k = len(notice) + len(notice) // 2 + 4, 0
            while k < len(places):
                upto = bisect.bisect_left(places, places[k] + reach)
                near = {int(words[p]) for p in places[k:upto]}
                if upto - k >= self.coverage * len(notice) and sum(w in near for w in notice) >= self.coverage * len(notice):
                    start = places[k]
                    matched = align(words[start : start + reach].tolist(), notice)
                    if len(matched) >= self.coverage * len(notice):
                        # The window may end inside the notice: once more from where the notice begins.
                        again = start + matched[0][0]
                        whole = align(words[again : again + reach].tolist(), notice)
                        if len(whole) > len(matched):
                            start, matched = again, whole
                        if not needed <= {b for _, b in matched}:
                            k += 1
                            continue
                        last = start + matched[-1][0]
                        first = start + matched[0][0]
                        found.append((len(matched), len(matched) / len(notice), name, first, last))
                        k = bisect.bisect_right(places, last)
                        continue
                k += 1
        kept: list[tuple] = []
        for hit in sorted(found, key=lambda h: (-h[0], -h[1], h[3], h[2])):
            if all(hit[4] < k[3] or hit[3] > k[4] for k in kept):
                kept.append(hit)
        return [(name, c, int(begin[a]), int(end[b])) for _, c, name, a, b in sorted(kept, key=lambda h: h[3])]


def _scan(notices: dict[str, str], coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, coverage)
        spans = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in sliced(batch, "text"):
                data, ends = text_bytes(part.column("text"))
                begin, end, first = word_spans(data, ends, _BORDER)
                words = word_hashes(data, begin, end)
                out = []
                for k in range(part.num_rows):
                    own = slice(first[k], first[k + 1])
                    hits = scanner.find(words[own], begin[own] - ends[k], end[own] - ends[k])
                    out.append([{"license": n, "coverage": c, "start": a, "end": b} for n, c, a, b in hits])
                yield pa.record_batch([part.column("doc_id"), pa.array(out, spans)], names=["doc_id", "found"])

    return run


def scan_licenses(docs: DataFrame, notices: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id and found (license, coverage, byte span) for every row of docs.

    A notice counts where at least the share coverage of its words is aligned, for a single line among them those that
    name the license and its version; of notices that overlap the one with more
    aligned words counts. A null or empty text finds nothing. Repeated rows find the same, a null doc_id stays null. An
    empty table gives none. Columns other than doc_id and text are not read.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan(notices or NOTICES, coverage), "doc_id long, found array<struct<license:string,coverage:double,start:long,end:long>>")


def op5_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(table(spark, folder, "documents"))
    return found.select("doc_id", F.array_sort(F.array_distinct("found.license")).alias("licenses"), F.array_max("found.coverage").alias("coverage"), F.size("found").cast("long").alias("notices"))
