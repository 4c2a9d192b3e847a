"""License scan by patience alignment of texts with license templates.

Texts and templates become words (letters and digits, lower case). Places in a text
where a window holds enough of a template's words are aligned with it: the words that
occur once in both are anchors, the longest increasing run of anchors stays, and the
gaps between two anchors are aligned the same way, where other words may be unique;
equal words next to an anchor are matched too. In a gap without such words those that
occur least often in both are anchors, by the order of their occurrences, so the
recursion goes on until a gap has no common word. Coverage is the matched part of the
template's words; the first and the last matched word are where a place begins and ends.
Slices are cut out before, by the length of the longest common subsequence with the
template (bit-parallel), so that neighbouring copies do not take each other's unique
words, and skipped when that length, or the number of the template's words in them, is
too small for the coverage asked for.

A notice names one license and version: its numbers follow the words before them, no
further word (``MODIFIERS``) comes between, and a number that the text joins to the place
with a hyphen, or to a number with a point, and that the template lacks, makes it another
license (MIT-0, version 2.1).

Each task holds the templates and one batch of texts. Defined results: null and empty
texts have no license; a text may hold several licenses, and one license several times
(in windows that do not overlap), each a row; of templates of one license that match the
same place the one with most words counts, and so does it among licenses whose texts
differ in a few words (``TELLING``), which must be there; repeated rows are scanned each; an empty table gives
an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import bisect
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence, Set

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgold.llm.common import python_tasks, text_of

COVERAGE = 0.8
WORDS = re.compile(r"[^\W_]+")

def _body(name: str) -> str:
    return pkgutil.get_data("fleetgold.llm", f"licenses/{name}.txt").decode()


def _gnu(name: str, version: str, subject: str = "program") -> str:
    return (
        f"This {subject} is free software: you can redistribute it and/or modify it under the terms of the {name} as "
        f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    )


def _gnu_work(name: str, version: str) -> str:
    return f"This work is licensed under the {name}, version {version}."


def _creative(name: str) -> str:
    return f"This work is licensed under a Creative Commons {name} 4.0 International License."


# Notices by which texts name their license and, where given, its whole text, by public license identifier.
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": [_gnu("GNU Affero General Public License", "3"), _gnu_work("GNU Affero General Public License", "3")],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        _body("Apache-2.0"),
    ],
    "Artistic-1.0": [_body("Artistic")],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", _body("BSD-2-Clause")],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
        _body("BSD-3-Clause"),
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", _creative("Attribution")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", _creative("Attribution-NonCommercial")],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", _creative("Attribution-NonCommercial-NoDerivatives")],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", _creative("Attribution-NonCommercial-ShareAlike")],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", _creative("Attribution-NoDerivatives")],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", _creative("Attribution-ShareAlike")],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Licensed under CC0 1.0 Universal.",
        _body("CC0-1.0"),
    ],
    "GPL-2.0": [_gnu_work("GNU General Public License", "2"), _gnu("GNU General Public License", "2"), _body("GPL-2")],
    "GPL-3.0": [_gnu_work("GNU General Public License", "3"), _gnu("GNU General Public License", "3"), _body("GPL-3")],
    "ISC": ["Licensed under the ISC License.", _body("ISC")],
    "LGPL-2.1": [
        _gnu_work("GNU Lesser General Public License", "2.1"),
        _gnu("GNU Lesser General Public License", "2.1", "library"),
        _body("LGPL-2.1"),
    ],
    "LGPL-3.0": [
        _gnu_work("GNU Lesser General Public License", "3"),
        _gnu("GNU Lesser General Public License", "3", "library"),
        _body("LGPL-3"),
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
        _body("MIT"),
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        _body("MPL-2.0"),
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", _body("Unlicense")],
}
for _name, _texts in TEMPLATES.items():
    _texts += [t.removeprefix("This work is ") for t in _texts if t.startswith("This work is ")]
    _texts.append(f"SPDX-License-Identifier: {_name}")

#: Words by which licenses with nearly the same texts differ: a place without those of its template does not count.
TELLING = frozenset(
    "affero agpl apache artistic attribution bsd cc cc0 endorse gpl isc lesser lgpl mit mozilla mpl nc nd neither "
    "noncommercial noderivatives sa sharealike unencumbered unlicense 1 2 3 4".split()
)
#: Words that make another license of a notice that they come into.
MODIFIERS = frozenset("affero lesser nc nd noncommercial noderivatives sa sharealike".split())
#: In longer templates digits number clauses; much longer ones are recognised by their wording alone.
NOTICE_WORDS, CLAUSE_WORDS = 60, 250


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def _increasing(places: Sequence[int]) -> list[int]:
    """Indexes of a longest increasing subsequence, by patience piles."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for i, place in enumerate(places):
        at = bisect.bisect_left(tops, place)
        before.append(piles[at - 1] if at else -1)
        tops[at : at + 1] = [place]
        piles[at : at + 1] = [i]
    chain = []
    i = piles[-1] if piles else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return chain[::-1]


def _longest(text: Sequence[str], template: Sequence[str]) -> list[tuple[int, int]]:
    """Matched pairs of a longest common subsequence, by bits: one is 0 where a word of the template makes it longer."""
    masks = Template._masks(template)
    all_ = (1 << len(template)) - 1
    rows = [all_]
    for w in text:
        open_ = rows[-1]
        both = open_ & masks.get(w, 0)
        rows.append(((open_ + both) | (open_ - both)) & all_)
    found, i, j = [], len(text), len(template)
    while i and j:
        if rows[i] >> (j - 1) & 1:
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append((i, j))
    return found[::-1]


def align(text: Sequence[str], template: Sequence[str]) -> list[tuple[int, int]]:
    """Matched pairs (place in text, place in template), both increasing; as many as there can be if the rarest words lead to few."""
    found: list[tuple[int, int]] = []
    open_ = [(0, len(text), 0, len(template))]
    while open_:
        a, b, c, d = open_.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        often = {w: max(n, theirs[w]) for w, n in ours.items() if w in theirs}
        if not often:
            continue
        rarest = min(often.values())  # 1: unique to both
        where: dict[str, list[int]] = {}
        for i, w in enumerate(text[a:b], a):
            if often.get(w) == rarest:
                where.setdefault(w, []).append(i)
        turn: Counter[str] = Counter()
        anchors = []
        for j, w in enumerate(template[c:d], c):
            if w in where:
                if turn[w] < len(where[w]):
                    anchors.append((where[w][turn[w]], j))
                turn[w] += 1
        anchors = [anchors[i] for i in _increasing([i for i, _ in anchors])]
        for i, j in anchors:
            found.append((i, j))
            open_.append((a, i, c, j))
            a, c = i + 1, j + 1
        if anchors:
            open_.append((a, b, c, d))
    return sorted(found) if len(found) >= COVERAGE * len(template) else _longest(text, template)


class Template:
    def __init__(self, name: str, text: str, coverage: float):
        self.name, self.words, self.coverage = name, words_of(text), coverage
        self.counts = Counter(self.words)
        self.window = 2 * len(self.words)
        self.telling = frozenset(
            w
            for w in TELLING & self.counts.keys()
            if len(self.words) <= (NOTICE_WORDS if w.isdigit() else CLAUSE_WORDS)
        )
        self.forward = self._masks(self.words)
        self.backward = self._masks(self.words[::-1])

    @staticmethod
    def _masks(words: list[str]) -> dict[str, int]:
        out: dict[str, int] = {}
        for i, w in enumerate(words):
            out[w] = out.get(w, 0) | 1 << i
        return out

    def _enough(self, counts: Mapping[str, int]) -> bool:
        """Whether so many words could be matched."""
        return sum(min(n, counts[w]) for w, n in self.counts.items() if w in counts) >= self.coverage * len(self.words)

    def _lengths(self, words: list[str], backward: bool = False) -> Iterator[int]:
        """Longest common subsequence of the template with every prefix of ``words`` (or suffix), by bits."""
        masks = self.backward if backward else self.forward
        size = len(self.words)
        all_ = (1 << size) - 1
        open_ = all_
        for w in reversed(words) if backward else words:
            if mask := masks.get(w):
                both = open_ & mask
                open_ = ((open_ + both) | (open_ - both)) & all_
            yield size - open_.bit_count()

    def _first(self, words: list[str]) -> tuple[int, int, int] | None:
        """(matched words, begin, end) of the place that ends first; a whole copy, not the next one's words."""
        least, best, end = self.coverage * len(self.words), 0, 0
        for i, n in enumerate(self._lengths(words), 1):
            if best and i > end + len(self.words) - best:
                break
            if n >= least and n > best:
                best, end = n, i
        if not best:
            return None
        back = next(i for i, n in enumerate(self._lengths(words[:end], True), 1) if n == best)
        return best, end - back, end

    def _other(self, words: Sequence[str], pairs: Sequence[tuple[int, int]]) -> bool:
        """In a notice: is a number not right behind the word matched before it, or does a further word make it another license?"""
        if len(self.words) > NOTICE_WORDS:
            return False
        apart = any(words[i].isdigit() and i != before + 1 for (before, _), (i, _) in zip(pairs, pairs[1:], strict=False))
        more = MODIFIERS.intersection(words[pairs[0][0] : pairs[-1][0] + 1])
        return apart or not more <= self.counts.keys()

    def places(self, words: list[str], index: Mapping[str, list[int]]) -> Iterator[tuple[float, int, int]]:
        """(coverage, first word, word after the last) of every place of the template in a text."""
        if not self._enough({w: len(index[w]) for w in self.counts if w in index}):
            return
        hits = sorted(i for w in self.counts if w in index for i in index[w])
        begin = 0
        while begin < len(hits):
            start = hits[begin]
            # Every place that begins up to one template length after the start ends in this slice.
            reach = start + self.window + len(self.words)
            ends = bisect.bisect_left(hits, reach, begin)
            found = None
            if self._enough(Counter(words[i] for i in hits[begin:ends])):
                found = self._first(words[start:reach])
            if not found:
                begin = bisect.bisect_right(hits, start + len(self.words), begin)
                continue
            a, b = start + found[1], start + found[2]
            if b - a > self.window or not self.telling.issubset(words[a:b]):
                begin = bisect.bisect_right(hits, a, begin)
                continue
            pairs = align(words[a:b], self.words)
            if len(pairs) < self.coverage * len(self.words) or self._other(words[a:b], pairs):
                begin = bisect.bisect_right(hits, a, begin)
                continue
            a, b = a + pairs[0][0], a + pairs[-1][0] + 1
            yield len(pairs) / len(self.words), a, b
            begin = bisect.bisect_left(hits, b, begin)


def other_version(
    text: str, spans: Sequence[tuple[int, int]], words: Sequence[str], a: int, b: int, template: Template
) -> bool:
    """Does the text join a number that the template lacks to the place from word ``a`` to ``b``?"""
    for i in range(a + 1, min(b + 1, len(words))):
        if words[i].isdigit() and (i == b or words[i] not in template.counts):
            joint = text[spans[i - 1][1] : spans[i][0]]
            if joint == "-" or (joint == "." and words[i - 1].isdigit()):
                return True
    return False


def licenses(
    text: str, templates: Sequence[Template], known: Set[str] | None = None
) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, word after the last), by place; the best of overlapping ones of one license.

    A place that overlaps one with more matched words of another license, whose template has
    all telling words of this one, is that other license too. ``known``: the words of all templates.
    """
    words = words_of(text)
    index: dict[str, list[int]] = {}
    if known is None:
        known = set().union(*(t.counts for t in templates))
    for i, w in enumerate(words):
        if w in known:
            index.setdefault(w, []).append(i)
    kept: list[tuple[str, float, int, int, Template]] = []
    found = [
        (-c * len(t.words), -c, t.name, a, b, k)
        for k, t in enumerate(templates)
        if len(words) >= t.coverage * len(t.words)
        for c, a, b in t.places(words, index)
    ]
    lower = text.lower()
    spans = [m.span() for m in WORDS.finditer(lower)] if found else []
    for _, coverage, name, a, b, k in sorted(found):
        own = templates[k].telling
        if len(templates[k].words) <= NOTICE_WORDS and other_version(lower, spans, words, a, b, templates[k]):
            continue
        if all(b <= c or d <= a or (n != name and not own <= t.counts.keys()) for n, _, c, d, t in kept):
            kept.append((name, -coverage, a, b, templates[k]))
    return sorted((k[:4] for k in kept), key=lambda k: (k[2], k[0]))


FOUND = pa.schema(
    [("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]
)


def scan(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per license found: doc_id, license, coverage, start, end (words of the text, end excluded)."""
    python_tasks(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [Template(name, text, coverage) for name, texts in sorted(templates.items()) for text in texts]
        vocabulary = set().union(*(t.counts for t in known))
        for batch in batches:
            rows = [
                (doc, *found)
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for found in licenses(text, known, vocabulary)
            ]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(FOUND)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, FOUND.types, strict=True)], schema=FOUND
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return texts.mapInArrow(run, "doc_id long, license string, coverage double, start long, end long")
