"""License scans by patience alignment.

Anchors are words that occur once in the text and once in the template. The longest sequence
of anchors in the same order in both is kept; equal words next to an anchor extend it, and the
gaps between anchors are aligned in the same way, until a gap has no word unique to both.
Coverage is the share of the template's words that are aligned. The words that name a licence
and its version (`NAMES`) have to be found exactly and side by side, whatever the coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a template that has to be found.
COVERAGE = 0.8
#: Words of a text that may lie between two aligned words of one passage.
GAP = 12
#: Templates of no more words are looked for around the words that name the licence.
SHORT = 12

# Opening or complete wording of well-known licences and notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer."),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
}
#: Words that tell a licence and its version from others: each group side by side in the text.
#: A short template without an entry has to be found whole.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0",), "Apache-2.0-header": ("Apache License, Version 2.0",),
    "MIT": ("MIT License",), "GPL-3.0": ("GNU General Public License, version 3",),
    "GPL-3.0-header": ("GNU General Public License", "version 3"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",), "CC-BY-4.0": ("CC BY 4.0",),
}
#: A word of these groups that may be missing.
_OPTIONAL = "version"
_WORD = re.compile(r"[A-Za-z0-9]+(?:\.[0-9]+)*")
_NUMBER = re.compile(r"v?([0-9]+(?:\.[0-9]+)*?)(?:\.0)*")


def _plain(word: str) -> str:
    """Lower case; version numbers without a v before and .0 behind."""
    word = word.lower()
    number = _NUMBER.fullmatch(word) if word[-1].isdigit() else None
    return number[1] if number else word


def longest_rising(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        if at:
            before[i] = piles[at - 1]
        if at == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[at], piles[at] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), rising in both."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        # Equal ends of a gap belong to the anchors beside it.
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        once = {w for w, n in Counter(template[c:d]).items() if n == 1}
        inside = Counter(w for w in text[a:b] if w in once)
        place = {template[j]: j for j in range(c, d) if inside.get(template[j]) == 1}
        anchors = [(i, place[text[i]]) for i in range(a, b) if text[i] in place]
        kept = [anchors[i] for i in longest_rising([j for _, j in anchors])]
        found += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        if kept:
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(found)


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = {k: [_plain(w) for w in _WORD.findall(t)] for k, t in (templates or TEMPLATES).items()}
        self.counts = {k: Counter(t) for k, t in self.templates.items()}
        self.vocabulary = {w for t in self.templates.values() for w in t}
        #: Places of each template's naming words, as (first, end).
        self.names = {k: self._named(k, t) for k, t in self.templates.items()}

    def _named(self, name: str, template: list[str]) -> list[tuple[int, int]]:
        found = []
        for group in NAMES.get(name, ()):
            own = [_plain(w) for w in _WORD.findall(group)]
            at = [i for i in range(len(template)) if template[i:i + len(own)] == own]
            found += [(i, i + len(own)) for i in at[:1]]
        return found or ([(0, len(template))] if len(template) <= SHORT else [])

    def _windows(self, places: list[int]) -> Iterator[tuple[int, int]]:
        """Stretches of listed words without a gap of more than `GAP` other words."""
        start = 0
        for i in range(1, len(places) + 1):
            if i == len(places) or places[i] - places[i - 1] > GAP + 1:
                yield start, i
                start = i

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end in characters) of the best match of each template."""
        matches, places, listed = [], [], []
        for i, m in enumerate(_WORD.finditer(text)):
            word = _plain(m[0])
            if word in self.vocabulary:
                matches.append(m)
                places.append(i)
                listed.append(word)
        # Words that no template has can't be aligned; they only part stretches.
        have = Counter(listed)
        best: dict[str, list[tuple[int, int]]] = {}
        for name, template in self.templates.items():
            # No alignment has more words than text and template share.
            if not template or self._shared(name, have) < self.coverage * len(template):
                continue
            tries = self._short(name, listed, places) if len(template) <= SHORT else self._long(name, listed, places)
            for pairs in tries:
                if len(pairs) >= self.coverage * len(template) and len(pairs) > len(best.get(name, ())):
                    best[name] = pairs
        # A match inside one that aligns more words, and some of the same, is part of it.
        held = {name: {i for i, _ in pairs} for name, pairs in best.items()}
        whole = [x for x in best if not any(
            min(held[y]) <= min(held[x]) and max(held[x]) <= max(held[y]) and len(held[y]) > len(held[x])
            and held[x] & held[y] for y in best)]
        return sorted(((x, len(best[x]) / len(self.templates[x]), matches[best[x][0][0]].start(),
                        matches[best[x][-1][0]].end()) for x in whole), key=lambda x: (x[2], x[0]))

    def _shared(self, name: str, have: Counter) -> int:
        return sum(min(n, have.get(w, 0)) for w, n in self.counts[name].items())

    def _short(self, name: str, listed: list[str], places: list[int]) -> Iterator[list[tuple[int, int]]]:
        """Alignments around each place that has the naming words side by side."""
        template, (first, end) = self.templates[name], self.names[name][0]
        for at in range(len(listed)):
            if listed[at] != template[first]:
                continue
            named, i = [], at
            for j in range(first, end):
                if i < len(listed) and listed[i] == template[j] and places[i] - places[at] == i - at:
                    named.append((i, j))
                    i += 1
                elif template[j] != _OPTIONAL or len(template) == end - first:
                    break
            else:
                low = bisect_left(places, places[at] - first - GAP)
                high = bisect_left(places, places[i - 1] + len(template) - end + GAP + 1) if end < len(template) else i
                before = [(k + low, j) for k, j in align(listed[low:at], template[:first])]
                after = [(k + i, j + end) for k, j in align(listed[i:high], template[end:])]
                yield before + named + after

    def _long(self, name: str, listed: list[str], places: list[int]) -> Iterator[list[tuple[int, int]]]:
        """Alignments with each stretch; where none reaches the coverage, with several together."""
        needed = self.coverage * len(self.templates[name])
        windows, found = list(self._windows(places)), False
        for start, end in windows:
            if self._shared(name, Counter(listed[start:end])) >= needed:
                pairs = self._best_alignment(name, listed[start:end], places[start:end])
                found = found or len(pairs) >= needed
                yield [(i + start, j) for i, j in pairs]
        if not found:
            yield from self._joined(name, listed, places, windows, needed)

    def _joined(self, name: str, listed: list[str], places: list[int], windows: list[tuple[int, int]],
                needed: float) -> Iterator[list[tuple[int, int]]]:
        """Alignments with neighbouring stretches, of those that hold three of the template's words
        side by side: from each stretch on as few as share enough words, then twice as many."""
        template = self.templates[name]
        runs = set(zip(template, template[1:], template[2:]))
        parts = [list(range(a, b)) for a, b in windows if any(
            places[i + 2] - places[i] == 2 and (listed[i], listed[i + 1], listed[i + 2]) in runs for i in range(a, b - 2))]
        have = Counter()
        end = 0
        for start, part in enumerate(parts):
            while end < len(parts) and self._shared(name, have) < needed:
                have.update(listed[i] for i in parts[end])
                end += 1
            if self._shared(name, have) < needed:
                return
            size = max(end - start, 2)
            while True:
                own = [i for x in parts[start:start + size] for i in x]
                pairs = self._best_alignment(name, [listed[i] for i in own], [places[i] for i in own])
                yield [(own[i], j) for i, j in pairs]
                if len(pairs) >= needed or start + size >= len(parts):
                    break
                size *= 2
            have.subtract(listed[i] for i in part)

    def _is_named(self, name: str, pairs: list[tuple[int, int]], places: list[int]) -> bool:
        template, of = self.templates[name], {j: places[i] for i, j in pairs}
        for first, end in self.names[name]:
            if any(j not in of and template[j] != _OPTIONAL for j in range(first, end)):
                return False
            own = [of[j] for j in range(first, end) if j in of]
            if own[-1] - own[0] != len(own) - 1:
                return False
        return True

    def _best_alignment(self, name: str, listed: list[str], places: list[int]) -> list[tuple[int, int]]:
        """A notice repeated in one stretch leaves no word unique to both: each stretch from one
        first word to the next is aligned by itself, too. Of alignments of as many words the
        closest counts; those without the naming words count for nothing."""
        template = self.templates[name]
        tries = [align(listed, template)]
        starts = [i for i, w in enumerate(listed) if w == template[0]]
        if len(starts) > 1:
            for a, b in zip(starts, [*starts[1:], len(listed)]):
                tries.append([(i + a, j) for i, j in align(listed[a:b], template)])
        tries = [p for p in tries if p and self._is_named(name, p, places)]
        return max(tries, key=lambda p: (len(p), p[0][0] - p[-1][0]), default=[])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None,
                  coverage: float = COVERAGE) -> DataFrame:
    """One row for each row of `docs` and template found in it: doc_id, license, coverage, start, end.

    Coverage is at least `coverage`; start and end count code points of the whole text, and of
    several places of one template the best (then first) is given. Null and empty texts and
    texts without a template give no row; rows that repeat a doc_id are scanned one by one.
    """
    scanner = Scanner(templates, coverage)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *found) for i, text in zip(batch["doc_id"], batch["text"]) for found in scanner.scan(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "coverage", "start", "end"]).astype({"doc_id": "Int64"})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id BIGINT, license STRING, coverage DOUBLE, start BIGINT, end BIGINT")
