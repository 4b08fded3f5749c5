"""License scans by matching statistics against a generalised suffix automaton.

The words of all licence templates build one automaton. A file streams through it word by word:
at each word the automaton knows the longest run of words ending there that occurs in any
template, and where; its suffix links lead to the shorter runs that other templates have. A run
that is long enough and does not go on in a template is a match of that template, whether or not
it goes on in another one; matches of one template that go forward in both file and template are chained, and a chain that
covers enough of the template is a span with the template's label. Short phrases are templates
that must occur whole: a phrase occurs wherever it is a suffix of the current run.

Words are ASCII letters and digits, A-Z in lower case, and characters outside ASCII. Words that
no template has send the automaton to its start and cost one lookup.

Defined results: null and empty texts have no words and no spans; equal rows give equal rows;
an empty table stays empty; columns of the input that carry a result's name are replaced, all
others stay.
"""

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from sourcequarry.llm.common import slices

#: Words of the shortest match that counts towards a template.
MIN_MATCH = 5
#: Part of a template that a chain must cover.
MIN_COVER = 0.5
#: Words of a file, beyond those of the template, that may stand between two matches of a chain.
MAX_GAP = 30

# --- fixed values: licence texts and phrases -------------------------------------------------
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "Licensed under the MIT License."],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0."],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details.",
        "This work is licensed under the GNU General Public License, version 3."],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) "
        "any later version."],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
}
# --- end of fixed values ---------------------------------------------------------------------

_SPLIT = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_SPLIT).split()


class Span(NamedTuple):
    label: str
    first: int
    end: int
    cover: float
    phrase: bool


class LicenseAutomaton:
    """Suffix automaton of all templates, with the places of its states."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]):
        texts = [(label, words_of(t), False) for label, some in templates.items() for t in some]
        texts += [(label, words_of(p), True) for p, label in phrases.items()]
        self.texts = [t for t in texts if t[1]]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for _, words, _ in self.texts for w in words}))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, list[tuple[int, int]]] = defaultdict(list)
        last_of = []
        for t, (_, words, _) in enumerate(self.texts):
            last = 0
            for place, word in enumerate(words):
                last = self._extend(last, self.vocabulary[word])
                ends[last].append((t, place))
            last_of.append(last)
        children: dict[int, list[int]] = defaultdict(list)
        for state in range(1, len(self.next)):
            children[self.link[state]].append(state)
        #: where the strings of a state end: (template, place of the last word)
        self.places: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for state in sorted(range(len(self.next)), key=lambda s: -self.length[s]):
            own = sorted({*ends[state], *(p for c in children[state] for p in self.places[c])})
            self.places[state] = own
        #: words of the shortest match that counts, for each template and for all
        self.least = [1 << 62 if phrase else min(MIN_MATCH, len(words)) for _, words, phrase in self.texts]
        self.shortest = max(2, min(self.least, default=2))
        #: phrases that end every string of a state of at least their length
        self.phrases: list[list[int]] = [[] for _ in self.next]
        whole = defaultdict(list)
        for t, (_, _, phrase) in enumerate(self.texts):
            if phrase:
                whole[last_of[t]].append(t)
        for state in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            self.phrases[state] = self.phrases[self.link[state]] + whole[state]

    def _extend(self, last: int, word: int) -> int:
        after = self.next[last].get(word)
        if after is not None:  # another template has been here
            if self.length[after] == self.length[last] + 1:
                return after
            return self._split(last, word, after)
        new = self._state({}, self.length[last] + 1, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            after = self.next[at][word]
            self.link[new] = after if self.length[after] == self.length[at] + 1 else self._split(at, word, after)
        return new

    def _split(self, at: int, word: int, state: int) -> int:
        """A state for the strings of ``state`` that are not longer than those of ``at`` and a word."""
        new = self._state(dict(self.next[state]), self.length[at] + 1, self.link[state])
        self.link[state] = new
        while at >= 0 and self.next[at].get(word) == state:
            self.next[at][word] = new
            at = self.link[at]
        return new

    def _state(self, after: dict[int, int], length: int, link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def scan(self, words: list[bytes]) -> list[Span]:
        """All phrases and covered template spans of a file, by place."""
        known = [(i, w) for i, w in enumerate(map(self.vocabulary.get, words)) if w is not None]
        spans: list[Span] = []
        matches: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        held: dict[tuple[int, int], int] = {}  # length of the match that ends at each (template, place)
        state = length = 0
        before = -2
        for i, word in known:
            if i != before + 1:
                self._keep(matches, held, {}, before)
                held = {}
                state = length = 0
            after = self.next[state].get(word)
            while state > 0 and after is None:
                state = self.link[state]
                length = self.length[state]
                after = self.next[state].get(word)
            if after is None:
                state = length = 0
            else:
                state, length = after, length + 1
            going = self._matches(state, length) if length >= self.shortest else {}
            if held:
                self._keep(matches, held, going, before)
            held, before = going, i
            for t in self.phrases[state]:
                n = len(self.texts[t][1])
                if n <= length:
                    spans.append(Span(self.texts[t][0], i + 1 - n, i + 1, 1.0, True))
        self._keep(matches, held, {}, before)
        for t, found in matches.items():
            spans += self._chains(t, found)
        return sorted(spans, key=lambda s: (s.first, s.end, s.label))

    def _matches(self, state: int, length: int) -> dict[tuple[int, int], int]:
        """Where the run, or the longest end of it that a template has, ends in each template."""
        out: dict[tuple[int, int], int] = {}
        while length >= self.shortest:
            for place in self.places[state]:
                if place not in out and length >= self.least[place[0]]:
                    out[place] = length
            state = self.link[state]
            length = self.length[state]
        return out

    def _keep(self, matches: dict, held: dict[tuple[int, int], int], going: dict[tuple[int, int], int], last: int) -> None:
        """Matches up to the word ``last`` of the file that do not go on are complete."""
        for (t, end), length in held.items():
            if (t, end + 1) not in going:
                matches[t].append((last + 1 - length, end + 1 - length, length))

    def _chains(self, t: int, found: list[tuple[int, int, int]]) -> Iterator[Span]:
        """Matches (place in file, place in template, length), in order of the file, as chains that
        go forward in both. A match that does not continue its chain begins the next one."""
        label, words, _ = self.texts[t]
        chain: list[tuple[int, int, int]] = []

        def covered() -> int:
            total, reach = 0, 0
            for _, place, n in chain:
                total += max(0, place + n - max(place, reach))
                reach = max(reach, place + n)
            return total

        def closed() -> Iterator[Span]:
            if chain and covered() >= MIN_COVER * len(words):
                yield Span(label, chain[0][0], max(a + n for a, _, n in chain), covered() / len(words), False)

        for at, place, n in sorted(found, key=lambda m: (m[0], -m[2], m[1])):
            if chain:
                last_at, last_place, last_n = chain[-1]
                if at + n <= last_at + last_n and (at, n) != (last_at, last_n):
                    continue  # within a match of the chain, so it adds nothing
                near = at - (last_at + last_n) <= MAX_GAP
                if at == last_at and place != last_place:  # the same words elsewhere in the template
                    if near and len(chain) == 1 and place < last_place:
                        chain = [(at, place, n)]
                    continue
                if near and place + n > last_place + last_n and place > last_place:
                    chain.append((at, place, n))
                    continue
                yield from closed()
            chain = [(at, place, n)]
        yield from closed()


SPANS = T.ArrayType(T.StructType([
    T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType()),
    T.StructField("cover", T.DoubleType()), T.StructField("phrase", T.BooleanType())]))


def scan_licenses(
    docs: DataFrame, text: str = "text", templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES,
) -> DataFrame:
    """``docs`` without their text, with ``n_words`` and ``license_spans`` (label, first and end
    word, covered part of the template, whether it is a phrase)."""
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), "n_words", "license_spans")]
    rows = docs.select(*kept, text)
    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("n_words", T.LongType()), T.StructField("license_spans", SPANS)])
    arrow_spans = pa.list_(pa.struct([
        ("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("cover", pa.float64()), ("phrase", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LicenseAutomaton(templates, phrases)
        for batch in batches:
            for part in slices(batch):
                counts, spans = [], []
                for value in part.column(len(kept)):
                    words = words_of(value.as_py())
                    counts.append(len(words))
                    spans.append([s._asdict() for s in automaton.scan(words)])
                yield pa.record_batch(
                    [*part.columns[:len(kept)], pa.array(counts, pa.int64()), pa.array(spans, arrow_spans)],
                    names=[*kept, "n_words", "license_spans"])

    return rows.mapInArrow(run, schema)
