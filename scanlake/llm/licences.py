"""Licence scans with a generalised suffix automaton of licence tokens.

The automaton holds all token runs of all templates. A file is streamed through it: at each token it gives the length of
the longest run that ends there and occurs in some template (matching statistics), and the state names the templates and
places where. Runs that cannot be extended and are ``MIN_RUN`` tokens or longer are chained per template, in order of
place, into spans that cover it; small gaps are allowed, so edits and names in between do not break a span. Half a body names
its licence, half a notice does not: a template of up to ``SHORT`` tokens needs one run with the words of ``NAMED`` and no
word of another licence right behind them, or, where none are listed, near-full coverage. A phrase is found where the
longest run's suffix is the whole phrase, read from the suffix links.

Only places where two neighbouring tokens are neighbours in some template are streamed; elsewhere every run is shorter than
two tokens. Those places come from the numpy table of word hashes; texts are read whole.

Rows: null and empty texts have no words, no spans, score 0. Equal texts have equal results; each row is judged alone where
it lies. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scanlake.llm.words import passes, texts, words

MIN_RUN, MAX_GAP, MIN_COVER = 3, 12, 0.5
SHORT, SHORT_COVER = 20, 0.9

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices as their licences word them.
TEMPLATES = {
    "mit-notice": "released under the MIT License",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.""",
    "apache-2.0-notice": "licensed under the Apache License, Version 2.0",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl-notice": "this work is licensed under the GNU General Public License, version 3",
    "gpl-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "cc-by-nc": "licensed under CC BY-NC 4.0",
    "cc-by-notice": "this work is licensed under a Creative Commons Attribution 4.0 International License",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
}

_OTHER_CC = {"nc", "nd", "sa", "non", "no", "share", "noncommercial", "noderivatives", "noderivs", "sharealike"}
#: Words that name the licence of a short template, and words that make it another one as the first or second behind.
NAMED = {
    "mit-notice": ("mit license", set()),
    "apache-2.0-notice": ("apache license", {"1"}),
    "gpl-notice": ("gnu general public license", set()),
    "cc-by-nc": ("cc by nc", _OTHER_CC),
    "cc-by-notice": ("creative commons attribution", _OTHER_CC),
}

SCHEMA = (
    "doc_id long, n_words long, phrases array<struct<label: string, first: long>>, "
    "spans array<struct<label: string, first: long, last: long, matched: long, coverage: double>>"
)
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("phrases", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("matched", pa.int64()), ("coverage", pa.float64())]))),
])


def tokens(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


@dataclass
class Automaton:
    """States by number, 0 is the start: longest run, link to the state of the longest suffix elsewhere, steps by token."""

    longest: list[int] = field(default_factory=lambda: [0])
    link: list[int] = field(default_factory=lambda: [-1])
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    ends: list[dict[int, list[int]]] = field(default_factory=lambda: [{}])  # template: places where the state's runs end

    def _new(self, longest: int, link: int, step: dict[int, int]) -> int:
        self.longest.append(longest)
        self.link.append(link)
        self.step.append(step)
        self.ends.append({})
        return len(self.link) - 1

    def _copy_for(self, state: int, token: int) -> int:
        """The state that ``token`` leads to, split off if it also holds longer runs than one step from ``state``."""
        to = self.step[state][token]
        if self.longest[to] == self.longest[state] + 1:
            return to
        part = self._new(self.longest[state] + 1, self.link[to], dict(self.step[to]))
        self.link[to] = part
        while state >= 0 and self.step[state].get(token) == to:
            self.step[state][token] = part
            state = self.link[state]
        return part

    def add(self, template: int, run: list[int]) -> None:
        last = 0
        for place, token in enumerate(run):
            if token in self.step[last]:  # known from an earlier template
                now = self._copy_for(last, token)
            else:
                now, at = self._new(self.longest[last] + 1, 0, {}), last
                while at >= 0 and token not in self.step[at]:
                    self.step[at][token] = now
                    at = self.link[at]
                self.link[now] = self._copy_for(at, token) if at >= 0 else 0
            self.ends[now].setdefault(template, []).append(place)
            last = now

    def finish(self) -> Automaton:
        """Hands the places down the suffix links: a suffix ends wherever a longer run does. Templates bound their number."""
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.longest[s]):
            if self.link[state] > 0:
                for template, places in self.ends[state].items():
                    self.ends[self.link[state]].setdefault(template, []).extend(places)
        return self


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.phrase = {n: (label, len(tokens(text))) for n, (text, label) in enumerate(phrases.items())}
        self.label = {len(self.phrase) + n: label for n, label in enumerate(templates)}
        runs = [tokens(t) for t in (*phrases, *templates.values())]
        if any(len(r) < 2 for r in runs):
            raise ValueError("templates and phrases have two words or more")
        names = sorted({w for r in runs for w in r})
        number = {w: n for n, w in enumerate(names)}
        self.size = [len(r) for r in runs]
        #: (first, last place of the naming words, words of other licences) of short templates that have them
        self.named: dict[int, tuple[int, int, set[str]]] = {}
        for n, label in self.label.items():
            name, others = NAMED.get(label, ("", set()))
            own = tokens(name)
            at = next((k for k in range(self.size[n]) if own and runs[n][k : k + len(own)] == own), None)
            if self.size[n] <= SHORT and at is not None:
                self.named[n] = at, at + len(own) - 1, others
        coded = [[number[w] for w in r] for r in runs]
        self.pairs = np.unique([a * len(names) + b for r in coded for a, b in zip(r, r[1:])])
        hashes = words(pa.array([" ".join(names)])).hash
        self.order = np.argsort(hashes)
        self.hash, self.names = hashes[self.order], names
        self.automaton = Automaton()
        for template, run in enumerate(coded):
            self.automaton.add(template, run)
        self.automaton.finish()

    def _ended(self, state: int, length: int) -> list[int]:
        """Phrases that end here: their whole run is a suffix of the longest run."""
        found, auto = [], self.automaton
        while state > 0:
            for n, (_, size) in self.phrase.items():
                if auto.longest[auto.link[state]] < size <= min(length, auto.longest[state]) and size - 1 in auto.ends[state].get(n, ()):
                    found.append(n)
            state = auto.link[state]
        return found

    def stream(self, run: list[int], first: int, phrases: list, matches: list) -> None:
        """Matching statistics of one run of known tokens that starts at word ``first``."""
        auto, state, length = self.automaton, 0, 0
        for k, token in enumerate([*run, -1]):
            before, size = state, length
            while state and token not in auto.step[state]:
                state = auto.link[state]
                length = auto.longest[state]
            if size >= MIN_RUN and (length < size or token < 0):  # the run that ended before this token goes no further
                matches.append((first + k - size, size, before))
            if token in auto.step[state]:
                state, length = auto.step[state][token], length + 1
            else:
                state = length = 0
            if length > 1:
                phrases.extend((n, first + k + 1 - self.phrase[n][1]) for n in self._ended(state, length))

    def _names(self, template: int, first: int, length: int, end: int, word: Callable[[int], str]) -> bool:
        """Whether the run that ends at place ``end`` holds the naming words, and none of another licence follows."""
        if template not in self.named:
            return False
        low, high, others = self.named[template]
        if not end - length + 1 <= low <= high <= end:
            return False
        last = first + length - 1 - (end - high)
        return not others or not {word(last + 1), word(last + 2)} & others

    def chain(self, matches: list[tuple[int, int, int]], word: Callable[[int], str]) -> list[tuple[str, int, int, int, float]]:
        """Spans (label, first, last, matched, coverage) of each template: runs in order in the file and in the template.

        For each template a run joins the open chain if it comes later in both and at most MAX_GAP (file) later; else a new
        chain begins, and of chains that overlap the better covered one stays.
        """
        spans = []
        for template, label in self.label.items():
            size, open_ = self.size[template], []
            for first, length, state in matches:
                places = self.automaton.ends[state].get(template)
                if not places:
                    continue
                grown = False
                for chain in reversed(open_):
                    if first - chain[1] > MAX_GAP + 1:
                        break
                    # where runs overlap, only what is new counts; the earliest place after the chain's end leaves most room
                    fresh = min(length, first + length - 1 - chain[1])
                    end = min((p for p in places if p - fresh >= chain[3]), default=None)
                    if fresh > 0 and end is not None:
                        chain[1], chain[2], chain[3] = first + length - 1, chain[2] + fresh, end
                        chain[4] = chain[4] or self._names(template, first, length, end, word)
                        grown = True
                        break
                if not grown:
                    open_.append([first, first + length - 1, length, min(places), self._names(template, first, length, min(places), word)])
            kept: list[tuple[int, int, int]] = []  # disjoint, by place
            least = SHORT_COVER if size <= SHORT and template not in self.named else MIN_COVER
            for low, high, matched, _, names in sorted(open_, key=lambda c: (-c[2], c[0])):
                if matched >= least * size and (names or template not in self.named):
                    place = bisect.bisect_left(kept, (low,))
                    if (not place or kept[place - 1][1] < low) and (place == len(kept) or high < kept[place][0]):
                        kept.insert(place, (low, high, matched))
            spans += [(label, low, high, matched, min(1.0, matched / size)) for low, high, matched in kept]
        return sorted(spans, key=lambda s: (s[1], s[2], s[0]))

    def scan(self, column: pa.Array) -> Iterator[tuple[int, list, list]]:
        """Of each text: number of words, phrases as (label, first), spans."""
        found = words(column)
        at = np.minimum(np.searchsorted(self.hash, found.hash), len(self.hash) - 1)
        token = np.where(self.hash[at] == found.hash, self.order[at], -1)
        low, high = token[:-1], token[1:]
        joined = (low >= 0) & (high >= 0) & (found.doc[1:] == found.doc[:-1]) & np.isin(low * len(self.names) + high, self.pairs)
        good = np.flatnonzero(joined)
        cut = np.flatnonzero(np.diff(good) > 1) + 1
        by_doc: dict[int, list] = {}
        for part in np.split(good, cut) if len(good) else []:
            doc = int(found.doc[part[0]])
            by_doc.setdefault(doc, []).append((int(part[0]), int(part[-1]) + 2))
        for doc, n in enumerate(np.diff(found.first)):
            phrases: list[tuple[int, int]] = []
            matches: list[tuple[int, int, int]] = []
            for a, b in by_doc.get(doc, ()):
                # equal hashes are checked on the words themselves
                own = [bytes(found.data[found.start[k] : found.end[k]]).lower().decode() for k in range(a, b)]
                run = [int(t) if self.names[t] == w else -2 for t, w in zip(token[a:b], own)]
                self.stream(run, a - int(found.first[doc]), phrases, matches)
            word = lambda k, low=int(found.first[doc]), n=int(n): bytes(found.data[found.start[low + k] : found.end[low + k]]).lower().decode() if k < n else ""
            yield int(n), [(self.phrase[p][0], first) for p, first in sorted(phrases, key=lambda x: (x[1], x[0]))], self.chain(matches, word) if matches else []


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, phrases (label, first word), spans (label, first, last word, matched tokens, coverage of the template)."""
    known = (templates if templates is not None else TEMPLATES, phrases if phrases is not None else PHRASES)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*known)
        for rows in batches:
            for low, high in passes(rows.column("text")):
                n, hits, spans = zip(*scanner.scan(rows.column("text").slice(low, high - low)))
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id").slice(low, high - low), pa.array(n, pa.int64()),
                    pa.array([[{"label": a, "first": b} for a, b in h] for h in hits], _ARROW.field("phrases").type),
                    pa.array([[dict(zip(("label", "first", "last", "matched", "coverage"), s)) for s in each] for each in spans], _ARROW.field("spans").type),
                ], schema=_ARROW)

    return texts(docs, id_col, text_col).mapInArrow(scanned, SCHEMA)
