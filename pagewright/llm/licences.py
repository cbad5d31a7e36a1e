r"""Licence scans by matching statistics against a generalised suffix automaton of licence templates.

The templates' words, as numbers, make one suffix automaton (a fixed few kilobytes, built on the driver and sent with the task). A text streams through it: after each word
the automaton holds the longest run of words ending there that stands in any template. Where such a run cannot go on it is a match; matches of ``LEAST_WORDS``
or more are chained, template by template, in the order of both text and template, and a chain that covers ``SHARE`` of a template is a span of it.
Words that no template has end every run, so only stretches of known words are walked. Rows are scanned where they are read: nothing is shuffled.
"""
from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import ship_package, text_of

#: Words of a match that counts, share of a template its chain covers, and words that may lie between two matches of a chain beside the template's own gap.
LEAST_WORDS = 4
SHARE = 0.7
GAP_WORDS = 24
#: ASCII letters to lower case, every other ASCII byte that is no digit to a blank; bytes of longer UTF-8 sequences stay.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

# Phrases that name a licence, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices that licences ask to be put into a work, as published with them.
TEMPLATES = [
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
            "Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
            "PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
             "Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS "
               "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "licensed under the Apache License, Version 2.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
            "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "released under the MIT License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
            "permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
]


def words(text: str) -> list[bytes]:
    """The words of a text: runs of ASCII letters and digits, in lower case, and of characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


@dataclass
class Automaton:
    """A suffix automaton of several sequences. State 0 is the empty run; ``places`` says where a state's runs end: ``(template, words up to there)``."""

    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    places: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        self.places.append([])
        return len(self.step) - 1

    def _split(self, at: int, token: int, to: int) -> int:
        """The state of the runs of ``to`` that are no longer than the one that reached it from ``at``, made if it is not ``to`` itself."""
        if self.length[at] + 1 == self.length[to]:
            return to
        twin = self._state(self.length[at] + 1, dict(self.step[to]), self.link[to])
        while at >= 0 and self.step[at].get(token) == to:
            self.step[at][token] = twin
            at = self.link[at]
        self.link[to] = twin
        return twin

    def add(self, template: int, sequence: list[int]) -> None:
        last = 0
        for no, token in enumerate(sequence, 1):
            if token in self.step[last]:
                last = self._split(last, token, self.step[last][token])
            else:
                new, at = self._state(self.length[last] + 1, {}, 0), last
                while at >= 0 and token not in self.step[at]:
                    self.step[at][token] = new
                    at = self.link[at]
                if at >= 0:
                    self.link[new] = self._split(at, token, self.step[at][token])
                last = new
            self.places[last].append((template, no))

    def close(self) -> None:
        """Give each state the ends of all longer runs' states that have its runs as suffixes. Templates are short, so these lists are."""
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.length[s]):
            up = self.link[state]
            if up > 0:
                self.places[up] = sorted({*self.places[up], *self.places[state]})

    def matches(self, tokens: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """``(stop, length, state)`` of each longest run that the next word does not go on, of at least ``least`` tokens."""
        step, link, length = self.step, self.link, self.length
        state = size = 0
        for i, token in enumerate(tokens):
            to = step[state].get(token)
            if to is None:
                if size >= least:
                    yield i, size, state
                while state and to is None:
                    state = link[state]
                    to = step[state].get(token)
                size = length[state]
            if to is not None:
                state, size = to, size + 1
        if size >= least:
            yield len(tokens), size, state


@dataclass(frozen=True)
class Span:
    template: int
    start: int  # words of the text
    stop: int
    covered: int  # words of the template


def chains(found: list[tuple[int, int, int]], template: int, size: int, gap: int = GAP_WORDS) -> list[Span]:
    """The best chains of matches ``(start, template start, length)``, ascending, of one template, none touching another in the text.

    A match goes on from one that ends before it in both, with at most ``gap`` words more between them than the template has there; a template is
    at most ``size`` words, so only matches that close are looked at. The most words covered win, then the earliest.
    """
    best: list[tuple[int, int]] = []  # words covered up to a match, and the match before it
    stops = [s + n for s, _, n in found]  # ascending: of two longest runs neither holds the other
    for i, (start, at, n) in enumerate(found):
        most, before = 0, -1
        for j in range(bisect_left(stops, start - size - gap), i):
            s, t, m = found[j]
            over = max(s + m - start, t + m - at, 0)  # an overlap counts once
            if s < start and t < at and over < n and (start - s) - (at - t) <= gap and best[j][0] - over > most:
                most, before = best[j][0] - over, j
        best.append((n + most, before))
    out: list[Span] = []
    taken: list[tuple[int, int]] = []  # ascending, and apart
    for i in sorted(range(len(found)), key=lambda i: (-best[i][0], i)):
        stop, covered, first = stops[i], best[i][0], i
        while best[first][1] >= 0:
            first = best[first][1]
        start = found[first][0]
        place = bisect_left(taken, (start, stop))
        if (not place or taken[place - 1][1] <= start) and (place == len(taken) or stop <= taken[place][0]):
            taken.insert(place, (start, stop))
            out.append(Span(template, start, stop, min(covered, size)))
    return sorted(out, key=lambda s: s.start)


@dataclass
class Scanner:
    labels: list[str]
    sizes: list[int]
    number: dict[bytes, int]  # words of templates and phrases, from 1
    automaton: Automaton
    phrases: list[tuple[list[int], str]]
    least: int
    share: float

    @staticmethod
    def of(templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, least: int = LEAST_WORDS, share: float = SHARE) -> Scanner:
        number: dict[bytes, int] = {}
        numbers = lambda text: [number.setdefault(w, len(number) + 1) for w in words(text)]
        automaton = Automaton()
        sizes = []
        for i, (_, text) in enumerate(templates):
            sequence = numbers(text)
            sizes.append(len(sequence))
            automaton.add(i, sequence)
        automaton.close()
        return Scanner([label for label, _ in templates], sizes, number, automaton, [(numbers(p), label) for p, label in phrases.items()], least, share)

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[Span], float]:
        """The number of words, the places of the phrases with their labels, the spans of templates, and the largest share of a template any chain covers."""
        found = words(text)
        known = np.fromiter((self.number.get(w, 0) for w in found), np.int64, len(found))
        base = []
        for phrase, label in self.phrases:
            fits = known[: max(len(known) - len(phrase) + 1, 0)] == phrase[0]
            for k, token in enumerate(phrase[1:], 1):
                fits = fits & (known[k: k + len(fits)] == token)
            base.extend((int(at), label) for at in np.flatnonzero(fits))
        held: dict[int, list[tuple[int, int, int]]] = {}
        # stretches of known words, by where they start and stop
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (known > 0).astype(np.int8), [0]])))
        for start, stop in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if stop - start < self.least:
                continue
            for end, size, state in self.automaton.matches(known[start:stop].tolist(), self.least):
                for template, upto in self.automaton.places[state]:
                    held.setdefault(template, []).append((start + end - size, upto - size, size))
        spans = [s for t, m in sorted(held.items()) for s in chains(sorted(m), t, self.sizes[t])]
        score = max((s.covered / self.sizes[s.template] for s in spans), default=0.0)
        return len(found), sorted(base), [s for s in spans if s.covered >= self.share * self.sizes[s.template]], score


def _scanned(scanner: Scanner):
    def scanned(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, base, spans, score = scanner.scan(text)
                out.append((doc_id, n, len(base), base[0][0] if base else None, base[-1][0] if base else None, sorted({x for _, x in base}),
                            [(scanner.labels[s.template], s.template, s.start, s.stop, s.covered / scanner.sizes[s.template]) for s in spans], score))
            columns = list(zip(*out, strict=True)) or [()] * 8
            span = pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())])
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(span), pa.float64()]
            held = [[dict(zip(("label", "template", "start", "stop", "share"), s, strict=True)) for s in spans] for spans in columns[6]]
            yield pa.RecordBatch.from_arrays([pa.array(held if i == 6 else c, k) for i, (c, k) in enumerate(zip(columns, kinds, strict=True))],
                                             ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "spans", "score"])
    return scanned


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, least: int = LEAST_WORDS, share: float = SHARE) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base, spans, score)`` of every row.

    ``base`` holds the labels of phrases that occur, ``first_word`` and ``last_word`` the least and greatest place one starts at (words from 0), null without
    any; ``spans`` the covered spans of templates ``(label, template, start, stop, share)``; ``score`` the largest share any chain covers, of a span or not. A null text counts as
    empty: no words, score 0. Very long texts are scanned whole, a row at a time. Of chains that touch in a text the one with more words stays, then the
    earlier. Rows repeated give rows repeated, a null id stays null, an empty table gives no rows; other columns of ``docs`` are not looked at.
    """
    ship_package(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("string").alias("text"))
    return given.mapInArrow(_scanned(Scanner.of(templates, phrases, least, share)), "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, "
                            "spans array<struct<label: string, template: int, start: bigint, stop: bigint, share: double>>, score double")


def labelled(docs: DataFrame, **options) -> DataFrame:
    """``scan`` with ``base_labels`` and ``labels``, the base ones and those of spans: both distinct, sorted and joined by commas. A phrase alone, without
    ``least`` words of a template, scores 0."""
    both = F.array_sort(F.array_distinct(F.concat("base", F.transform("spans", lambda s: s["label"]))))
    return scan(docs, **options).select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
                                        F.array_join(both, ",").alias("labels"), "score")
