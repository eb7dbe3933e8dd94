"""Licence scans by a generalised suffix automaton of licence words.

All template texts are put into one automaton whose states are the word sequences they contain. A file streams through it
and keeps, word by word, the longest sequence ending there that any template contains (its matching statistics). Long
matches are chained along one template, in its order and with small gaps, into spans; a span covers a share of the template.
Only stretches of words whose neighbours stand together somewhere in a template are streamed: the automaton is in its first
states everywhere else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from visiontables.llm.words import PUNCTUATION, hash_word, scan

# Phrases of the base rule, and words of public licence texts and notices.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES: dict[str, Sequence[str]] = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software",
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of "
        "merchantability, fitness for a particular purpose and noninfringement",
        "Released under the MIT License"),
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "You should have received a copy of the GNU General Public License along with this program"),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"),
    "all-rights-reserved": ("All rights reserved",),
}

#: Words of a match that counts, words that may be missing between two matches of a span, and the share of a template that names it.
LEAST_MATCH = 3
GAP = 8
COVERED = 0.75

_TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall


def tokens(text: str) -> list[str]:
    return _TOKEN("".join(c.lower() if c.isascii() else c for c in text))


class SuffixAutomaton:
    """States of all word sequences in some token lists, and where in them each state's sequences end."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].add((number, place))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, state: int, token: int, to: int) -> int:
        """A state for the sequences of ``to`` that are as long as ``state``'s and one token."""
        if self.length[state] + 1 == self.length[to]:
            return to
        twin = self._state(self.length[state] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = twin
        while state != -1 and self.next[state].get(token) == to:
            self.next[state][token] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token, self.next[last][token])
        made = self._state(self.length[last] + 1, 0, {})
        at = last
        while at != -1 and token not in self.next[at]:
            self.next[at][token] = made
            at = self.link[at]
        if at != -1:
            self.link[made] = self._split(at, token, self.next[at][token])
        return made

    def statistics(self, stream: Sequence[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest known sequence that ends at each token."""
        state = length = 0
        for token in stream:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            yield state, length


class Scanner:
    """The automaton of some templates and phrases, with words as numbers."""

    def __init__(self, templates: Mapping[str, Sequence[str]], phrases: Mapping[str, str]):
        texts = [(label, tokens(text)) for label, own in templates.items() for text in own]
        self.labels = [label for label, _ in texts]
        self.sizes = [len(words) for _, words in texts]
        known = sorted({w for _, words in texts for w in words} | {w for p in phrases for w in tokens(p)})
        number = {w: k for k, w in enumerate(known)}
        hashes = np.asarray([hash_word(w) for w in known], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        sequences = [[number[w] for w in words] for _, words in texts]
        self.automaton = SuffixAutomaton(sequences)
        self.pairs = np.zeros((len(known) + 1, len(known) + 1), dtype=bool)
        for sequence in sequences:
            self.pairs[sequence[:-1], sequence[1:]] = True
        self.phrases = [([number[w] for w in tokens(p)], label) for p, label in phrases.items()]

    def ids(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.numbers[at], len(self.hashes))

    def matches(self, ids: np.ndarray) -> list[tuple[int, int, list[tuple[int, int]]]]:
        """(first word, words, places (template, first word)) of each match that can't be made longer to the right."""
        joined = self.pairs[ids[:-1], ids[1:]] if len(ids) > 1 else np.zeros(0, bool)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], joined.astype(np.int8), [0]))))
        found = []
        for low, high in zip(edges[::2], edges[1::2], strict=True):
            if high - low + 1 < LEAST_MATCH:
                continue
            stats = list(self.automaton.statistics(ids[low:high + 1].tolist()))
            for k, (state, length) in enumerate(stats):
                if length >= LEAST_MATCH and (k + 1 == len(stats) or stats[k + 1][1] <= length):
                    found.append((int(low) + k - length + 1, length, [(t, end - length + 1) for t, end in sorted(self.automaton.ends[state])]))
        return found

    def spans(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, last word, share of the template) of the best chain ending at each last match of a template."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for first, length, places in self.matches(ids):
            for template, at in places:
                by_template.setdefault(template, []).append((first, at, length))
        out = []
        for template, own in by_template.items():
            own.sort()
            best: list[tuple[int, int]] = []
            for k, (first, at, length) in enumerate(own):
                covered, start = length, first
                for j in range(k - 1, -1, -1):
                    before, was, size = own[j]
                    if first - before > GAP + self.sizes[template]:
                        break
                    if before + size <= first <= before + size + GAP and was + size <= at and best[j][0] + length > covered:
                        covered, start = best[j][0] + length, best[j][1]
                best.append((covered, start))
            taken: dict[int, tuple[int, int]] = {}
            for (first, _, length), (covered, start) in zip(own, best, strict=True):
                if covered > taken.get(start, (0, 0))[0]:
                    taken[start] = (covered, first + length - 1)
            out += [(self.labels[template], start, last, covered / self.sizes[template]) for start, (covered, last) in taken.items()]
        return sorted(out, key=lambda s: (s[1], s[2], s[0], -s[3]))

    def base(self, ids: np.ndarray) -> dict[str, list[int]]:
        """Where each label's phrases stand."""
        out: dict[str, list[int]] = {}
        for phrase, label in self.phrases:
            n = len(ids) - len(phrase) + 1
            if n > 0:
                hit = np.ones(n, dtype=bool)
                for k, word in enumerate(phrase):
                    hit &= ids[k:k + n] == word
                if places := np.flatnonzero(hit).tolist():
                    out.setdefault(label, []).extend(places)
        return out


@cache
def _scanner(templates: tuple, phrases: tuple) -> Scanner:
    return Scanner(dict(templates), dict(phrases))


SCHEMA = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
          "spans array<struct<label:string,first_word:bigint,last_word:bigint,covered:double>>")


def scan_licenses(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, covered: float = COVERED) -> DataFrame:
    """doc_id with SCHEMA, one row per row of ``docs``: places of the base phrases, labels, and the template spans found.

    A label is added where a span covers ``covered`` of one of its templates; the score is the largest covered share, at
    least 0.5 with a base phrase. NULL and empty texts have no words, empty labels, NULL places and the score 0. Labels are
    distinct, sorted and joined by commas. Repeated rows and NULL ids come back as they are; no rows give no rows.
    """
    rows = docs.select("doc_id", "text")
    key = tuple((label, tuple(own)) for label, own in templates.items()), tuple(phrases.items())
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(*key)
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
        for batch in batches:
            out = []
            for low, high, words, bounds in scan(batch.column(1), PUNCTUATION):
                ids = scanner.ids(words)
                plain = np.concatenate(([0], np.cumsum(ids < len(scanner.hashes))))
                for k in range(high - low):
                    own = ids[bounds[k]:bounds[k + 1]]
                    base, spans = ({}, []) if plain[bounds[k + 1]] == plain[bounds[k]] else (scanner.base(own), scanner.spans(own))
                    places = sorted(p for of in base.values() for p in of)
                    best = max([s[3] for s in spans], default=0.0)
                    labels = set(base) | {s[0] for s in spans if s[3] >= covered}
                    out.append((len(own), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)),
                                max(best, 0.5) if base else best, [dict(zip(("label", "first_word", "last_word", "covered"), s, strict=True)) for s in spans if s[3] >= covered]))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
