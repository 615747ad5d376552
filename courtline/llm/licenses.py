"""Licence scans: a generalised suffix automaton of licence texts, matching statistics, chains."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtline.llm.common import map_batches

#: Words of a match at least, words a chain may skip between matches, and what makes a label:
#: the share of a template's words, or so many of them.
MIN_MATCH = 4
MAX_GAP = 6
MIN_SHARE = 0.75
MIN_WORDS = 24

# fixed values: the phrases of the contract and the published wording of common licences
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)

_CLASS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def license_words(text: str) -> list[bytes]:
    """Words of digits, letters and non-ASCII characters, A-Z in lower case."""
    return text.encode().translate(_CLASS).split()


@dataclass
class Automaton:
    """Suffix automaton of several token sequences; each state knows where its strings end."""

    nexts: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[set[tuple[int, int]]] = field(default_factory=lambda: [set()])

    def _state(self, length: int, nexts: dict[int, int], link: int) -> int:
        self.nexts.append(nexts)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.nexts[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.nexts[p].get(token) == q:
            self.nexts[p][token] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if (q := self.nexts[last].get(token)) is not None:  # a later sequence may repeat a string
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, token)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.nexts[p]:
            self.nexts[p][token] = new
            p = self.link[p]
        if p >= 0:
            q = self.nexts[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, token)
        return new

    def add(self, sequence: list[int]) -> None:
        last = 0
        for token in sequence:
            last = self._extend(last, token)

    def mark_ends(self, sequences: list[list[int]]) -> None:
        """Note (sequence, end) at the state of each prefix and at the states of its suffixes."""
        for k, sequence in enumerate(sequences):
            state = 0
            for i, token in enumerate(sequence):
                state = self.nexts[state][token]
                s = state
                while s > 0:
                    self.ends[s].add((k, i + 1))
                    s = self.link[s]

    def matches(self, tokens: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of each match of ``least`` tokens or more that cannot go on."""
        state = size = 0
        for i, token in enumerate(tokens):
            to = self.nexts[state].get(token)
            if to is None:
                if size >= least:
                    yield i, size, state
                while state > 0 and to is None:
                    state = self.link[state]
                    size = self.length[state]
                    to = self.nexts[state].get(token)
            if to is None:
                state = size = 0
            else:
                state, size = to, size + 1
        if size >= least:
            yield len(tokens), size, state


def chain(spans: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """(words covered, first, end) of the best chain of (text start, template start, words).

    Matches follow each other in text and template with at most MAX_GAP words skipped in the
    text; words two matches share count once.
    """
    best: list[tuple[int, int]] = []
    spans = sorted(spans)
    longest = max(s[2] for s in spans)
    for j, (at, start, size) in enumerate(spans):
        cover, first = size, at
        for i in range(j - 1, -1, -1):
            a, s, n = spans[i]
            if at - a > longest + MAX_GAP:
                break
            if a < at and s < start and at - (a + n) <= MAX_GAP:
                got = best[i][0] + size - max(0, a + n - at, s + n - start)
                if got > cover:
                    cover, first = got, best[i][1]
        best.append((cover, first))
    cover, first, end = max((c, -f, at + size) for (c, f), (at, _, size) in zip(best, spans, strict=True))
    return cover, -first, end


class Scanner:
    """Vocabulary, automaton and phrases of a template set; scans one text at a time."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES) -> None:
        self.labels = [label for label, _ in templates]
        words = [license_words(text) for _, text in templates]
        self.phrases = [([w for w in p.encode().split()], label) for p, label in phrases]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for x in words + [p for p, _ in self.phrases] for w in x}))}
        sequences = [[self.vocabulary[w] for w in x] for x in words]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton()
        for s in sequences:
            self.automaton.add(s)
        self.automaton.mark_ends(sequences)
        self.phrases = [([self.vocabulary[w] for w in p], label) for p, label in self.phrases]

    def base(self, codes: np.ndarray) -> tuple[int, int | None, int | None, set[str]]:
        """Places of the phrases: count, smallest and largest start, labels."""
        starts, labels = [], set()
        for phrase, label in self.phrases:
            n = len(codes) - len(phrase) + 1
            if n <= 0:
                continue
            at = np.logical_and.reduce([codes[j : j + n] == t for j, t in enumerate(phrase)]).nonzero()[0]
            if len(at):
                starts += [len(at), int(at[0]), int(at[-1])]
                labels.add(label)
        if not starts:
            return 0, None, None, labels
        return sum(starts[::3]), min(starts[1::3]), max(starts[2::3]), labels

    def spans(self, codes: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(template, words covered, share, first word, end word) of the best chain per template."""
        known = np.concatenate([[False], codes >= 0, [False]])
        edges = np.diff(known.astype(np.int8)).nonzero()[0].reshape(-1, 2)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for begin, end in edges[edges[:, 1] - edges[:, 0] >= MIN_MATCH].tolist():
            for stop, size, state in self.automaton.matches(codes[begin:end].tolist(), MIN_MATCH):
                last: dict[int, int] = {}
                for k, e in sorted(self.automaton.ends[state]):
                    last.setdefault(k, e)  # a passage that a template repeats: its first place
                for k, e in last.items():
                    found.setdefault(k, []).append((begin + stop - size, e - size, size))
        out = []
        for k, spans in sorted(found.items()):
            cover, first, end = best_of_groups(spans)
            out.append((k, cover, min(1.0, cover / self.sizes[k]), first, end))
        return out

    def scan(self, text: str) -> dict:
        words = license_words(text)
        codes = np.fromiter((self.vocabulary.get(w, -1) for w in words), np.int32, len(words))
        n_base, first, last, base = self.base(codes)
        spans = self.spans(codes)
        labels = {self.labels[k] for k, cover, share, _, _ in spans if share >= MIN_SHARE or cover >= MIN_WORDS}
        score = 1.0 if base else max((share for _, _, share, _, _ in spans), default=0.0)
        return {
            "n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last,
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": score,
            "spans": ";".join(f"{self.labels[k]}:{f}:{e}" for k, cover, share, f, e in spans if share >= MIN_SHARE or cover >= MIN_WORDS),
        }


def best_of_groups(spans: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The best chain; matches too far apart to meet are chained apart, so long texts stay linear."""
    spans = sorted(spans)
    groups, reach = [[spans[0]]], spans[0][0] + spans[0][2]
    for s in spans[1:]:
        if s[0] - reach > MAX_GAP:
            groups.append([])
        groups[-1].append(s)
        reach = max(reach, s[0] + s[2])
    return max((chain(g) for g in groups), key=lambda c: (c[0], -c[1]))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, phrase places, labels, score, spans.

    One pass without a shuffle: every task builds the automaton of the templates (a few
    hundred words) and streams whole texts through it. ``labels`` are those of the phrases and
    of templates whose best chain covers MIN_SHARE of them or MIN_WORDS words; ``score`` is the
    largest covered share, 1 where a phrase stands. ``spans`` lists label:first:end in words.

    Null text is empty: no words, no labels, score 0. Repeated rows: repeated result rows; a
    null doc_id stays null; other columns are ignored; no rows, no result.
    """
    schema = {
        "doc_id": "long", "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long",
        "base_labels": "string", "labels": "string", "score": "double", "spans": "string",
    }
    made: list[Scanner] = []

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        if not made:
            made.append(Scanner(templates, phrases))
        rows = [made[0].scan(t or "") for t in batch.column("text").to_pylist()]
        yield {"doc_id": batch.column("doc_id").to_pylist()} | {c: [r[c] for r in rows] for c in schema if c != "doc_id"}

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), run, schema)
