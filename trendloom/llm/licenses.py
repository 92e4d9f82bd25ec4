"""License scans with a generalised suffix automaton of license words.

All templates go into one automaton. A text is streamed through it once: at each word the automaton holds the longest
suffix of the text read so far that occurs in some template (the matching statistic). Short phrases are found where they
are such suffixes; long maximal matches are chained, template by template, into spans whose share of the template decides.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8
from .words import words

# Phrases whose every place counts, and the wording of common notices.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy "
        "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        "License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
        "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution."
    ),
    "gpl": "This work is licensed under the GNU General Public License",
    "gpl-3": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "mpl-2": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
LEAST, COVERAGE, GAP = 5, 0.8, 8


class Automaton:
    """A generalised suffix automaton over word ids; 0 stands for a word of no template."""

    def __init__(self, texts: list[tuple[str, str]], phrases: dict[str, str]):
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [{}]
        self.labels, self.sizes = [], []
        for label, text in texts:
            self._add([self.ids.setdefault(w, len(self.ids) + 1) for w in words(text.encode())], label)
        ends = []
        for text, label in phrases.items():
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text.encode())]
            ends.append((seq, label))
            self._add(seq, None)
        order = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for s in order:  # where a state's words end in each template, its longer states included
            for t, at in self.ends[s].items():
                up = self.ends[self.link[s]]
                up[t] = min(at, up.get(t, at))
        own: dict[int, list[tuple[int, str]]] = {}
        for seq, label in ends:
            s = 0
            for w in seq:
                s = self.next[s][w]
            own.setdefault(s, []).append((len(seq), label))
        self.out: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for s in reversed(order):
            self.out[s] = own.get(s, []) + self.out[self.link[s]]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, w: int) -> int:
        """The state that ends the words of p and then w, split off a longer one if need be."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _add(self, seq: list[int], label: str | None) -> None:
        last = 0
        for at, w in enumerate(seq):
            if w in self.next[last]:
                last = self._split(last, w)
            else:
                p, new = last, self._state(self.length[last] + 1, 0, {})
                while p >= 0 and w not in self.next[p]:
                    self.next[p][w] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, w)
                last = new
            if label is not None:
                self.ends[last].setdefault(len(self.labels), at)
        if label is not None:
            self.labels.append(label)
            self.sizes.append(len(seq))

    def stream(self, ids: list[int], least: int = LEAST):
        """Places of the phrases (start, label), and maximal matches (first word, words, state)."""
        state = size = 0
        places, matches = [], []
        nexts, link, length, out = self.next, self.link, self.length, self.out
        for i, w in enumerate(ids):
            if not w:
                if size >= least:
                    matches.append((i - size, size, state))
                state = size = 0
                continue
            to = nexts[state].get(w)
            if to is None:
                if size >= least:
                    matches.append((i - size, size, state))
                while to is None and state:
                    state = link[state]
                    size = length[state]
                    to = nexts[state].get(w)
                if to is None:
                    size = 0
                    continue
            state, size = to, size + 1
            for n, label in out[state]:
                if n <= size:
                    places.append((i - n + 1, label))
        if size >= least:
            matches.append((len(ids) - size, size, state))
        return places, matches

    def chains(self, matches, gap: int = GAP):
        """(label, first word, last word, share of the template) of collinear chains of matches, the best of each template."""
        open_: dict[int, list] = {}
        best: dict[int, tuple] = {}
        for start, size, state in matches:
            for t, at in self.ends[state].items():
                begin = at - size + 1
                c = open_.get(t)
                if c and 0 <= start - c[1] <= gap and 0 <= begin - c[2]:
                    c[1], c[2], c[3] = start + size, at + 1, c[3] + size
                elif c and 0 <= begin - c[2] + max(0, c[1] - start) and c[0] < start <= c[1]:  # overlapping matches
                    over = c[1] - start
                    c[1], c[2], c[3] = max(c[1], start + size), at + 1, c[3] + max(0, size - over)
                else:
                    c = open_[t] = [start, start + size, at + 1, size]
                share = min(1.0, c[3] / self.sizes[t])
                if share > best.get(t, (0,))[0]:
                    best[t] = (share, c[0], c[1] - 1)
        return [(self.labels[t], a, b, share) for t, (share, a, b) in sorted(best.items())]


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first:long,last:long,share:double>>"
)


def scan(docs: DataFrame, templates=tuple(TEMPLATES.items()), phrases=PHRASES, coverage: float = COVERAGE, text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: word count, places and labels of the phrases, labels of covered templates, spans.

    score: 1 with a phrase, else the largest share of a template. Null and empty texts have no words, no labels, score
    0 and null places. Repeated rows are kept. A tie between chains of a template goes to the first. An empty table
    gives an empty result; other columns are ignored.
    """
    templates, phrases = list(templates), dict(phrases)

    def run(batches):
        automaton = Automaton(templates, phrases)
        get = automaton.ids.get
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))
        types = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), span]
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = [get(w, 0) for w in words(text)]
                places, matches = automaton.stream(ids)
                chains = automaton.chains(matches)
                base = {label for _, label in places}
                more = {label for label, _, _, share in chains if share >= coverage}
                starts = [s for s, _ in places]
                rows.append(
                    (
                        i, len(ids), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)),
                        1.0 if base else max((c[3] for c in chains), default=0.0), [dict(zip(("label", "first", "last", "share"), c)) for c in chains],
                    )
                )
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)

    return docs.select(F.col("doc_id").cast("long"), utf8(text_col).alias("text")).mapInArrow(run, SCHEMA)
