"""Licence texts inside documents, found with a generalised suffix automaton of licence words.

All templates are read into one automaton. A document is streamed through it, which gives the
matching statistics: at every word the longest run of words ending there that some template
holds, and the automaton state of that run. Where a run cannot be extended it is a maximal
match; those of enough words are placed in their templates and chained, in document and
template order with bounded gaps, into the spans that a template covers. Short phrases are
states of the same automaton: a phrase stands at a word exactly if its state is on the suffix
path of the streamed state and the run is long enough.

Words that no template has reset the automaton, so only runs of known words are streamed.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm.base import map_batches
from weftlog.llm.words import words_of

# Phrases whose places are counted, with their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Passages of public licences, by which their whole or partial texts are known.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
               "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
            "conditions and the following disclaimer"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

# Words of a maximal match that may enter a chain, words of a gap inside one (in the document and
# in the template), and the share of a template that a span must cover to carry its label.
MIN_MATCH = 4
MAX_GAP = 12
MIN_SHARE = 0.7


class Automaton:
    """Generalised suffix automaton of word sequences given as lists of numbers."""

    def __init__(self, texts: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.prefixes: list[tuple[int, int, int]] = []  # state, text, end
        for k, text in enumerate(texts):
            last = 0
            for end, w in enumerate(text):
                last = self._extend(last, w)
                self.prefixes.append((last, k, end))
        self._number()

    def _extend(self, last: int, w: int) -> int:
        seen = self.next[last].get(w)
        if seen is not None:
            return seen if self.length[seen] == self.length[last] + 1 else self._split(last, seen, w)
        new = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def _state(self, length: int, step: dict[int, int]) -> int:
        self.next.append(step)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        """A copy of q for the runs that end at `w` after p, shorter than q's own."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _number(self) -> None:
        """Number the suffix tree depth first: the places of a state are those of its interval."""
        below: list[list[int]] = [[] for _ in self.link]
        for v, p in enumerate(self.link):
            if p >= 0:
                below[p].append(v)
        self.first, self.last, clock, stack = [0] * len(self.link), [0] * len(self.link), 0, [(0, False)]
        while stack:
            v, done = stack.pop()
            if done:
                self.last[v] = clock - 1
                continue
            self.first[v] = clock
            clock += 1
            stack.append((v, True))
            stack += [(c, False) for c in below[v]]
        self.prefixes.sort(key=lambda p: self.first[p[0]])
        self._at = [self.first[v] for v, *_ in self.prefixes]

    def places(self, state: int) -> list[tuple[int, int]]:
        """(text, end) of all places where the runs of `state` end."""
        lo, hi = bisect_left(self._at, self.first[state]), bisect_right(self._at, self.last[state])
        return [(k, end) for _, k, end in self.prefixes[lo:hi]]

    def walk(self, text: Sequence[int]):
        """(state, length of the longest known run) after every word."""
        state = length = 0
        step, link, longest = self.next, self.link, self.length
        for w in text:
            to = step[state].get(w)
            while to is None and state:
                state = link[state]
                length = longest[state]
                to = step[state].get(w)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            yield state, length

    def state_of(self, text: Sequence[int]) -> int:
        state = 0
        for w in text:
            state = self.next[state][w]
        return state


@dataclass(frozen=True)
class Span:
    """Words `first` to `last` of a document that cover `covered` of the `size` words of a template."""

    template: int
    first: int
    last: int
    covered: int
    size: int

    @property
    def share(self) -> float:
        return self.covered / self.size


class Scanner:
    def __init__(self, templates, phrases, min_match: int, max_gap: int):
        self.min_match, self.max_gap = min_match, max_gap
        self.vocabulary: dict[bytes, int] = {}
        split = lambda t: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(t.encode())]
        self.templates = [split(t) for _, t in templates]
        self.phrases = [split(p) for p, _ in phrases]
        # Templates of fewer words than a match must have are matched whole.
        self.shortest = min([min_match, *(len(t) for t in self.templates)])
        self.automaton = Automaton([*self.templates, *self.phrases])
        self.ends = {p[-1] for p in self.phrases}
        states = {}
        for k, p in enumerate(self.phrases):
            states.setdefault(self.automaton.state_of(p), []).append(k)
        # Phrases on the suffix path of every state; a phrase's own state may stand for shorter runs.
        self.on_path: list[list[int]] = [[] for _ in self.automaton.link]
        for v in sorted(range(1, len(self.on_path)), key=self.automaton.length.__getitem__):
            self.on_path[v] = [*self.on_path[self.automaton.link[v]], *states.get(v, [])]

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], list[Span]]:
        """Starts of every phrase, and the spans of all templates."""
        get, out = self.vocabulary.get, [[] for _ in self.phrases]
        codes = list(map(get, words))
        matches: dict[int, list[tuple[int, int, int]]] = {}
        at, total = 0, len(codes)
        while at < total:
            if codes[at] is None:
                at += 1
                continue
            stop = at + 1
            while stop < total and codes[stop] is not None:
                stop += 1
            run = codes[at:stop]
            if len(run) >= self.shortest or not self.ends.isdisjoint(run):
                self._stream(run, at, out, matches)
            at = stop
        spans = [s for k, found in sorted(matches.items()) for s in self._chains(k, found)]
        return out, spans

    def _stream(self, run: list[int], at: int, out: list[list[int]], matches: dict) -> None:
        state = length = 0
        for i, (to, n) in enumerate(self.automaton.walk(run)):
            if n <= length and length >= self.shortest:
                self._place(state, length, at + i - 1, matches)
            for k in self.on_path[to]:
                if n >= len(self.phrases[k]):
                    out[k].append(at + i + 1 - len(self.phrases[k]))
            state, length = to, n
        if length >= self.shortest:
            self._place(state, length, at + len(run) - 1, matches)

    def _place(self, state: int, length: int, end: int, matches: dict) -> None:
        for k, there in self.automaton.places(state):
            if k < len(self.templates) and length >= min(self.min_match, len(self.templates[k])):
                matches.setdefault(k, []).append((end, there, length))

    def _chains(self, k: int, found: list[tuple[int, int, int]]) -> list[Span]:
        """Chains of matches (document end, template end, words) of template k, best first where they
        share words of the document; then those that are left, in document order."""
        found.sort()
        best: list[tuple[int, int, int]] = []  # covered words, number of the match before, first document word
        open_from = 0
        longest = len(self.templates[k])
        for i, (end, there, n) in enumerate(found):
            covered, before, first = n, -1, end - n + 1
            while found[open_from][0] < end - longest - self.max_gap:
                open_from += 1
            for j in range(open_from, i):
                e, t, _ = found[j]
                if e >= end or t >= there:
                    continue
                new = min(n, end - e, there - t)  # words of this match after the other one
                if end - new - e <= self.max_gap and there - new - t <= self.max_gap and best[j][0] + new > covered:
                    covered, before, first = best[j][0] + new, j, best[j][2]
            best.append((covered, before, first))
        spans: list[Span] = []  # in document order, none overlapping
        for i in sorted(range(len(found)), key=lambda i: (-best[i][0], best[i][2])):
            span = Span(k, best[i][2], found[i][0], best[i][0], longest)
            at = bisect_left(spans, span.first, key=lambda s: s.first)
            if (at == 0 or spans[at - 1].last < span.first) and (at == len(spans) or span.last < spans[at].first):
                spans.insert(at, span)
        return spans


_scanners: dict[tuple, Scanner] = {}


def _scanner(templates, phrases, min_match: int, max_gap: int) -> Scanner:
    key = (tuple(templates), tuple(phrases), min_match, max_gap)
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(*key)
    return _scanners[key]


_SPANS = ("n_words bigint, places array<struct<label:string,starts:array<bigint>>>, "
          "spans array<struct<label:string,first:bigint,last:bigint,covered:bigint,share:double>>")


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, *,
         min_match: int = MIN_MATCH, max_gap: int = MAX_GAP) -> DataFrame:
    """doc_id, n_words, places, spans for every row of `docs` (doc_id, text; other columns are ignored).

    `templates` and `phrases` are (label, text) and (text, label). `places` has the starts of every
    phrase, in words from 0; `spans` has the chained spans of templates, whatever their share.
    Spans of one template do not overlap. Null and empty texts have neither; repeated rows and
    null ids are rows like any other. Nothing moves: a task holds one batch and the automaton.
    """
    templates, phrases = list(templates), list(phrases)

    def run(ids, raws):
        scanner = _scanner(templates, phrases, min_match, max_gap)
        sizes, places, spans = [], [], []
        for raw in raws:
            words = words_of(raw)
            starts, found = scanner.scan(words)
            sizes.append(len(words))
            places.append([{"label": label, "starts": s} for (_, label), s in zip(phrases, starts) if s])
            spans.append([{"label": templates[s.template][0], "first": s.first, "last": s.last, "covered": s.covered, "share": s.share}
                          for s in found])
        return {"doc_id": ids, "n_words": sizes, "places": places, "spans": spans}

    return map_batches(docs.select("doc_id", F.col("text").cast("binary").alias("raw")), run, f"doc_id bigint, {_SPANS}")


def verdicts(scanned: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of what `scan` found.

    `score` is the largest share of a template that a span covers, 0 without spans."""
    starts = F.flatten("places.starts")
    base = F.array_distinct(F.col("places.label"))
    covered = F.filter("spans", lambda s: s["share"] >= min_share)
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(starts).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        text(base).alias("base_labels"), text(F.concat(base, F.transform(covered, lambda s: s["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.col("spans.share")), F.lit(0.0)).alias("score"))
