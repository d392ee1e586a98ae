"""Licence scans: matching statistics from a generalised suffix automaton, chained into template spans."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gapweave.llm.arrays import FOLD, NOT_ALNUM, U64, Words, grams, words
from gapweave.llm.tables import appended

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening passages of public licence notices, by label.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
#: Shortest match that is chained, in words, and the share of a template that must be covered.
MATCH_WORDS = 5
COVERED = 0.6


def _words(text: str) -> Words:
    return next(words(pa.array([text]), NOT_ALNUM, FOLD))


class Automaton:
    """Suffix automaton of several word sequences. Every state knows where in the templates its longest string ends."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, tokens in enumerate(templates):
            last = 0
            for place, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].append((number, place))
        for state in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            self.ends[self.link[state]].extend(self.ends[state])

    def _state(self, size: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(link)
        self.ends.append([])
        return len(self.size) - 1

    def _split(self, state: int, token: int) -> int:
        """The state reached by token that holds only strings one longer than those of state."""
        target = self.next[state][token]
        if self.size[target] == self.size[state] + 1:
            return target
        copy = self._state(self.size[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new = self._state(self.size[last] + 1, {}, 0)
        state = last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        self.link[new] = 0 if state < 0 else self._split(state, token)
        return new

    def matches(self, tokens: list[int], shortest: int) -> list[tuple[int, int, int]]:
        """(end, length, state) of every match of at least shortest tokens that cannot go on to the right.

        The matching statistics are walked token by token: the longest suffix of what was read
        that occurs in a template.
        """
        out, state, length = [], 0, 0
        for place, token in enumerate(tokens):
            if token not in self.next[state]:
                if length >= shortest:
                    out.append((place - 1, length, state))
                while state > 0 and token not in self.next[state]:
                    state = self.link[state]
                    length = self.size[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            else:
                state, length = 0, 0
        if length >= shortest:
            out.append((len(tokens) - 1, length, state))
        return out


    def occurrences(self, tokens: list[int], shortest: int) -> list[tuple[int, int, int, int]]:
        """(end, length, template, end in the template) of every match of at least shortest tokens that no token extends, template by template.

        The longest suffix of what was read that occurs in a template is walked token by token, and from it
        the suffix links: a shorter suffix may stand in other templates, and at other places, than the longest.
        """
        out, state, length = [], 0, 0
        before: dict[tuple[int, int], int] = {}
        for place, token in enumerate([*tokens, None]):
            while state > 0 and token not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            state, length = (self.next[state][token], length + 1) if token in self.next[state] else (0, 0)
            now: dict[tuple[int, int], int] = {}
            each, size = state, length
            while size >= shortest:
                for end in self.ends[each]:
                    now.setdefault(end, size)
                each = self.link[each]
                size = self.size[each]
            out += [(place - 1, size, template, end) for (template, end), size in before.items() if (template, end + 1) not in now]
            before = now
        return out


@dataclass
class Library:
    """Templates as word hashes, ready to scan."""

    labels: list[str]
    sizes: list[int]
    vocabulary: np.ndarray
    starts: np.ndarray  # hashes of all runs of MATCH_WORDS words
    automaton: Automaton


def library(templates: dict[str, str]) -> Library:
    found = [_words(t) for t in templates.values()]
    vocabulary = np.unique(np.concatenate([w.hashes for w in found]))
    runs = np.unique(np.concatenate([grams(w, MATCH_WORDS)[0] for w in found]))
    numbered = [np.searchsorted(vocabulary, w.hashes).tolist() for w in found]
    return Library(list(templates), [len(w.hashes) for w in found], vocabulary, runs, Automaton(numbered))


def chain(spans: list[tuple[int, int, int]], size: int) -> tuple[int, int, int]:
    """(covered words, first, last) of the best chain of (text start, template start, length) matches.

    Matches of a chain follow each other in text and template without overlap; the chain that
    covers most words of the template wins. A Fenwick tree over template places keeps the best
    chain that ends before each, so the time is m log size for m matches.
    """
    tree: list[tuple[int, int]] = [(0, 0)] * (size + 1)  # (covered, -first)

    def best(place: int) -> tuple[int, int]:
        found = (0, 0)
        while place > 0:
            found = max(found, tree[place])
            place -= place & -place
        return found

    events = sorted([(a, 0, k) for k, (a, _, n) in enumerate(spans)] + [(a + n, -1, k) for k, (a, _, n) in enumerate(spans)])
    ready: dict[int, tuple[int, int]] = {}
    top = (0, 0, 0)
    for _, kind, k in events:
        text, place, n = spans[k]
        if kind == 0:
            covered, first = best(place)
            ready[k] = (covered + n, first if covered else -text)
            top = max(top, (covered + n, -ready[k][1] * -1, -(text + n - 1)))
        else:
            at = place + n
            while at <= size:
                tree[at] = max(tree[at], ready[k])
                at += at & -at
    covered, first, last = top
    return covered, -first, -last


def _scan_row(tokens: np.ndarray, known: Library) -> list[tuple[int, float, int, int]]:
    """(template, covered share, first, last) of the best chain of each template in one text; tokens: vocabulary numbers or -1."""
    spans: dict[int, list[tuple[int, int, int]]] = {}
    inside = np.flatnonzero(np.diff(np.concatenate([[False], tokens >= 0, [False]]).astype(np.int8)))
    for low, high in inside.reshape(-1, 2):
        if high - low < MATCH_WORDS:
            continue
        for end, length, template, place in known.automaton.occurrences(tokens[low:high].tolist(), MATCH_WORDS):
            spans.setdefault(template, []).append((int(low) + end - length + 1, place - length + 1, length))
    out = []
    for template, found in sorted(spans.items()):
        covered, first, last = chain(found, known.sizes[template])
        out.append((template, covered / known.sizes[template], first, last))
    return out


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,covered:double,first:long,last:long>>"
)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, share: float = COVERED, carry: list[str] | None = None) -> DataFrame:
    """docs (its columns in carry; None: all) with the licence phrases and templates of each text.

    Words are runs of digits, ASCII letters (A-Z lower-cased) and non-ASCII bytes. n_base
    counts the places where a phrase's words stand consecutively, first_word and last_word
    are the smallest and largest of them. spans: for each template the chain of exact matches
    of MATCH_WORDS or more words that covers most of it, with its share and its first and last
    word. labels: those of the phrases and of templates covered by at least share. score: the
    largest covered share, 1 where a phrase stands.

    Null text is empty: no words, no labels (empty strings), score 0. Texts are read from end
    to end; the automaton runs only over stretches of template words that hold a run of
    MATCH_WORDS words of a template, as no other place has a match that long.
    """
    known = library(TEMPLATES if templates is None else templates)
    wanted = [(label, _words(phrase).hashes) for phrase, label in (PHRASES if phrases is None else phrases).items()]
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def look(column: pa.Array) -> dict[str, pa.Array]:
        known = shared.value
        rows = len(column)
        n_words, n_base, first, last = (np.zeros(rows, np.int64) for _ in range(4))
        base = [set() for _ in range(rows)]
        more: list[list] = [[] for _ in range(rows)]
        for part in words(column, NOT_ALNUM, FOLD):
            n_words[part.low : part.low + part.rows] = np.diff(part.first)
            if not len(part.hashes):
                continue
            row = part.row_of()
            for label, phrase in wanted:
                count = len(part.hashes) - len(phrase) + 1
                if count <= 0:
                    continue
                hit = row[:count] == row[len(phrase) - 1 :]
                for k, h in enumerate(phrase):
                    hit &= part.hashes[k : k + count] == h
                for at in np.flatnonzero(hit):
                    r = part.low + row[at]
                    place = at - part.first[row[at]]
                    first[r] = place if not n_base[r] else min(first[r], place)
                    last[r] = max(last[r], place)
                    n_base[r] += 1
                    base[r].add(label)
            runs, at = grams(part, MATCH_WORDS)
            for r in np.unique(row[at[np.isin(runs, known.starts)]]) if len(known.starts) else []:
                hashes = part.hashes[part.first[r] : part.first[r + 1]]
                number = np.minimum(np.searchsorted(known.vocabulary, hashes), len(known.vocabulary) - 1)
                more[part.low + r] = _scan_row(np.where(known.vocabulary[number] == hashes, number, -1), known)
        none = n_base == 0
        labels = [b | {known.labels[t] for t, s, _, _ in m if s >= share} for b, m in zip(base, more, strict=True)]
        spans = [[{"label": known.labels[t], "covered": s, "first": a, "last": b} for t, s, a, b in m] for m in more]
        kind = pa.list_(pa.struct([("label", pa.string()), ("covered", pa.float64()), ("first", pa.int64()), ("last", pa.int64())]))
        return {
            "n_words": pa.array(n_words),
            "n_base": pa.array(n_base),
            "first_word": pa.array(first, mask=none),
            "last_word": pa.array(last, mask=none),
            "base_labels": pa.array([",".join(sorted(b)) for b in base], pa.string()),
            "labels": pa.array([",".join(sorted(x)) for x in labels], pa.string()),
            "score": pa.array([1.0 if b else max((min(s, 1.0) for _, s, _, _ in m), default=0.0) for b, m in zip(base, more, strict=True)], pa.float64()),
            "spans": pa.array(spans, kind),
        }

    return appended(docs, "text", look, SCHEMA, carry)
