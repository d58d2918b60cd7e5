"""License scans with a generalised suffix automaton (operator 9).

Method: one suffix automaton holds the words of all license templates.  A text streams through it
and gives matching statistics: at every word the length of the longest ending there that occurs in
some template.  Long matches are chained, template by template, into covered spans; a template's
label is given when its chain covers enough of it.

Base phrases are read from the same statistics: a phrase ends at a word exactly when the match there
is at least as long as the phrase and the automaton's state lies below the phrase's own state in the
tree of suffix links.

Words are found and hashed with numpy; only stretches whose neighbouring words stand together in
some template (all that can match two words or more) are walked word by word.

Scale: each text is scanned where it lies; nothing is shuffled.  The automaton has as many states as
the templates have words, twice at most (whole license texts as ``templates`` are fine), and is built
in each task.

Defined cases: null texts are empty: no words, no labels, score 0; repeated rows and null
identifiers each get a row; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billcov.llm import words as W

#: Base phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Label and wording (lower case, words only) of license notices.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0-1.0", "cc0 1 0 universal public domain dedication"),
    ("reserved", "all rights reserved no part of this publication may be reproduced"),
]

#: Matches of fewer words don't enter a chain.
MIN_MATCH = 3
#: Words that a chain may skip between two matches, in the text and in the template.
MAX_GAP = 8
#: Percent of a template's words that its chain must cover for the label.
MIN_COVERED = 80

#: Word characters: everything but [\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z are lower-cased.
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

SPANS = "doc_id long, n_words long, places array<struct<label: string, start: long>>, spans array<struct<label: string, template: int, start: long, end: long, covered: double>>"


class SuffixAutomaton:
    """Generalised suffix automaton over token sequences; each end position is kept at one state."""

    def __init__(self, sequences: list[list[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (sequence, index of its last token), own ones
        for s, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].append((s, i))
        self.below: dict[int, list[int]] = {}
        for v in range(1, len(self.length)):
            if self.link[v] > 0:
                self.below.setdefault(self.link[v], []).append(v)

    def positions(self, state: int) -> list[tuple[int, int]]:
        """(sequence, last token) of every place where the state's strings end, in order: its own and those of the states below it in the suffix-link tree."""
        out, stack = [], [state]
        while stack:
            v = stack.pop()
            out += self.ends[v]
            stack += self.below.get(v, ())
        return sorted(out)

    def _new(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, token: int, q: int) -> int:
        """State for the strings of q that end with those of p and the token."""
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:  # the sequence so far occurs in an earlier one
            return q if self.length[q] == self.length[last] + 1 else self._split(last, token, q)
        cur = self._new(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, token, q)
        return cur

    def find(self, sequence: list[int]) -> int:
        """State of a sequence that occurs."""
        v = 0
        for token in sequence:
            v = self.next[v][token]
        return v

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, length) of the longest match that ends at each token."""
        v, n = 0, 0
        for token in tokens:
            while v and token not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if token in self.next[v]:
                v, n = self.next[v][token], n + 1
            yield v, n


class Scanner:
    """Words, base places and covered template spans of texts."""

    def __init__(self, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], min_match: int, max_gap: int, min_covered: int) -> None:
        self.templates, self.min_match, self.max_gap, self.min_covered = templates, min_match, max_gap, min_covered
        sequences = [t.split(" ") for _, t in templates] + [p.split(" ") for p, _ in phrases]
        vocabulary = sorted({w for s in sequences for w in s})
        raw = np.frombuffer(" ".join(vocabulary).encode(), dtype=np.uint8)
        hashes = W.words_of(raw, np.array([0, len(raw)])).hash
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        number = {w: i for i, w in enumerate(vocabulary)}
        self.sequences = [[number[w] for w in s] for s in sequences]
        self.automaton = SuffixAutomaton(self.sequences)
        # Neighbouring words of the templates, as sorted codes.
        self.base = len(vocabulary) + 1
        self.pairs = np.unique(np.array([a * self.base + b for s in self.sequences for a, b in zip(s, s[1:])], dtype=np.int64))
        a = self.automaton
        self.phrases = {}  # state -> (label, length) of the phrases that end there
        marked = {a.find(s): (label, len(s)) for s, (_, label) in zip(self.sequences[len(templates) :], phrases)}
        for v in range(len(a.length)):
            up, here = v, []
            while up > 0:
                if up in marked:
                    here.append(marked[up])
                up = a.link[up]
            if here:
                self.phrases[v] = here

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, self.ids[at], len(self.ids))

    def near(self, tokens: np.ndarray) -> np.ndarray:
        """Whether each word stands before the next one in some template."""
        if len(tokens) < 2 or not len(self.pairs):
            return np.zeros(max(len(tokens) - 1, 0), bool)
        code = tokens[:-1] * self.base + tokens[1:]
        return self.pairs[np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)] == code

    def walk(self, tokens: list[int], at: int) -> tuple[list[tuple[str, int]], list[tuple[int, int, int]]]:
        """(base places; maximal matches (end word, length, state)) of a stretch that begins at word ``at``."""
        places, matches = [], []
        before = (0, 0)
        for i, (v, n) in enumerate(self.automaton.statistics(tokens), at):
            for label, size in self.phrases.get(v, ()):
                if n >= size:
                    places.append((label, i - size + 1))
            if before[1] >= self.min_match and n <= before[1]:
                matches.append((i - 1, before[1], before[0]))
            before = (v, n)
        if before[1] >= self.min_match:
            matches.append((at + len(tokens) - 1, before[1], before[0]))
        return places, matches

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, int, float]]:
        """Chains of matches that go forward in text and template; (label, template, start, end, covered share)."""
        out = []
        open_: dict[int, list[tuple[int, int, int, int]]] = {}  # template -> chains (text start, text end, template end, words covered)

        def close(t: int, chains: list[tuple[int, int, int, int]]) -> None:
            for start, end, _, covered in chains:
                if 100 * covered >= self.min_covered * len(self.sequences[t]):
                    out.append((self.templates[t][0], t, start, end, covered / len(self.sequences[t])))

        for end, size, state in matches:
            for t, last in self.automaton.positions(state):
                if t >= len(self.templates):
                    continue
                chains, stay, best = open_.get(t, []), [], None
                for c in chains:
                    if end - size + 1 - c[1] > self.max_gap + 1:
                        close(t, [c])
                        continue
                    stay.append(c)
                    # Words of the match beyond what the chain already has, in text and template.
                    fresh = min(size, end - c[1], last - c[2])
                    if fresh > 0 and last - fresh - c[2] <= self.max_gap and end - fresh >= c[1] and (best is None or c[3] + fresh > best[1][3]):
                        best = (c, (c[0], end, last, c[3] + fresh))
                mine = (end - size + 1, end, last, size)
                if best is not None and best[1][3] > size:
                    stay.remove(best[0])
                    mine = best[1]
                open_[t] = [*stay, mine]
        for t, chains in open_.items():
            close(t, chains)
        return out


def _scan(options: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*options)
        kinds = [
            pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())])),
            pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])),
        ]
        for batch in batches:
            for i, raw, offsets in W.slices(batch.column(1)):
                n = len(offsets) - 1
                low = W.LOWER[raw]
                w = W.words_of(low, offsets, _WORD[low])
                tokens = scanner.tokens(w.hash)
                near = scanner.near(tokens) & (w.doc[:-1] == w.doc[1:]) if len(tokens) else np.zeros(0, bool)
                both = np.concatenate([[False], near, [False]])
                begin, stop = np.flatnonzero(both[1:] & ~both[:-1]), np.flatnonzero(~both[1:] & both[:-1]) + 1
                first = np.searchsorted(w.doc, np.arange(n + 1))
                places: list[list[dict]] = [[] for _ in range(n)]
                matches: list[list[tuple]] = [[] for _ in range(n)]
                for a, b in zip(begin.tolist(), stop.tolist()):
                    d = int(w.doc[a])
                    p, m = scanner.walk(tokens[a:b].tolist(), a - int(first[d]))
                    places[d] += [{"label": x, "start": s} for x, s in p]
                    matches[d] += m
                names = ("label", "template", "start", "end", "covered")
                spans = [[dict(zip(names, s)) for s in sorted(scanner.chain(m), key=lambda s: (s[2], s[3], s[1]))] if m else [] for m in matches]
                yield pa.record_batch(
                    [batch.column(0).slice(i, n), pa.array(np.diff(first), pa.int64()), pa.array(places, kinds[0]), pa.array(spans, kinds[1])],
                    names=["doc_id", "n_words", "places", "spans"],
                )

    return run


def license_spans(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: list[tuple[str, str]] = PHRASES,
    min_match: int = MIN_MATCH,
    max_gap: int = MAX_GAP,
    min_covered: int = MIN_COVERED,
) -> DataFrame:
    """One row per document: doc_id, n_words, places (base phrases by word), spans (covered templates)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(W.tidied(_scan((templates, phrases, min_match, max_gap, min_covered))), SPANS)


def digest(found: DataFrame) -> DataFrame:
    starts = F.transform("places", lambda p: p["start"])
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    base = F.transform("places", lambda p: p["label"])
    best = F.array_max(F.transform("spans", lambda s: s["covered"]))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        join(base).alias("base_labels"), join(F.concat(base, F.transform("spans", lambda s: s["label"]))).alias("labels"),
        F.least(F.coalesce(best, F.lit(0.0)), F.lit(1.0)).alias("score"),
    )
