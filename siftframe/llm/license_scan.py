"""Licence scanning with a generalised suffix automaton of licence tokens.

The automaton is built once over the tokens of all templates (short licence
notices and phrases). Streaming a file's words through it gives the matching
statistics: at every word the longest run ending there that occurs in some
template, with the automaton state. Word pairs that no template holds reset
the walk, so only stretches of template word pairs are walked. Maximal matches
of at least ``min_match`` words are chained in template order into spans; a
template's score is the share of its words that the chain covers. Phrases are
templates that must match whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.llm.common import per_worker, small_batches
from siftframe.llm.tokens import LOWER, buffers, grams, words

WORD = np.ones(256, bool)
WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False

# Phrases with the label each of them gives.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Opening notices of public licences, one label each.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
           "documentation files the software to deal in the software without restriction",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
              "with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
           "public license as published by the free software foundation",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
            "general public license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
           "the following conditions are met",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights",
    "proprietary": "all rights reserved",
}


@dataclass(frozen=True)
class LicenseConfig:
    min_match: int = 3        # words of a maximal match that may enter a chain
    min_cover: float = 0.6    # covered share of a template that gives its label
    max_gap: int = 8          # words between chained matches


class Automaton:
    """Generalised suffix automaton over token sequences, with one end position kept per state and template."""

    def __init__(self, templates: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        for t, tokens in enumerate(templates):
            last = 0
            for i, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].setdefault(t, []).append(i)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for s in order:  # a state's suffix ends wherever the state does
            for t, at in self.ends[s].items():
                mine = self.ends[self.link[s]].setdefault(t, [])
                mine += [i for i in at if i not in mine]

    def _extend(self, last: int, token: int) -> int:
        known = self.next[last].get(token)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        made = -1
        if known is None:
            made = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = made
            p = self.link[p]
        if p < 0:
            self.link[made] = 0
            return made
        q = self.next[p][token]
        if self.length[q] != self.length[p] + 1:
            clone = self._state(self.length[p] + 1, dict(self.next[q]))
            self.link[clone] = self.link[q]
            self.link[q] = clone
            while p >= 0 and self.next[p].get(token) == q:
                self.next[p][token] = clone
                p = self.link[p]
            q = clone
        if made < 0:
            return q
        self.link[made] = q
        return made

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        self.ends.append({})
        return len(self.length) - 1

    def statistics(self, tokens: list[int]) -> Iterator[tuple[int, int]]:
        """(state, matched words) after every token."""
        state = size = 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if token in self.next[state]:
                state, size = self.next[state][token], size + 1
            yield state, size


class Scanner:
    """Templates, their automaton and the hashes by which a batch's words are recognised."""

    def __init__(self, cfg: LicenseConfig, phrases: dict[str, str], notices: dict[str, str]):
        self.cfg = cfg
        self.templates = [*phrases, *notices.values()]
        self.labels = [*phrases.values(), *notices]
        self.n_phrases = len(phrases)
        self.split = [t.split() for t in self.templates]
        vocabulary = sorted({w for t in self.split for w in t})
        number = {w: i for i, w in enumerate(vocabulary)}
        self.automaton = Automaton([[number[w] for w in t] for t in self.split])
        h = words(*buffers(pa.array(vocabulary, pa.string())), WORD).hashes()
        self.order = np.argsort(h)
        self.known = h[self.order]
        pairs = sorted({(number[a], number[b]) for t in self.split for a, b in zip(t, t[1:], strict=False)})
        flat = h[np.array(pairs, np.int64).ravel()]
        self.pairs = np.unique(grams(flat, 2, np.arange(0, len(flat), 2)))

    def scan(self, text: pa.Array) -> list[tuple]:
        """Per text: (words, base places, first, last, base labels, labels, score, spans)."""
        data, offsets = buffers(text)
        w = words(LOWER[data], offsets, WORD)
        counts = w.counts.tolist()
        out = [(n, 0, None, None, "", "", 0.0, []) for n in counts]
        if len(w.starts) < 2:
            return out
        h = w.hashes()
        pair = grams(h, 2, np.arange(len(h) - 1))
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        hit = self.pairs[at] == pair
        hit[w.first[1:-1][(w.first[1:-1] > 0) & (w.first[1:-1] < len(h))] - 1] = False  # not across documents
        hits = np.flatnonzero(hit)
        if not len(hits):
            return out
        cuts = np.flatnonzero(np.diff(hits) > 1) + 1
        doc = np.searchsorted(w.first, hits, side="right") - 1
        found: dict[int, list] = {}
        for run in np.split(hits, cuts):
            lo, hi = int(run[0]), int(run[-1]) + 2
            tokens = self.order[np.searchsorted(self.known, h[lo:hi])].tolist()
            d = int(doc[np.searchsorted(hits, lo)])
            found.setdefault(d, []).append((lo - int(w.first[d]), tokens))
        for d, runs in found.items():
            out[d] = (counts[d], *self._judge(runs))
        return out

    def _judge(self, runs: list[tuple[int, list[int]]]) -> tuple:
        base: list[tuple[int, int]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}  # template -> (text start, template start, words)
        link, ends, length = self.automaton.link, self.automaton.ends, self.automaton.length
        for lo, tokens in runs:
            steps = list(self.automaton.statistics(tokens))
            for i, (state, size) in enumerate(steps):
                s, n = state, size
                while s > 0:  # phrases that end here: as suffixes of the match
                    for t, at in ends[s].items():
                        if t < self.n_phrases and n >= len(self.split[t]) and len(self.split[t]) - 1 in at \
                                and length[link[s]] < len(self.split[t]):
                            base.append((lo + i + 1 - len(self.split[t]), t))
                    s = link[s]
                    n = length[s]
                if size >= self.cfg.min_match and (i + 1 == len(steps) or steps[i + 1][1] <= size):
                    for t, at in ends[state].items():
                        if t >= self.n_phrases:
                            matches.setdefault(t, []).extend((lo + i + 1 - size, e + 1 - size, size) for e in at)
        spans, score = [], 1.0 if base else 0.0
        for t, parts in matches.items():
            covered, start, end = self._chain(sorted(parts))
            share = covered / len(self.split[t])
            score = max(score, share)
            if share >= self.cfg.min_cover:
                spans.append((self.labels[t], start, end, share))
        base_labels = sorted({self.labels[t] for _, t in base})
        labels = sorted({*base_labels, *(s[0] for s in spans)})
        starts = [b[0] for b in base]
        return (len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(labels),
                min(1.0, score), sorted(spans, key=lambda s: (s[1], s[0])))

    def _chain(self, parts: list[tuple[int, int, int]]) -> tuple[int, int, int]:
        """(template words covered, text start, text end) of the best chain of matches in template order."""
        best = (0, 0, 0)
        held: list[tuple[int, int, int, int]] = []  # text end, template end, covered, text start
        for x, y, n in parts:
            take, start = n, x
            for ex, ey, covered, sx in held:
                if ex <= x and ey <= y and x - ex <= self.cfg.max_gap and covered + n > take:
                    take, start = covered + n, sx
            held = [e for e in held if x - e[0] <= self.cfg.max_gap]
            held.append((x + n, y + n, take, start))
            best = max(best, (take, start, x + n), key=lambda b: b[0])
        return best


def _scanner(cfg: LicenseConfig) -> Scanner:
    return per_worker(("licences", repr(cfg)), lambda: Scanner(cfg, PHRASES, NOTICES))


def scan_licenses(docs: DataFrame, cfg: LicenseConfig = LicenseConfig()) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row of ``docs``.

    Words are ASCII letters (lower-cased) and digits and all other non-ASCII
    characters. first_word and last_word are the smallest and largest start of
    a phrase, null without one; spans are (label, start word, end word, cover).
    A null text counts as empty: no words, no labels, score 0. Rows are judged
    one by one; further columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(cfg)
        for batch in batches:
            done = scanner.scan(batch.column("text"))
            columns = list(zip(*done, strict=True)) if done else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
            spans = [[{"label": s[0], "start": s[1], "end": s[2], "cover": s[3]} for s in d[7]] for d in done]
            kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], pa.array(spans, kind)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
             "labels string, score double, spans array<struct<label: string, start: long, end: long, cover: double>>")
