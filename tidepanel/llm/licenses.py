"""Licence scan: matching statistics of documents against suffix automata of licence texts.

A template's suffix automaton holds every run of its words.  Streaming a document through it gives
for each word the longest run ending there that occurs in the template; only stretches that share
some words in a row with the template are streamed.  Long runs are chained in template order; what
a chain covers of a template is its score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.text import ALNUM_WORD, ragged, texts, word_array

# Phrases and labels of the base search
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Grants of common public licences, by label; the words in brackets tell a licence from its kin and must all be in one run
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
    "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
    "distribute sublicense and or sell copies of the software",
    "apache": "licensed under the [apache license version 2 0] the license you may not use this file except in compliance with the license "
    "you may obtain a copy of the license at",
    "apache-2.0": "licensed under the [apache license version 2 0]",
    "mit-notice": "released under the [mit license]",
    "cc-by-nc": "licensed under [cc by nc 4 0]",
    "gpl-3.0": "this work is licensed under the [gnu general public license version 3]",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the [gnu general public license] "
    "as published by the free software foundation either version",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the [gnu lesser general public license] "
    "as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl": "this source code form is subject to the terms of the [mozilla public license v 2 0]",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
    "provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by": "this work is licensed under a [creative commons attribution 4 0 international license]",
}

#: Whole texts of public licences, by label.
WHOLE = Path(__file__).parent / "licence_texts"

#: Words of a run that enters a chain, and share of a template that a chain must cover to give its label.
MIN_RUN, MIN_COVER = 4, 0.6


@dataclass
class State:
    length: int
    link: int
    next: dict[int, int] = field(default_factory=dict)
    ends: list[tuple[int, int]] = field(default_factory=list)  # (template, index of last word)


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.states = [State(0, -1)]
        self.sequences = sequences
        for words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for t, words in enumerate(sequences):  # a state's ends: all places of its runs
            at = 0
            for i, w in enumerate(words):
                at = self.states[at].next[w]
                up = at
                while up > 0:
                    self.states[up].ends.append((t, i))
                    up = self.states[up].link

    def _extend(self, last: int, w: int) -> int:
        s = self.states
        if w in s[last].next:
            q = s[last].next[w]
            return q if s[q].length == s[last].length + 1 else self._split(last, q, w)
        new = len(s)
        s.append(State(s[last].length + 1, 0))
        p = last
        while p >= 0 and w not in s[p].next:
            s[p].next[w] = new
            p = s[p].link
        if p >= 0:
            q = s[p].next[w]
            s[new].link = q if s[q].length == s[p].length + 1 else self._split(p, q, w)
        return new

    def _split(self, p: int, q: int, w: int) -> int:
        """A state of its own for the runs of q that are no longer than p's runs and w."""
        s = self.states
        own = len(s)
        s.append(State(s[p].length + 1, s[q].link, dict(s[q].next)))
        s[q].link = own
        while p >= 0 and s[p].next.get(w) == q:
            s[p].next[w] = own
            p = s[p].link
        return own

    def statistics(self, words: list[int]) -> list[tuple[int, int]]:
        """For each word, state and length of the longest run ending there that some sequence holds."""
        s, at, n, out = self.states, 0, 0, []
        for w in words:
            while at and w not in s[at].next:
                at = s[at].link
                n = s[at].length
            if w in s[at].next:
                at, n = s[at].next[w], n + 1
            out.append((at, n))
        return out


def whole_texts() -> dict[str, str]:
    """Words of each whole licence text, by label."""
    return {f.stem: " ".join(re.findall("[a-z0-9\x80-\U0010ffff]+", f.read_text().lower())) for f in sorted(WHOLE.glob("*.txt"))}


def bracketed(template: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words, and first and next-to-last index of each stretch in brackets."""
    words, groups = [], []
    for part in re.split(r"(\[.*?\])", template):
        own = part.strip("[]").split()
        if part.startswith("["):
            groups.append((len(words), len(words) + len(own)))
        words += own
    return words, groups


class Scanner:
    """Finds phrases, grants (``templates``) and whole licence texts (``whole``)."""

    def __init__(
        self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, min_run: int = MIN_RUN, min_cover: float = MIN_COVER,
        whole: dict[str, str] | None = None,
    ):
        whole = whole_texts() if whole is None else whole
        self.min_run, self.min_cover = min_run, min_cover
        self.phrase_labels, self.labels, self.n_grants = [*phrases.values()], [*templates, *whole], len(templates)
        split = [bracketed(t) for t in [*templates.values(), *whole.values()]]
        self.groups = [g for _, g in split]
        self.vocabulary = sorted({w for t, _ in split for w in t} | {w for p in phrases for w in p.split()})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.sequences = [[number[w] for w in t] for t, _ in split]
        self.phrases = [[number[w] for w in p.split()] for p in phrases]
        self.automata = [Automaton([t]) for t in self.sequences]
        self.value_set = pa.array([w.encode() for w in self.vocabulary], pa.large_binary())
        # a run has min_run words, so its first ``gram`` ones, packed in one number, are among these
        self.base = len(self.vocabulary) + 1
        self.gram = max(k for k in range(1, min_run + 1) if k == 1 or self.base**k < 2**63)
        self.templates_of: dict[int, list[int]] = {}
        for t, words in enumerate(self.sequences):
            for g in set(self.packed(np.array(words, np.int64)).tolist()):
                self.templates_of.setdefault(g, []).append(t)
        self.grams = np.array(sorted(self.templates_of), np.int64)

    def packed(self, ids: np.ndarray) -> np.ndarray:
        n = max(0, len(ids) - self.gram + 1)
        out = np.zeros(n, np.int64)
        for k in range(self.gram):
            out = out * self.base + ids[k : k + n]
        return out

    def phrase_places(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """First word and number of every phrase in a row of word ids."""
        out = []
        for t, words in enumerate(self.phrases):
            at = np.flatnonzero(ids[: max(0, len(ids) - len(words) + 1)] == words[0])
            for k, w in enumerate(words):
                at = at[ids[at + k] == w]
            out += [(i, t) for i in at.tolist()]
        return out

    def scan(self, t: int, words: list[int], at: int, runs: dict) -> None:
        """Long maximal runs of template ``t`` in one stretch of known words that begins at word ``at``."""
        stats = self.automata[t].statistics(words)
        for i, (state, n) in enumerate(stats):
            if n >= self.min_run and (i + 1 == len(stats) or stats[i + 1][1] <= n):
                for _, end in self.automata[t].states[state].ends:
                    runs.setdefault(t, []).append((at + i - n + 1, end - n + 1, n))

    def chains(self, t: int, runs: list[tuple[int, int, int]]) -> list[tuple[float, int, int, bool]]:
        """Disjoint chains of runs that go on in both document and template, best first: share covered, first
        and last word, and whether the words in brackets are there.  The best one, and all that reach min_cover.

        A run follows another if it starts later in the template and within one template's length in the document.
        """
        size, out, runs = len(self.sequences[t]), [], sorted(set(runs))
        while runs:
            best: list[tuple[int, int, int]] = []  # covered words, first word, run before
            open_from = 0
            for i, (d, p, n) in enumerate(runs):
                cover, first, before = n, d, -1
                while runs[open_from][0] + 2 * size < d:
                    open_from += 1
                for j in range(open_from, i):
                    dj, pj, nj = runs[j]
                    if pj < p and dj < d and d - (dj + nj) <= size:
                        c = best[j][0] + min(n, p + n - max(p, pj + nj)) if p + n > pj + nj else 0
                        if c > cover:
                            cover, first, before = c, best[j][1], j
                best.append((cover, first, before))
            found = []
            for i in sorted(range(len(runs)), key=lambda k: (-best[k][0], runs[k][0])):
                cover, first, _ = best[i]
                last = runs[i][0] + runs[i][2] - 1
                if (out or found) and cover < self.min_cover * size:
                    break
                if any(first <= b and a <= last for a, b in found):
                    continue
                found.append((first, last))
                own = []
                while i >= 0:
                    own.append(runs[i])
                    i = best[i][2]
                out.append((cover / size, first, last, all(any(p <= a and b <= p + n for _, p, n in own) for a, b in self.groups[t])))
            if not found or out[-1][0] < self.min_cover:
                break
            runs = [(d, p, n) for d, p, n in runs if not any(d <= b and a <= d + n - 1 for a, b in found)]
        return out


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,first_word:long,last_word:long,cover:double>>"
)


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Per document: words, places of the base phrases, labels, the best cover of a template and its spans.

    Null and empty texts have no words and score 0.  A phrase found gives score 1 and its label.
    ``spans`` has each template's best chain and every other one that reaches the threshold.
    """
    sent = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())

    def run(batches):
        scanner = sent.value
        for t in texts(batches):
            low = t.lowered()
            starts, ends = low.words(ALNUM_WORD)
            first = np.searchsorted(starts, low.offsets)  # index of each document's first word
            ids = pc.fill_null(pc.index_in(word_array(low.data, starts, ends), value_set=scanner.value_set), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            places = [[] for _ in range(len(t))]
            runs = [{} for _ in range(len(t))]
            doc_of = lambda i: np.searchsorted(first, i, side="right") - 1
            for i, p in scanner.phrase_places(ids):
                d = int(doc_of(i))
                if i + len(scanner.phrases[p]) <= first[d + 1]:
                    places[d].append((i - int(first[d]), p))
            known = ids >= 0
            edge = np.zeros(len(ids) + 1, bool)
            edge[first] = True
            prev = np.concatenate([[False], known[:-1]]) if len(ids) else known
            begin = np.flatnonzero(known & (~prev | edge[:-1]))
            after = np.concatenate([known[1:], [False]]) if len(ids) else known
            stop = np.flatnonzero(known & (~after | edge[1:])) + 1
            long = stop - begin >= scanner.min_run
            begin, stop = begin[long], stop[long]
            own = ids[ragged(begin, stop - begin)]  # the long stretches one after another
            grams = scanner.packed(own)
            hits = np.flatnonzero(np.isin(grams, scanner.grams))
            upto = np.cumsum(stop - begin)
            stretch = np.searchsorted(upto, hits, side="right")
            hits, stretch = (x[hits + scanner.gram <= upto[stretch]] for x in (hits, stretch))
            wanted: dict[int, set[int]] = {}
            for k, g in zip(stretch.tolist(), grams[hits].tolist()):
                wanted.setdefault(k, set()).update(scanner.templates_of[g])
            for k, some in wanted.items():
                b, e = int(begin[k]), int(stop[k])
                d = int(doc_of(b))
                words = ids[b:e].tolist()
                for x in sorted(some):
                    scanner.scan(x, words, b - int(first[d]), runs[d])
            yield pa.RecordBatch.from_pylist(
                [_row(scanner, i, int(n), p, r) for i, n, p, r in zip(t.rows.column("doc_id").to_pylist(), np.diff(first), places, runs)], ARROW
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("cover", pa.float64())]))),
    ]
)


def _row(scanner: Scanner, doc_id, n_words: int, places: list, runs: dict) -> dict:
    at = [p for p, _ in places]
    base = {scanner.phrase_labels[t] for _, t in places}
    spans, found, texts_found = [], set(base), []
    for t in sorted(runs):
        for cover, first, last, told in scanner.chains(t, runs[t]):
            spans.append({"label": scanner.labels[t], "first_word": first, "last_word": last, "cover": cover})
            if cover >= scanner.min_cover and t >= scanner.n_grants:
                texts_found.append((cover * len(scanner.sequences[t]), cover, first, last, scanner.labels[t]))
            elif cover >= scanner.min_cover and told:
                found.add(scanner.labels[t])
    # licences of one family share most of their text: a place belongs to the text that it covers with most words
    taken = []
    for _, _, first, last, label in sorted(texts_found, reverse=True):
        if not any(first <= b and a <= last for a, b in taken):
            taken.append((first, last))
            found.add(label)
    return {
        "doc_id": doc_id, "n_words": n_words, "n_base": len(at), "first_word": min(at, default=None), "last_word": max(at, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(found)),
        "score": 1.0 if base else max([0.0, *(s["cover"] for s in spans)]), "spans": spans,
    }
