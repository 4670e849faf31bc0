"""Operator 7, licence scans: generalised suffix automaton of licence tokens.

All licence templates go into one generalised suffix automaton over words.  A
text is streamed through it once; after each word the automaton knows the longest
suffix read so far that occurs in some template (matching statistics) and where it
ends in each.  Maximal matches are chained per template (increasing in text and
template, bounded gaps) and a template counts as present where its chain covers
``min_cover`` of its words.  Base phrases are templates too: a place of a phrase is
a position whose match state descends from the phrase's state by suffix links.

Edge cases: null text is an empty text (no words, empty labels, null places);
texts of any length are streamed with state bounded by the templates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coheral.llm.common import modest_batches

# Base phrases with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Wording of common licence notices, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction including "
            "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
            "copies of the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license "
               "is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)

# ASCII characters outside words become spaces, A-Z become a-z; bytes from 0x80 on belong to words.
_TO_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class SuffixAutomaton:
    """Generalised suffix automaton; states know one end position per template."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for t, seq in enumerate(sequences):
            last = 0
            for pos, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].setdefault(t, pos)
        for s in sorted(range(1, len(self.next)), key=lambda x: -self.length[x]):
            for t, pos in self.ends[s].items():
                old = self.ends[self.link[s]]
                old[t] = min(pos, old.get(t, pos))

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur


class LicenceIndex:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, min_match: int = 3, min_cover: float = 0.75,
                 max_gap: int = 6):
        self.labels = [label for label, _ in templates]
        self.phrase_labels = [label for _, label in phrases]
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap
        texts = [words_of(t) for _, t in templates] + [words_of(p) for p, _ in phrases]
        self.vocab = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        seqs = [[self.vocab[w] for w in t] for t in texts]
        self.sizes = [len(s) for s in seqs[:len(templates)]]
        self.sam = SuffixAutomaton(seqs)
        # per state: the phrases that are a suffix of its longest string, with their lengths
        found: list[list[tuple[int, int]]] = [[] for _ in self.sam.next]
        for k, seq in enumerate(seqs[len(templates):]):
            s = 0
            for c in seq:
                s = self.sam.next[s][c]
            found[s].append((k, len(seq)))
        for s in sorted(range(1, len(found)), key=lambda x: self.sam.length[x]):
            found[s] = found[s] + found[self.sam.link[s]]
        self.phrases_at = found

    def scan(self, text: str) -> tuple[int, list[tuple[int, str]], list[tuple[str, int, int, float]]]:
        """(number of words, phrase places (start, label), template spans (label, start, end, cover))."""
        words = words_of(text)
        ids = map(self.vocab.get, words)
        nxt, link, length = self.sam.next, self.sam.link, self.sam.length
        state, size, places, runs = 0, 0, [], []
        for i, c in enumerate(ids):
            if c is None:
                if size >= self.min_match:
                    runs.append((i - size, size, state))
                state = size = 0
                continue
            to = nxt[state].get(c)
            if to is None:
                if size >= self.min_match:
                    runs.append((i - size, size, state))
                while state and to is None:
                    state = link[state]
                    size = length[state]
                    to = nxt[state].get(c)
                if to is None:
                    size = 0
                    continue
            state, size = to, size + 1
            for k, n in self.phrases_at[state]:
                if size >= n:
                    places.append((i - n + 1, self.phrase_labels[k]))
        if size >= self.min_match:
            runs.append((len(words) - size, size, state))
        return len(words), places, self._chains(runs)

    def _chains(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Greedy chains of maximal matches per template, in text order."""
        open_: dict[int, list[int]] = {}  # template -> [text start, text end, template end, covered]
        done = []

        def close(t: int, c: list[int]) -> None:
            cover = c[3] / self.sizes[t]
            if cover >= self.min_cover:
                done.append((self.labels[t], c[0], c[1], min(1.0, cover)))

        for start, size, state in runs:
            for t, last in self.sam.ends[state].items():
                if t >= len(self.sizes):
                    continue
                first, c = last - size + 1, open_.get(t)
                if c and start - c[1] <= self.max_gap and 0 <= first + (over := max(0, c[1] - start)) - c[2] <= self.max_gap:
                    c[1], c[2], c[3] = start + size, last + 1, c[3] + size - over
                else:
                    if c:
                        close(t, c)
                    open_[t] = [start, start + size, last + 1, size]
        for t, c in open_.items():
            close(t, c)
        return sorted(done)


SCAN_TYPE = ("n_words bigint, places array<struct<start:bigint,label:string>>, "
             "spans array<struct<label:string,start:bigint,end:bigint,cover:double>>")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", index: LicenceIndex | None = None) -> DataFrame:
    """One row per input row: key, n_words, phrase places, covered template spans (word positions)."""
    modest_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(index or LicenceIndex())

    @F.pandas_udf(SCAN_TYPE)
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.scan(t if isinstance(t, str) else "") for t in texts]
        return pd.DataFrame({"n_words": [f[0] for f in found],
                             "places": [[{"start": a, "label": b} for a, b in f[1]] for f in found],
                             "spans": [[dict(zip(("label", "start", "end", "cover"), s)) for s in f[2]] for f in found]})

    return (df.select(F.col(key).alias("doc_id"), run(F.col(text)).alias("__scan"))
            .select("doc_id", "__scan.*"))
