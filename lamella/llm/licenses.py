"""Licence scans with a generalised suffix automaton of template words.

The templates (short public notices, and every paragraph of full licence texts)
go into one automaton.  A text streams through it word by word: the matching
statistic of a place is the length of the longest template substring that ends
there.  Right-maximal matches of ``LEAST`` words or more are placed in their
templates and chained where they keep the template's order and stand close in
the text, such that the chain covers the most words; these, as a share of the
template, are its score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, in_slices, texts

#: Matching statistics below this are chance.
LEAST = 4
#: Words that may lie between two links of a chain, in the text or the template.
GAP = 40
#: Share of a template that a chain must cover for its label.
COVER = 0.6

PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: (label, text) of short notices, which stand in place of a licence.
NOTICES = (
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)
#: Full public licence texts in the folder ``licence_texts``, by label.
TEXTS = {
    "apache": ("Apache-2.0",), "boost": ("Boost-1.0",), "bsd": ("BSD-3-Clause",), "cc0": ("CC0-1.0",), "gpl": ("GPL-2", "GPL-3"), "isc": ("ISC",), "lgpl": ("LGPL-2.1",), "mit": ("MIT",),
    "mpl": ("MPL-2.0",), "unlicense": ("Unlicense",), "zlib": ("Zlib",),
}
#: Words that a paragraph needs to be a template; shorter ones are headings.
PARAGRAPH = 15


def words_of(text: str | bytes) -> list[bytes]:
    return (text.encode() if isinstance(text, str) else text).translate(ALNUM).split()


@lru_cache(maxsize=1)
def templates(notices=NOTICES, folder: str = str(Path(__file__).parent / "licence_texts")) -> tuple[tuple[str, str], ...]:
    """(label, text): the notices, then the paragraphs of the full texts that no licence of another label has."""
    whole = {(label, name): (Path(folder) / f"{name}.txt").read_text() for label, names in TEXTS.items() for name in names}
    flat = {key: b" " + b" ".join(words_of(text)) + b" " for key, text in whole.items()}
    out = list(notices)
    for (label, name), text in whole.items():
        for part in re.split(r"\n\s*\n", text):
            words = words_of(part)
            inside = b" " + b" ".join(words) + b" "
            if len(words) >= PARAGRAPH and not any(inside in other for (l, _), other in flat.items() if l != label):
                out.append((label, " ".join(part.split())))
    return tuple(dict.fromkeys(out))


class Automaton:
    """Suffix automaton of several word sequences; each state of ``least`` words or more knows where its substrings end."""

    def __init__(self, templates: list[list[bytes]], least: int = 1):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set] = [set()]
        for t, words in enumerate(templates):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w, ends)
                ends[last].add((t, i))
        for s in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.length[self.link[s]] >= least:
                ends[self.link[s]] |= ends[s]
        self.ends = [sorted(e) for e in ends]

    def _extend(self, last: int, w: bytes, ends: list[set]) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w, ends)
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        ends.append(set())
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w, ends)
        return new

    def _clone(self, p: int, q: int, w: bytes, ends: list[set]) -> int:
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        ends.append(set())
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def statistics(self, words: list[bytes], state: int = 0, length: int = 0) -> Iterator[tuple[int, int]]:
        """(state, matching statistic) after each word."""
        step, link, longest = self.next, self.link, self.length
        for w in words:
            while state and w not in step[state]:
                state = link[state]
                length = longest[state]
            if w in step[state]:
                state, length = step[state][w], length + 1
            else:
                state, length = 0, 0
            yield state, length


class Scanner:
    def __init__(self, texts_=None, phrases=tuple(PHRASES.items()), least: int = LEAST, gap: int = GAP, cover: float = COVER):
        texts_ = templates() if texts_ is None else texts_
        self.labels = [label for label, _ in texts_]
        split = [words_of(text) for _, text in texts_]
        self.sizes = [len(w) for w in split]
        self.sizes_most = max(self.sizes, default=0)
        self.automaton = Automaton(split, least)
        self.vocabulary = dict.fromkeys((w for t in split for w in t), 1)
        self.phrases = {label: words_of(p) for label, p in phrases}
        self.least, self.gap, self.cover = least, gap, cover

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(first word, length, state) of the right-maximal matches."""
        n = len(words)
        known = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int8, n)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], known, [0]))))
        out = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a < self.least:
                continue
            before = (0, 0)
            for i, now in enumerate([*self.automaton.statistics(words[a:b]), (0, 0)], a):
                if before[1] >= self.least and now[1] <= before[1]:
                    out.append((i - before[1], before[1], before[0]))
                before = now
        return out

    def chains(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, word after the last, covered share) of the chains."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for start, n, state in self.matches(words):
            for t, end in self.automaton.ends[state]:
                by_template.setdefault(t, []).append((start, end - n + 1, n))
        return [(t, *c) for t, found in by_template.items() for c in self.chained(sorted(found), self.sizes[t])]

    def chained(self, found: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, float]]:
        """Chains of most covered words from (start in text, start in template, words), sorted: (first word, word after the last, covered share).

        A match follows another if it lies after it in both, not more than
        ``gap`` words on; what the two overlap counts once.  Of the chains that
        begin with the same match the best is kept.
        """
        best: list[tuple[int, int]] = []  # covered words up to a match, and the match that its chain begins with
        near = 0
        for i, (start, at, n) in enumerate(found):
            mine = (n, i)
            while near < i and found[near][0] + self.sizes_most < start - self.gap:
                near += 1
            for j in range(near, i):
                s, a, m = found[j]
                over = max(0, s + m - start, a + m - at)
                if over < n and start + over - s - m <= self.gap and at + over - a - m <= self.gap and best[j][0] + n - over > mine[0]:
                    mine = (best[j][0] + n - over, best[j][1])
            best.append(mine)
        last: dict[int, int] = {}
        for i, (covered, root) in enumerate(best):
            if root not in last or covered > best[last[root]][0]:
                last[root] = i
        return [(found[root][0], found[i][0] + found[i][2], best[i][0] / size) for root, i in last.items()]

    def scan(self, text: bytes | None) -> dict:
        words = words_of(text or b"")
        places, labels = [], set()
        low = b" ".join(words)
        for label, p in self.phrases.items():
            if b" ".join(p) in low:
                found = [i for i, w in enumerate(words) if w == p[0] and words[i : i + len(p)] == p]
                places += found
                if found:
                    labels.add(label)
        spans = [(self.labels[t], a, b, round(share, 6)) for t, a, b, share in self.chains(words)]
        kept = sorted((s for s in spans if s[3] >= self.cover), key=lambda s: (s[1], s[0], s[2]))
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {s[0] for s in kept})),
            "score": min(1.0, max((s[3] for s in spans), default=0.0)), "spans": [{"label": s[0], "start": s[1], "end": s[2], "cover": s[3]} for s in kept],
        }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, end: long, cover: double>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPANS]


@lru_cache(maxsize=2)
def scanner(*options) -> Scanner:
    """One per worker and choice of templates."""
    return Scanner(*options)


def _scan(batches: Iterator[pa.RecordBatch], options: tuple) -> Iterator[pa.RecordBatch]:
    found = scanner(*options)
    names = [part.split()[0] for part in re.split(r", (?![^<]*>)", SCHEMA)]
    for batch in in_slices(batches):
        rows = [found.scan(t) for t in texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[n] for r in rows], k) for n, k in zip(names, _KINDS))], ["id", *names])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts_: tuple | None = None, phrases: dict = PHRASES, least: int = LEAST, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """One row per document: phrase counts, labels, score and covered template spans.

    texts_: (label, text) templates, by default ``templates()``, which the driver
    reads.  score is the largest share of a template that one chain covers,
    labelled or not.  A null or empty text has no words, empty labels and score
    0; repeated rows and null ids are scanned like any other; other columns are
    not read; an empty table gives no row.  No shuffle: each text is streamed once.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    options = (templates() if texts_ is None else texts_, tuple(phrases.items()), least, gap, cover)
    return rows.mapInArrow(partial(_scan, options=options), f"id {dict(rows.dtypes)['id']}, {SCHEMA}").withColumnRenamed("id", id_col)
