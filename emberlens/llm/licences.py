"""Licence scans: matching statistics of word streams against a generalised suffix automaton of licence notices, chained into template spans."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases that name a licence wherever their words stand consecutively, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public notices and the labels they stand for. A label may have several.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("mit", "under the MIT License"),
    (
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("bsd", "under the BSD License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl-2.0", "under the GNU General Public License, version 2"),
    ("gpl-3.0", "under the GNU General Public License, version 3"),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    ("lgpl", "under the GNU Lesser General Public License"),
    ("agpl", "under the GNU Affero General Public License"),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    ),
    ("mpl-2.0", "under the Mozilla Public License, version 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("boost-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("cc0-1.0", "under the Creative Commons Zero 1.0 Universal"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "licensed under CC BY-ND 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("proprietary", "The information contained herein is confidential and proprietary and may not be reproduced or disclosed without prior written permission"),
)

#: Words are runs of bytes other than these: ASCII letters and digits, and all bytes above.
_SPACES = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90))
_WORDS = bytes.maketrans(bytes(range(65, 91)) + _SPACES, bytes(range(97, 123)) + b" " * len(_SPACES))
#: Texts are cut into words in slices of about so many bytes.
SLICE = 1 << 20


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """A text's words, slice by slice; no word is cut."""
    at = 0
    while at < len(text):
        part = text[at : at + SLICE].translate(_WORDS)
        end = at + len(part)
        while end < len(text) and not part.endswith(b" "):  # to the end of the last word
            more = text[end : end + 4096].translate(_WORDS)
            cut = more.find(b" ")
            more = more if cut < 0 else more[: cut + 1]
            part, end = part + more, end + len(more)
        yield part.split()
        at = end


@dataclass
class Automaton:
    """Generalised suffix automaton of word sequences: each state is a set of substrings that end at the same places."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state of the strings of q that are no longer than p's by more than c; q keeps the longer ones."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def extend(self, last: int, c: int) -> int:
        """The state of the sequence so far and c."""
        q = self.next[last].get(c)
        if q is not None:  # another sequence has it
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new

    def step(self, state: int, matched: int, c: int) -> tuple[int, int]:
        """The longest suffix of the match and c that occurs, as its state and length."""
        while state and c not in self.next[state]:
            state = self.link[state]
            matched = self.length[state]
        to = self.next[state].get(c)
        return (0, 0) if to is None else (to, matched + 1)


@dataclass
class Notices:
    """What tasks look up: the automaton, the words' numbers, where each state's strings end in templates, and which phrases end there."""

    automaton: Automaton
    numbers: dict[bytes, int]
    pairs: np.ndarray  # by number * words + number: whether the two words stand in this order somewhere
    ends: list[list[tuple[int, int]]]  # by state: template and end
    phrases: list[list[tuple[int, int]]]  # by state: length and phrase
    lengths: list[int]  # by template
    labels: list[str]
    phrase_labels: list[str]


def _ids(text: str, numbers: dict[bytes, int]) -> list[int]:
    return [numbers.setdefault(w, len(numbers)) for part in words_of(text.encode()) for w in part]


def build(templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: Mapping[str, str] = PHRASES) -> Notices:
    """The automaton of all templates and phrases. Ones without a word match nothing."""
    numbers: dict[bytes, int] = {}
    rows = [x for x in ((label, _ids(text, numbers)) for label, text in templates) if x[1]]
    names = [x for x in ((label, _ids(text, numbers)) for text, label in phrases.items()) if x[1]]
    a = Automaton()
    paths = []
    for _, ids in [*rows, *names]:
        last, path = 0, []
        for c in ids:
            last = a.extend(last, c)
            path.append(last)
        paths.append(ids)
    at = lambda ids: _walk(a, ids)  # noqa: E731  a later split may have moved a prefix to another state
    ends: list[set[tuple[int, int]]] = [set() for _ in a.next]
    own: list[list[tuple[int, int]]] = [[] for _ in a.next]
    for t, (_, ids) in enumerate(rows):
        for e, s in enumerate(at(ids), 1):
            ends[s].add((t, e))
    for p, (_, ids) in enumerate(names):
        own[at(ids)[-1]].append((len(ids), p))
    order = sorted(range(1, len(a.next)), key=lambda s: a.length[s])
    for s in reversed(order):
        ends[a.link[s]] |= ends[s]
    found = own
    for s in order:
        found[s] = sorted(own[s] + found[a.link[s]])
    pairs = np.zeros(len(numbers) ** 2, bool)
    for ids in paths:
        for x, y in zip(ids, ids[1:]):
            pairs[x * len(numbers) + y] = True
    return Notices(a, numbers, pairs, [sorted(x) for x in ends], found, [len(ids) for _, ids in rows], [label for label, _ in rows], [label for label, _ in names])


def _walk(a: Automaton, ids: list[int]) -> list[int]:
    state, out = 0, []
    for c in ids:
        state = a.next[state][c]
        out.append(state)
    return out


def matches(ids: np.ndarray, n: Notices, min_match: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Phrases as (start, phrase), and the matches of min_match words and more that no word extends, as (end, length, state). ids are the words' numbers, -1 for others."""
    found, long = [], []
    if len(n.phrases) > 1 and any(length == 1 for x in n.phrases for length, _ in x):
        edges = ids >= 0  # single words count: any known word starts a stretch
        starts, stops = _stretches(edges)
    else:
        known = (ids[:-1] >= 0) & (ids[1:] >= 0)
        known &= n.pairs[np.where(known, ids[:-1] * len(n.numbers) + ids[1:], 0)]
        starts, stops = _stretches(known)
        stops = stops + 1
    a = n.automaton
    for lo, hi in zip(starts.tolist(), stops.tolist()):
        state = matched = 0
        for i, c in enumerate(ids[lo:hi].tolist(), lo):
            to, longer = a.step(state, matched, c)
            if longer <= matched and matched >= min_match:
                long.append((i, matched, state))
            state, matched = to, longer
            for length, p in n.phrases[state]:
                if length <= matched:
                    found.append((i + 1 - length, p))
        if matched >= min_match:
            long.append((hi, matched, state))
    return found, long


def _stretches(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    change = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def chains(long: list[tuple[int, int, int]], n: Notices, max_gap: int) -> list[tuple[int, int, int, int]]:
    """Template, start, end and covered template words of each chain: matches in the order of text and template, at most max_gap words apart in both."""
    by: dict[int, list[tuple[int, int, int]]] = {}
    for end, length, state in long:
        for t, e in n.ends[state]:
            by.setdefault(t, []).append((end, e, length))
    out = []
    for t, anchors in by.items():
        anchors.sort()
        ends = [x[0] for x in anchors]
        best, before = [], []
        for j, (end, e, length) in enumerate(anchors):
            most, of = length, -1
            for i in range(bisect_left(ends, end - length - max_gap), j):
                d, f, _ = anchors[i]
                gain = min(length, end - d, e - f)
                if gain > 0 and e - length - f <= max_gap and best[i] + gain > most:
                    most, of = best[i] + gain, i
            best.append(most)
            before.append(of)
        used = [False] * len(anchors)
        for j in sorted(range(len(anchors)), key=lambda j: (-best[j], j)):
            at, free = j, True
            first = j
            while at >= 0 and free:
                free, used[at], first, at = not used[at], True, at, before[at]
            if free:
                out.append((t, anchors[first][0] - anchors[first][2], anchors[j][0], best[j]))
    return out


def spans(found: list[tuple[int, int, int, int]], n: Notices, min_share: float, long_share: float, long_words: int) -> tuple[list[tuple[str, int, int, int, float]], float]:
    """The chains that cover enough of their template, the ones of more words first and none that overlaps one before it; and the highest share of all chains."""
    rows = sorted((-covered, -covered / n.lengths[t], start, n.labels[t], end) for t, start, end, covered in found)
    out, taken = [], []
    for less, share, start, label, end in rows:
        of = -less / -share
        if -share < (long_share if of >= long_words else min_share):
            continue
        k = bisect_left(taken, (start, end))
        if (k < len(taken) and taken[k][0] < end) or (k and taken[k - 1][1] > start):
            continue
        insort(taken, (start, end))
        out.append((label, start, end, -less, -share))
    return sorted(out, key=lambda x: (x[1], x[0])), max((-r[1] for r in rows), default=0.0)


SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("covered", T.LongType()), T.StructField("share", T.DoubleType())])


def scan_licences(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_match: int = 3,
    max_gap: int = 6,
    min_share: float = 0.9,
    long_share: float = 0.6,
    long_words: int = 20,
) -> DataFrame:
    """The id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of each row.

    A text's words are streamed through the automaton, which gives for each word the longest match that ends there. Phrases that end
    there count as base places. Matches of min_match words and more that can't be longer are chained per template, and a chain that covers min_share of its
    template's words (long_share of templates of long_words and more) is a span; where spans overlap, the one of more words stays. Labels are those of
    phrases and spans, distinct, sorted and joined by commas. The score is 1 with a phrase, else the highest share of a template that one chain covers.

    Each row is taken by itself, so repeated rows and ids give rows of their own and a null id stays null. A null text is empty: no words, no labels
    (an empty string), score 0. Only the id and the text are read. The automaton grows with the templates and not with the input.
    """
    notices = build(tuple(templates), dict(phrases))
    schema = T.StructType(
        [
            docs.select(F.col(id_col)).schema[0],
            *(T.StructField(x, T.LongType()) for x in ("n_words", "n_base", "first_word", "last_word")),
            *(T.StructField(x, T.StringType()) for x in ("base_labels", "labels")),
            T.StructField("score", T.DoubleType()),
            T.StructField("spans", T.ArrayType(SPAN)),
        ]
    )
    shared = docs.sparkSession.sparkContext.broadcast(notices)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = shared.value
        number = n.numbers.get
        kinds = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
        span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))
        for b in batches:
            rows, all_spans = [], []
            for text in b.column(1).cast(pa.binary()):
                ids = [np.fromiter((number(w, -1) for w in part), np.int64, len(part)) for part in words_of(text.as_py() or b"")]
                ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
                places, long = matches(ids, n, min_match) if len(ids) else ([], [])
                kept, share = spans(chains(long, n, max_gap), n, min_share, long_share, long_words) if long else ([], 0.0)
                base = {n.phrase_labels[p] for _, p in places}
                starts = [s for s, _ in places]
                labels = ",".join(sorted(base | {x[0] for x in kept}))
                rows.append((len(ids), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), labels, 1.0 if base else share))
                all_spans.append([dict(zip(("label", "start", "end", "covered", "share"), x)) for x in kept])
            columns = [pa.array(x, k.type) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k.type) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(all_spans, span)], names=[id_col, *kinds.names, "spans"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(scan, schema)
