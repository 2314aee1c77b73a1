"""License scans: winnowed fingerprints pick templates, banded alignment measures them.

Templates (a short list, sent to every task) are cut into word k-grams;
winnowing keeps the smallest k-gram hash of every ``window`` consecutive ones,
so any run of ``k + window - 1`` words that a text shares with a template has a
fingerprint in common with it. An inverted index of fingerprints gives the
candidate templates of a text and the diagonals on which they lie; around
each, template and text are aligned word by word in a band, and the share of
the template's words that match, and where, is reported.

A short notice may have no such run: any match of it holds one of its anchors,
its rarest words, one more than a match may lack, so each is a place to align at.
What a match covers is taken off the text before the next one is looked for.

One pass over the texts, no shuffle; the work on a text is linear in it but
for the alignments, which are as long as a template.

Defined results: null and empty texts have no matches; a template is reported
as often as it occurs, in texts of any length; of overlapping matches the one with the higher
coverage stays, then the longer one, then the one listed first; repeated rows
have equal results; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import islice, takewhile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a k-gram, k-grams of a window, places that an alignment may drift.
GRAM, WINDOW, BAND = 3, 3, 8
#: Templates of so many words or fewer are found by single rare words, too.
SHORT = 20

#: Notices and opening passages of common licenses.
TEMPLATES: Mapping[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation"
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    ),
}

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_BEYOND = re.compile(r"[^\x00-\x7f]")


def _mix(values: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit hash of whole numbers."""
    x = values.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def winnow(ids: np.ndarray, base: int, gram: int = GRAM, window: int = WINDOW) -> list[tuple[int, int]]:
    """(hash, place) of the fingerprints of word ids; id 0 stands for words that no template has."""
    n = len(ids) - gram + 1
    if n < window:
        return []
    value = np.zeros(n, dtype=np.int64)
    for i in range(gram):
        value = value * base + ids[i : i + n]
    hashes = _mix(value)
    known = np.convolve(ids != 0, np.ones(gram + window - 1, dtype=np.int64), "valid") == gram + window - 1
    starts = np.flatnonzero(known)
    if not len(starts):
        return []
    picks = starts + hashes[starts[:, None] + np.arange(window)].argmin(axis=1)
    return [(int(hashes[i]), int(i)) for i in np.unique(picks)]


class Index:
    """The templates' words, an inverted index of their fingerprints, and the anchors of short ones.

    ``coverage`` is the least share of a short template's words that its anchors can find.
    """

    def __init__(self, templates: Mapping[str, str], coverage: float = 0.8):
        self.names = list(templates)
        split = [_WORD.findall(t.lower()) for t in templates.values()]
        self.ids = {w: i for i, w in enumerate(dict.fromkeys(w for words in split for w in words), 1)}
        self.base = len(self.ids) + 1
        self.words = [np.array([self.ids[w] for w in words], dtype=np.int64) for words in split]
        self.where: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            for value, at in winnow(words, self.base):
                self.where.setdefault(value, []).append((t, at))
        # A match lacks so few words of a template that one of its anchors is among the others.
        times = Counter(w for words in self.words for w in set(words.tolist()))
        long = {i: len(w) for w, i in self.ids.items()}
        self.anchors: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            if len(words) <= SHORT:
                lacking = len(words) - math.ceil(coverage * len(words) - 1e-9)
                rare = sorted(range(len(words)), key=lambda i: (times[int(words[i])], -long[int(words[i])], i))
                for i in rare[: lacking + 1]:
                    self.anchors.setdefault(int(words[i]), []).append((t, i))
        self.anchor = np.zeros(self.base, dtype=bool)
        self.anchor[list(self.anchors)] = True


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matches, first, end): the best local alignment in the band around ``text[i + shift]``.

    A match counts 2, any other step -1. ``first`` and ``end`` bound the
    matched words of the text.
    """
    wide = 2 * band + 1
    zero = (0, 0, -1, -1)  # score, matches, first, end
    row, best = [zero] * wide, zero
    for i in range(len(template)):
        new = []
        for d in range(wide):
            j = i + shift + d - band
            options = [zero]
            if 0 <= j < len(text):
                s, m, first, end = row[d]
                if template[i] == text[j]:
                    options.append((s + 2, m + 1, j if first < 0 else first, j + 1))
                elif s > 1:
                    options.append((s - 1, m, first, end))
            if d + 1 < wide and row[d + 1][0] > 1:
                options.append((row[d + 1][0] - 1, *row[d + 1][1:]))
            if d and new[d - 1][0] > 1:
                options.append((new[d - 1][0] - 1, *new[d - 1][1:]))
            new.append(max(options))
        row = new
        best = max(best, max(row))
    return best[1:]


def matches_of(t: int, seeds: list[tuple[int, int]], ids: np.ndarray, index: Index, coverage: float) -> list[tuple[int, int, int]]:
    """(matches, first, end) of all occurrences of template ``t`` around its seeds (place in the text, place in the template)."""
    template = index.words[t]
    size, own = len(template), np.zeros(index.base, dtype=bool)
    own[template] = True
    # Words of the template up to each place of the text: too few in the band's reach, and nothing is aligned.
    upto = np.concatenate([[0], np.cumsum(own[ids])])
    left, past, missed = ids.copy(), 0, set()
    found = []

    def best(shift: int) -> tuple[int, int, int]:
        low, high = max(0, shift - BAND), max(0, min(len(ids), shift + size + BAND))
        if upto[high] - upto[low] < coverage * size:
            return 0, -1, -1
        m, first, end = align(template, left[low:high], shift - low)
        return m, first + low, end + low

    for n, (at, i) in enumerate(seeds):
        # The match found may be another one in the band, so a seed is tried until one covers it, or none is left.
        while left[at] and at - i not in missed:
            m, first, end = best(at - i)
            if m < coverage * size:
                missed.add(at - i)
                break
            # Other diagonals of the same words may show more of the template.
            near = {at - i} | {b - j for b, j in takewhile(lambda seed: seed[0] < end, islice(seeds, n + 1, None))}
            m, first, end = max((best(shift) for shift in sorted(near)), key=lambda f: (f[0], f[1] - f[2]))
            found.append((m, first, end))
            left[first:end] = 0
    return found


def find(text: str | None, index: Index, coverage: float = 0.8) -> list[tuple[str, int, int, float]]:
    """(template, start, end, coverage) of all matches, by start; places in code points."""
    if not text:
        return []
    # Lower-casing may change lengths beyond ASCII; such characters are no words here.
    low = (text if text.isascii() else _BEYOND.sub(" ", text)).lower()
    words = _WORD.findall(low)
    get = index.ids.get
    ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
    seeds: dict[int, set[tuple[int, int]]] = {}
    for value, at in winnow(ids, index.base):
        for t, i in index.where.get(value, ()):
            seeds.setdefault(t, set()).add((at, i))
    for at in np.flatnonzero(index.anchor[ids]).tolist():
        for t, i in index.anchors[int(ids[at])]:
            seeds.setdefault(t, set()).add((at, i))
    found = []
    for t, own in seeds.items():
        size = len(index.words[t])
        found += [(-m / size, -m, t, first, end) for m, first, end in matches_of(t, sorted(own), ids, index, coverage)]
    if not found:
        return []
    places = [m.span() for m in _WORD.finditer(low)]
    taken: list[tuple[int, int, int, float]] = []
    for share, _, t, first, end in sorted(found):
        start, end = places[first][0], places[end - 1][1]
        at = bisect_left(taken, (start,))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
            taken.insert(at, (start, end, t, -share))
    return [(index.names[t], s, e, round(share, 4)) for s, e, t, share in taken]


MATCHES = "array<struct<license:string,start:int,end:int,coverage:double>>"


def scan_licenses(docs: DataFrame, text_col: str = "text", templates: Mapping[str, str] = TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """``docs`` with ``licenses``: all template matches of each text, by start."""
    index = Index(templates, coverage)

    @F.pandas_udf(MATCHES)
    def matches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("license", "start", "end", "coverage")
        for texts in parts:
            yield pd.Series([[dict(zip(names, m, strict=True)) for m in find(t, index, coverage)] for t in texts], dtype=object)

    return docs.withColumn("licenses", matches(F.col(text_col)))
