"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

The templates' k-word strings are hashed and winnowed: of each run of neighbouring
hashes the smallest is kept. Any match of k + w - 1 words or more shares a kept hash.
Templates whose matches can have fewer words in a row are indexed by strings as
short as that run, and every such string of a text is looked up. The
inverted index, whose size is that of the templates, gives for each such hash of a
document the templates and the diagonals at which they may lie. All candidates of a
template are aligned with it side by side in a band around their diagonals, which
reports the share of the template's words that are matched in order and the span in
the text; of spans that overlap the best stays.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import load
from .textkit import U64, hash_ranges, mix64, pieces, stream64, utf8_of

GRAM = 3
WINDOW = 2
#: An alignment's diagonals are at most so far from its candidate's, and at most a quarter of the template's words.
BAND = 8
COVERAGE = 0.8
#: Candidates that are aligned together.
ALIGNED = 4096

#: Notices and grants of common licenses, as their texts ask to be stated.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}

_FOLD = np.full(256, 0, dtype=np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _FOLD[_b] = _b
for _b in range(0x41, 0x5B):
    _FOLD[_b] = _b + 32


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words (runs of letters and digits, A-Z folded), and the word index at which each row begins."""
    folded = _FOLD[data]
    solid = folded != 0
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    start, stop = solid.copy(), solid.copy()
    if len(data):
        start[1:] &= ~solid[:-1] | first[1:-1]
        stop[:-1] &= ~solid[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return hash_ranges(folded, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def all_grams(hashes: np.ndarray, size: int = GRAM) -> np.ndarray:
    """The hashes of the strings of ``size`` words at every word, those that cross rows too."""
    n = max(0, len(hashes) - size + 1)
    factor = stream64(71, size) | U64(1)
    sums = np.zeros(n, dtype=U64)
    with np.errstate(over="ignore"):
        for j in range(size):
            sums += hashes[j : j + n] * factor[j]
    return mix64(sums)


def winnow(grams: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Indexes of the strings within rows that are the smallest of some WINDOW neighbours, the last of equals.

    A row with fewer strings than that keeps its smallest.
    """
    room = np.maximum(np.diff(rows) - GRAM + 1, 0)
    full = np.flatnonzero(room)
    if not len(full):
        return np.zeros(0, np.int64)
    width = np.minimum(room[full], WINDOW)
    windows = room[full] - width + 1
    begin = np.repeat(rows[full] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    size = np.repeat(width, windows)
    best = begin.copy()
    for j in range(1, WINDOW):
        other = begin + np.minimum(j, size - 1)
        best = np.where(grams[other] <= grams[best], other, best)
    return np.unique(best)


def align(template: np.ndarray, text: np.ndarray, diagonals: np.ndarray, lows: np.ndarray, highs: np.ndarray, band: int = BAND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each candidate (matched words, first, end) of the best alignment of the template around text = template + diagonal.

    The longest common subsequence of words whose diagonal is within the band and
    whose place in ``text`` is from the candidate's low to below its high; of those of
    equal length the shortest span, then the first. All candidates go through the
    template's words together; a cell holds the matched words and, beside them, the
    first of their places, the later one of two being the better.
    """
    wide = len(template) + 2 * band + 2
    one = np.int64(1) << 32
    start = diagonals.astype(np.int64) - band
    shift = np.arange(2 * band + 1)
    state = np.zeros((len(diagonals), 2 * band + 1), dtype=np.int64)
    best = np.zeros(len(diagonals), dtype=np.int64)
    for i, word in enumerate(template):
        before = state
        # one diagonal further is the same place of the text after one word of the template less
        state = np.concatenate([before[:, 1:], np.zeros((len(before), 1), np.int64)], axis=1)
        at = start[:, None] + i + shift
        inside = (at >= lows[:, None]) & (at < highs[:, None])
        same = inside & (text[np.clip(at, 0, len(text) - 1)] == word)
        fresh = one + i + shift
        longer = np.where(before >= one, before + one, fresh[None, :])
        state = np.maximum.accumulate(np.maximum(state, np.where(same, longer, 0)), axis=1)
        span = i + shift + 1 - (longer & (one - 1))
        value = ((longer >> 32) * wide + wide - 1 - span) * wide + wide - 1 - (longer & (one - 1))
        best = np.maximum(best, np.where(same, value, 0).max(axis=1))
    first = wide - 1 - best % wide
    span, matched = wide - 1 - best // wide % wide, best // wide // wide
    none = best == 0
    return matched, np.where(none, 0, start + first), np.where(none, 0, start + first + span)


def apart(matched: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[int]:
    """Which of the spans stay: the best first, and then all that overlap none of those taken."""
    taken: list[tuple[int, int, int]] = []
    for i in np.lexsort((first, end - first, -matched)).tolist():
        a, b = int(first[i]), int(end[i])
        at = bisect.bisect_left(taken, (a, b, -1))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
            taken.insert(at, (a, b, i))
    return [i for _, _, i in taken]


def least_run(n: int, coverage: float) -> int:
    """Words in a row that a match of a template of n words has at least, if its other words are replaced."""
    missing = n - max(1, math.ceil(coverage * n - 1e-9))
    return -(-(n - missing) // (missing + 1))


class Index:
    """The inverted indexes of the templates' strings, one for each length of strings that is needed."""

    def __init__(self, templates: Mapping[str, str], coverage: float = COVERAGE):
        self.names = sorted(templates)
        self.coverage = coverage
        data, offsets = utf8_of(pa.array([templates[n] for n in self.names], pa.string()))
        hashes, _, _, rows = words(data, offsets)
        self.words = [hashes[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]
        runs = np.array([least_run(len(w), coverage) if len(w) else 0 for w in self.words])
        # (length of strings, whether all strings of a text are looked up, strings, their templates and places)
        self.tables: list[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]] = []
        for size, every in [(GRAM, False), *[(k, True) for k in range(1, GRAM + 1)]]:
            mine = runs >= GRAM + WINDOW - 1 if not every else (np.minimum(runs, GRAM) == size) & (runs < GRAM + WINDOW - 1)
            grams = all_grams(hashes, size)
            row = np.searchsorted(rows, np.arange(len(grams)), side="right") - 1
            full = np.flatnonzero((np.arange(len(grams)) + size <= rows[row + 1]) & mine[row])
            if len(full):
                order = np.argsort(grams[full], kind="stable")
                self.tables.append((size, every, grams[full][order], row[full][order], (full - rows[row[full]])[order]))

    def _candidates(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(template, row, diagonal in the words of the batch) of every string that a text shares with a template, once each."""
        found = []
        for size, every, grams, template, at in self.tables:
            own = all_grams(hashes, size)
            kept = np.arange(len(own)) if every else winnow(own, rows)
            kept = kept[grams[np.minimum(np.searchsorted(grams, own[kept]), len(grams) - 1)] == own[kept]]
            row = np.searchsorted(rows, kept, side="right") - 1
            inside = kept + size <= rows[row + 1]
            kept, row = kept[inside], row[inside]
            low, high = np.searchsorted(grams, own[kept], "left"), np.searchsorted(grams, own[kept], "right")
            spans = high - low
            hits = np.repeat(low - np.concatenate([[0], np.cumsum(spans)])[: len(low)], spans) + np.arange(spans.sum())
            found.append(np.stack([template[hits], np.repeat(row, spans), np.repeat(kept, spans) - at[hits]]))
        whole = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)
        return whole[0], whole[1], whole[2]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str, int, int, int, int]]:
        """(row, template, matched words, template's words, start byte, end byte) of all matches."""
        hashes, starts, ends, rows = words(data, offsets)
        template, row, diagonal = self._candidates(hashes, rows)
        edges = np.flatnonzero(np.concatenate([[True], template[1:] != template[:-1], [True]])) if len(template) else []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            t = int(template[a])
            n, parts = len(self.words[t]), []
            for c in range(a, b, ALIGNED):
                d = slice(c, min(b, c + ALIGNED))
                parts.append(align(self.words[t], hashes, diagonal[d], rows[row[d]], rows[row[d] + 1], min(BAND, max(1, n // 4))))
            matched, first, end = (np.concatenate(p) for p in zip(*parts, strict=True))
            good = np.flatnonzero(matched >= self.coverage * n - 1e-9)
            for r in np.unique(row[a:b][good]).tolist():
                mine = good[slice(*np.searchsorted(row[a:b][good], [r, r + 1]))]  # rows are in order
                for i in apart(matched[mine], first[mine], end[mine]):
                    m = mine[i]
                    yield r, self.names[t], int(matched[m]), n, int(starts[first[m]] - offsets[r]), int(ends[end[m] - 1] - offsets[r])


@lru_cache(maxsize=4)
def _index(items: tuple[tuple[str, str], ...], coverage: float) -> Index:
    return Index(dict(items), coverage)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, license, matched_words, template_words, coverage, start_byte, end_byte), one row per match.

    A match has at least ``coverage`` of the template's words in order; it is found for
    certain if the others are replaced or left out. A text can match
    several templates and one template in several places that don't overlap. Null and
    empty texts match nothing, repeated rows repeat their matches, an empty table has
    no rows, a template without words is in no text. Documents are scanned where they
    are read, whole and without a shuffle.
    """
    items = tuple(sorted(templates.items()))
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(items, coverage)
        for batch in pieces(batches, text):
            found = list(index.scan(*utf8_of(batch.column(text))))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key).take(pa.array([f[0] for f in found])),
                        pa.array([f[1] for f in found]),
                        *(pa.array([f[i] for f in found], pa.int64()) for i in (2, 3)),
                        pa.array([f[2] / f[3] for f in found]),
                        *(pa.array([f[i] for f in found], pa.int64()) for i in (4, 5)),
                    ],
                    [key, "license", "matched_words", "template_words", "coverage", "start_byte", "end_byte"],
                )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, license string, matched_words bigint, template_words bigint, coverage double, start_byte bigint, end_byte bigint")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))
