"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Texts and templates become lower-case words without punctuation and shingles of three words. A template of n shingles is sought in windows
of n shingles, a step of n/8 apart. A window is signed with 96 minima in 48 bands of 2; windows that share a band with a template are
compared with it. If a text holds 0.8 of a template's shingles in n places, the nearest window is at least 0.54 similar to it and shares a
band with probability above 1 - 1e-7. A window without any shingle of a template has no minimum in common with it, so only windows around
such shingles are signed; this leaves out nothing. A match is the largest share of the template's shingles in any n successive ones
around the window, if at least `CONTAINED`.

Defined results: null and empty texts match nothing; templates of fewer than three words are one shingle; repeated rows match alike; one
row per document, template and place, overlapping matches of one template being one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framefusion.llm.text_hash import chunks, mix, pieces, shingles, tokens

WIDTH, CONTAINED = 3, 0.8
BANDS, ROWS = 48, 2
TEMPLATE_SLICE = 2_000

# Notices of widely used licenses.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation"),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def text_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Shingles, their rows, and the byte range of each. Rows of one or two words have one shingle."""
    data = _LOWER[data]
    starts, ends, rows = tokens(data, offsets, punctuation=True)
    first = data[starts] if len(starts) else np.zeros(0, np.uint8)
    word = (first >= 128) | (first == 95) | ((first >= 48) & (first < 58)) | ((first >= 97) & (first < 123))
    starts, ends, rows = starts[word], ends[word], rows[word]
    n = len(offsets) - 1
    values, at = shingles(pieces(data, starts, ends), rows, n, WIDTH)
    begin = np.searchsorted(rows, np.arange(n + 1))
    place = np.arange(len(at)) - np.searchsorted(at, np.arange(n + 1))[at] + begin[at]
    last = np.minimum(place + WIDTH, begin[at + 1]) - 1
    return values, at, starts[place], ends[last]


def bands(windows: np.ndarray) -> np.ndarray:
    """Band hashes (windows x BANDS) of windows of shingles, the shingles of a window along its row."""
    out = np.empty((len(windows), BANDS), np.uint64)
    for b in range(BANDS):
        hashed = np.full(len(windows), b, np.uint64)
        for r in range(ROWS):
            hashed = mix(hashed * np.uint64(31) + mix(windows ^ _SEEDS[b * ROWS + r]).min(axis=1))
        out[:, b] = hashed
    return out


class Scanner:
    """Templates by length, with their shingles and bands."""

    def __init__(self, templates: list[tuple[str, str]]) -> None:
        self.names = [name for name, _ in templates]
        whole = [(text or "").encode() for _, text in templates]
        values, at, _, _ = text_shingles(np.frombuffer(b"".join(whole), np.uint8), np.cumsum([0, *map(len, whole)]))
        self.own = [np.unique(values[at == i]) for i in range(len(templates))]
        self.length = np.array([np.count_nonzero(at == i) for i in range(len(templates))])
        self.known = np.unique(values)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.by_length = {}
        for n in sorted(set(self.length[self.length > 0].tolist())):
            members = np.flatnonzero(self.length == n)
            keys = bands(np.array([values[at == i] for i in members]))
            order = np.argsort(keys, axis=None)
            self.by_length[n] = (keys.reshape(-1)[order], np.repeat(members, BANDS)[order])

    def scan(self, values: np.ndarray, rows: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(template, containment, first shingle, last shingle + 1) of the matches; overlapping ones of a template are merged."""
        hits = np.flatnonzero(self.filter[(values & np.uint64(0xFFFF)).astype(np.int64)])
        hits = hits[np.isin(values[hits], self.known)]
        if not len(hits):
            return []
        edges = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        edges = np.append(edges, len(rows))
        row_of = np.searchsorted(edges, hits, side="right") - 1
        low, high = edges[row_of], edges[row_of + 1]
        best: dict[tuple[int, int], float] = {}
        for n, (keys, members) in self.by_length.items():
            step = max(1, n // 8)
            # Windows on the grid of each row that hold a known shingle; a short row has one window of its own length.
            back = np.arange(-(-n // step) + 1)
            starts = low[:, None] + ((hits - low)[:, None] // step - back[None]) * step
            inside = (starts >= low[:, None]) & (starts > hits[:, None] - n)
            last = np.maximum(low, high - n)[:, None]
            starts = np.unique(np.minimum(starts, last)[inside])
            for at in range(0, len(starts), 4_096):
                some = starts[at:at + 4_096]
                index = some[:, None] + np.arange(n)[None]
                end = edges[np.searchsorted(edges, some, side="right")]
                signed = bands(values[np.minimum(index, end[:, None] - 1)])
                left = np.searchsorted(keys, signed.reshape(-1))
                left[left == len(keys)] = 0
                found = np.flatnonzero(keys[left] == signed.reshape(-1))
                pairs = set()
                for f in found:
                    k = left[f]
                    while k < len(keys) and keys[k] == signed.flat[f]:
                        pairs.add((int(members[k]), int(some[f // BANDS])))
                        k += 1
                for template, start in pairs:
                    floor, ceiling = self._row(edges, start)
                    for place in range(max(floor, start - step), min(start + step, max(floor, ceiling - n)) + 1):
                        if (template, place) not in best:
                            share = np.isin(self.own[template], values[place:min(place + n, ceiling)]).mean()
                            if share >= CONTAINED:
                                best[template, place] = float(share)
        out: list[tuple[int, float, int, int]] = []
        for (template, place), share in sorted(best.items()):
            n = int(self.length[template])
            ceiling = self._row(edges, place)[1]
            if out and out[-1][0] == template and place < out[-1][2] + n and place < out[-1][3]:
                if share > out[-1][1]:
                    out[-1] = (template, share, place, min(place + n, ceiling))
            else:
                out.append((template, share, place, min(place + n, ceiling)))
        return out

    @staticmethod
    def _row(edges: np.ndarray, place: int) -> tuple[int, int]:
        i = int(np.searchsorted(edges, place, side="right"))
        return int(edges[i - 1]), int(edges[i])


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per match: key, `license`, `template` (its number), `containment`, and the code points [`start`, `end`) it covers.
    More than `TEMPLATE_SLICE` templates are sought slice by slice."""
    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    out = None
    for low in range(0, max(1, len(templates)), TEMPLATE_SLICE):
        part = list(templates[low:low + TEMPLATE_SLICE])

        def scan(batches: Iterator[pa.RecordBatch], part: list = part, low: int = low) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(part)
            for batch in batches:
                for first, _, data, offsets in chunks(batch.column(1)):
                    values, rows, begins, ends = text_shingles(data, offsets)
                    take, found = [], []
                    for template, share, a, b in scanner.scan(values, rows):
                        row = int(rows[a])
                        points = [len(bytes(data[offsets[row]:x]).decode("utf-8", "replace")) for x in (begins[a], ends[b - 1])]
                        take.append(first + row)
                        found.append((scanner.names[template], low + template, share, *points))
                    columns = list(zip(*found)) if found else [[]] * 5
                    kinds = (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                        ["key", "license", "template", "containment", "start", "end"])

        each = picked.mapInArrow(scan, f"key {kind}, license string, template int, containment double, start long, end long")
        out = each if out is None else out.unionByName(each)
    return out.withColumnRenamed("key", key)
