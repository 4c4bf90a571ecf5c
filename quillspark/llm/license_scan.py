"""License scan: Dice coefficient of word bigrams between a text's passages and licence templates.

Texts and templates are normalised alike (ASCII words, lower-cased; everything else separates). A passage is a line, a
block of lines without a blank one between, a run of neighbouring lines that all hold a template's rare bigram, or the
whole text. The Dice coefficient 2*common/(a+b) of bigram bags can only reach t if a/b lies between t/(2-t) and
(2-t)/t, so other templates are pruned by size, and if more than a third of the template's bigrams are there: a passage
without any of a template's anchor bigrams (a set larger than what may be missing) is passed over. One vectorised sweep
over a batch finds the lines with anchors; only those are compared.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernels as K
from .common import bounded_batches

SIMILAR = 0.8
#: Licence notices and short texts, in their publishers' public wording.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
}
_WORD = re.compile(rb"[a-z0-9]+")
#: Every byte but a letter or digit becomes a blank; line feeds stay.
_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[48:58] = np.arange(48, 58)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_LINES = _CLEAN.copy()
_LINES[10] = 10


def bigrams(text: bytes) -> Counter:
    words = _WORD.findall(text.translate(_CLEAN.tobytes()))
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * sum(min(n, b[k]) for k, n in a.items() if k in b) / total if total else 0.0


class Scanner:
    def __init__(self, templates: dict = TEMPLATES, similar: float = SIMILAR):
        self.similar = similar
        self.templates = [(name, k, bag, bag.total()) for name, texts in templates.items() for k, t in enumerate(texts) if (bag := bigrams(t.encode()))]
        seen = Counter(k for _, _, bag, _ in self.templates for k in bag)
        anchors: set[tuple[bytes, bytes]] = set()
        for _, _, bag, total in self.templates:
            # At a size of t/(2-t) of the template, all the passage's bigrams are common: so many at least.
            spare = total - similar / (2 - similar) * total
            got = 0
            for gram in sorted(bag, key=lambda g: (seen[g], -len(g[0]) - len(g[1]), g)):
                if got > spare:
                    break
                anchors.add(gram)
                got += bag[gram]
        joined = b" ".join(w for g in sorted(anchors) for w in g)
        data = np.frombuffer(joined, np.uint8)
        starts, ends, _ = K.word_bounds(data, np.array([0, len(data)]))
        hashes = K.word_hashes(data, starts, ends)
        self.anchors = np.sort(self._pair(hashes[::2], hashes[1::2]))

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * np.uint64(0xD6E8FEB86659FD93) + b

    def anchor_words(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Places (bytes in the batch) of the first words of anchor bigrams, those across lines included."""
        clean = _CLEAN[data]
        starts, ends, _ = K.word_bounds(clean, offsets)
        if len(starts) < 2:
            return np.zeros(0, np.int64)
        hashes = K.word_hashes(clean, starts, ends)
        pairs = self._pair(hashes[:-1], hashes[1:])
        at = np.minimum(np.searchsorted(self.anchors, pairs), len(self.anchors) - 1)
        return starts[:-1][self.anchors[at] == pairs]

    def best(self, passage: bytes) -> list[tuple[float, str, int, int]]:
        """(dice, name, template, candidates) of the best template, if similar enough."""
        bag = bigrams(passage)
        size, low = bag.total(), self.similar / (2 - self.similar)
        near = [t for t in self.templates if low * t[3] <= size * (1 + 1e-9) and low * size <= t[3] * (1 + 1e-9)]
        found = [(dice(bag, t[2]), t[0], t[1]) for t in near]
        good = sorted(((d, n, k) for d, n, k in found if d >= self.similar), key=lambda x: (-x[0], x[1], x[2]))
        return [(*good[0], len(near))] if good else []

    def passages(self, text: bytes, hits: list[int]) -> set[tuple[int, int]]:
        """(start, end) of the passages that hold an anchor."""
        out: set[tuple[int, int]] = {(0, len(text))}
        runs: list[tuple[int, int]] = []
        for at in hits:
            a, b = text.rfind(b"\n", 0, at) + 1, text.find(b"\n", at)
            b = len(text) if b < 0 else b
            if not runs or runs[-1] != (a, b):
                runs.append((a, b))
        out.update(runs)
        merged: list[tuple[int, int]] = []
        for a, b in runs:  # neighbouring lines, one without an anchor between at most
            if merged and text.count(b"\n", merged[-1][1], a) <= 2:
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        out.update(merged)
        for a, b in merged:
            low, high = text.rfind(b"\n\n", 0, a), text.find(b"\n\n", b)
            out.add((low + 2 if low >= 0 else 0, len(text) if high < 0 else high))
        return out

    def scan(self, text: bytes, hits: list[int]) -> list[tuple[str, float, int, int]]:
        """(license, dice, start, end), start and end in bytes, best first, one for each licence."""
        best: dict[str, tuple[float, int, int]] = {}
        for a, b in sorted(self.passages(text, hits)):
            for d, name, _, _ in self.best(text[a:b]):
                if name not in best or d > best[name][0]:
                    best[name] = (d, a, b)
        return sorted(((n, *x) for n, x in best.items()), key=lambda x: (-x[1], x[0]))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict | None = None, similar: float = SIMILAR) -> DataFrame:
    """A row per document: doc_id, license (best, null without one), dice, start, end (code points), licenses (all, best first).

    A null or empty text has no licence. Ids may be null or repeat, and so may rows: each is scanned. Of equal
    coefficients the licence first by name wins. Other columns are ignored; an empty table gives no rows. Only
    passages that hold an anchor are compared, among them the whole text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chosen = templates or TEMPLATES
    id_type = rows.schema["doc_id"].dataType.simpleString()

    bounded_batches(docs.sparkSession)
    def run(batches):
        scanner = Scanner(chosen, similar)
        for batch in K.slices(batches, "text"):
            data, offsets = K.buffer_of(batch.column("text"))
            places = scanner.anchor_words(data, offsets)
            bounds = np.searchsorted(places, offsets)
            names: list = [None] * batch.num_rows
            scores: list = [None] * batch.num_rows
            starts: list = [None] * batch.num_rows
            ends: list = [None] * batch.num_rows
            every: list = [[] for _ in range(batch.num_rows)]
            for k in np.flatnonzero(np.diff(bounds)):
                text = data[offsets[k] : offsets[k + 1]].tobytes()
                found = scanner.scan(text, (places[bounds[k] : bounds[k + 1]] - offsets[k]).tolist())
                if found:
                    names[k], scores[k], a, b = found[0]
                    starts[k], ends[k] = len(text[:a].decode()), len(text[:b].decode())
                    every[k] = [x[0] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(every, pa.list_(pa.string()))], names=["doc_id", "license", "dice", "start", "end", "licenses"])

    return rows.mapInArrow(run, f"doc_id {id_type}, license string, dice double, start int, end int, licenses array<string>")
