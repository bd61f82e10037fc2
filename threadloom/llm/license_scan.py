"""Licence scan: Dice coefficient over word bigrams against licence templates.

Text is normalised (A-Z lowered, everything but a-z, 0-9 and line ends becomes a
space) and read as units: each line, each block between blank lines, the
whole text, and for each template the run of as many words that is nearest to it, wherever it stands in a line or
wraps over lines. A unit is compared with a template only if its number of distinct
bigrams allows the threshold at all: with sizes s and t, Dice is at most
2 min(s, t) / (s + t). An index from bigrams to templates finds those that share
any; a document sharing none is passed over after one walk through its words. Runs are looked at where enough
of a template's bigrams stand close together.

Defined cases: null, empty and one-word texts have no bigrams and no match; a unit
equal in words to another of its document counts once, as the first kind that
holds it (line, block, text, run); of equally near runs the first counts; ties between templates go to the first by name;
repeated rows repeat; very long texts are read whole, in all their units; other columns, whatever their names, are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches

THRESHOLD = 0.75

# Notices by which licences are recognised, as (licence, text).
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

_LETTERS = bytes(ord(chr(c).lower()) if chr(c).isascii() and chr(c).isalnum() else c if c == 10 else 32 for c in range(256))


def normalise(text: str | None) -> bytes:
    return (text or "").encode().translate(_LETTERS)


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:], strict=False))


class TemplateIndex:
    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must lie in (0, 1]")
        grams = [(name, no, bigrams(normalise(text).split())) for no, (name, text) in enumerate(templates)]
        self.threshold = threshold
        self.templates = sorted(((len(g), name, no) for name, no, g in grams if g), key=lambda t: t)
        self.sizes = [t[0] for t in self.templates]
        self.by_gram: dict[tuple[bytes, bytes], list[int]] = {}
        place = {no: k for k, (_, _, no) in enumerate(self.templates)}
        self.grams = [grams[no][2] for _, _, no in self.templates]
        self.lengths = [len(normalise(templates[no][1]).split()) for _, _, no in self.templates]
        for _, no, g in grams:
            for b in g:
                self.by_gram.setdefault(b, []).append(place[no])

    def match(self, words: list[bytes]) -> tuple[str, float] | None:
        """The best template at or above the threshold."""
        grams = bigrams(words)
        size = len(grams)
        lo = bisect_left(self.sizes, size * self.threshold / (2 - self.threshold) - 1e-9)
        hi = bisect_right(self.sizes, size * (2 - self.threshold) / self.threshold + 1e-9)
        if lo >= hi:
            return None
        shared = Counter(k for b in grams & self.by_gram.keys() for k in self.by_gram[b] if lo <= k < hi)
        found = [(-2 * n / (size + self.sizes[k]), self.templates[k][1]) for k, n in shared.items()]
        best = min(found, default=(0, ""))
        return (best[1], -best[0]) if -best[0] >= self.threshold else None

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Place and length of the run of words nearest to each template, where it reaches the threshold."""
        grams = list(zip(words, words[1:], strict=False))
        held: dict[int, list[int]] = {}
        for p, g in enumerate(grams):
            for k in self.by_gram.get(g, ()):
                held.setdefault(k, []).append(p)
        for k in sorted(held):
            size, n = self.sizes[k], self.lengths[k]
            # Dice is at most 2 s / (s + t) with s shared bigrams
            least = size * self.threshold / (2 - self.threshold) - 1e-9
            if len(held[k]) < least or len(words) < n:
                continue
            before = np.searchsorted(held[k], np.arange(len(words) - n + 1))
            near = np.searchsorted(held[k], np.arange(len(words) - n + 1) + n - 1) - before
            best = (0.0, 0)
            for p in np.flatnonzero(near >= least).tolist():
                g = set(grams[p : p + n - 1])
                best = max(best, (2 * len(g & self.grams[k]) / (len(g) + size), -p))
            if best[0] >= self.threshold:
                yield -best[1], n

    def scan(self, text: str | None) -> list[tuple[str, int, int, str, float]]:
        """(unit kind, first line, line count, licence, Dice) of every matching unit."""
        lines = [line.split() for line in normalise(text).split(b"\n")]
        words = [w for line in lines for w in line]
        if self.by_gram.keys().isdisjoint(zip(words, words[1:], strict=False)):
            return []
        units = [("line", k, 1, w) for k, w in enumerate(lines) if len(w) > 1]
        start = 0
        for k in range(len(lines) + 1):
            if k == len(lines) or not lines[k]:
                if k > start + 1:
                    units.append(("block", start, k - start, [w for line in lines[start:k] for w in line]))
                start = k + 1
        units.append(("text", 0, len(lines), words))
        ends = np.cumsum([len(line) for line in lines])
        for p, n in self.runs(words):
            first, last = np.searchsorted(ends, [p, p + n - 1], side="right").tolist()
            units.append(("run", first, last - first + 1, words[p : p + n]))
        seen: set[tuple[bytes, ...]] = set()
        found = []
        for kind, first, n, w in units:
            if (key := tuple(w)) not in seen:
                seen.add(key)
                if hit := self.match(w):
                    found.append((kind, first, n, *hit))
        return found


MATCHES = "unit string, first_line long, n_lines long, licence string, dice double"


def scan_licences(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every document with the array ``matches`` of its matching units; map only, no shuffle."""
    templates = list(TEMPLATES if templates is None else templates)
    TemplateIndex(templates, threshold)

    kind = pa.list_(pa.struct([("unit", pa.string()), ("first_line", pa.int64()), ("n_lines", pa.int64()), ("licence", pa.string()), ("dice", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates, threshold)
        for b in batches:
            found = [[dict(zip(("unit", "first_line", "n_lines", "licence", "dice"), m, strict=True)) for m in index.scan(v.as_py())] for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "matches"])

    bound_batches(docs.sparkSession)
    thin = docs.select("doc_id", "text")
    return thin.mapInArrow(run, f"doc_id {thin.schema[0].dataType.simpleString()}, matches array<struct<{MATCHES.replace(' ', ':').replace(',:', ',')}>>")


def best_licence(scanned: DataFrame) -> DataFrame:
    """Per document: matching units, the best licence, its Dice (six decimals) and all licences found."""
    top = F.array_min(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["licence"].alias("licence"))))
    return scanned.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        top["licence"].alias("licence"),
        F.round(F.coalesce(-top["d"], F.lit(0.0)), 6).alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"]))), ",").alias("licences"),
    )
