"""Operator 3: license notices in texts, by MinHash bands over overlapping windows.

Words are `\\w`-runs of the case-folded text, features are hashed shingles of `SHINGLE` words (a
shorter template is one shingle, and is compared with document shingles of its own length). For
templates of about L shingles a document is read in windows of L + step shingles, a step (a quarter
of L) apart, so every stretch of L shingles lies whole in one window. `BANDS` bands of one MinHash
value each retrieve the templates that agree with a window in a band: a window that holds the needed
share of a template has a Jaccard similarity of at least 0.75 L / 1.5 L = 0.5 to it, and is
retrieved with probability of at least 1 - 0.5^BANDS (above 0.99998). What is retrieved is verified
exactly: the share of the template's shingles that the window holds must reach `CONTAINMENT`.

Templates are a parameter (name, text); the registry holds the usual short notices (`NOTICES`) and
the bodies of `license_texts`, cut into overlapping templates of 64 shingles. A passage that stands in
bodies of several names has all of them, joined by a slash.

Defined cases: null, empty and wordless texts hold no notice; a template without words is never
found; equal rows get equal answers; a text of any length is read whole; other columns pass through.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, table, text_batches
from .license_texts import BODIES
from .shingles import _ODD, mix

SHINGLE, BANDS = 5, 16
CONTAINMENT = 0.75
WORD = re.compile(r"\w+")

#: Short public license notices.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    *(("MIT", f"{how} the MIT License") for how in ("Licensed under", "Distributed under", "Available under", "Provided under",
                                                    "Published under", "Covered by", "Terms of")),
    ("BSD", "Licensed under the BSD License"), ("BSD", "Use of this source code is governed by a BSD-style license"),
    ("BSD", "Licensed under the BSD 2-Clause License"), ("BSD", "Licensed under the BSD 3-Clause License"),
    ("ISC", "Licensed under the ISC License"), ("ISC", "Released under the ISC License"),
    ("Apache-2.0", "Licensed under the Apache License 2.0"), ("Apache-2.0", "Under the Apache 2.0 License"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("GPL", "Licensed under the GNU General Public License"), ("GPL", "Released under the GNU General Public License"),
    ("GPL", "Distributed under the GNU General Public License"), ("GPL", "Terms of the GNU General Public License"),
    ("GPL-2.0", "GNU General Public License v2"), ("GPL-2.0", "GNU General Public License version 2"),
    ("GPL-3.0", "GNU General Public License v3"), ("GPL-3.0", "GNU General Public License version 3"),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
            "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("LGPL", "Under the GNU Lesser General Public License"), ("LGPL", "Terms of the GNU Lesser General Public License"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation"),
    ("AGPL", "Under the GNU Affero General Public License"), ("AGPL", "Terms of the GNU Affero General Public License"),
    ("AGPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
             "Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "Under the Mozilla Public License 2.0"), ("MPL-2.0", "Under the Mozilla Public License, Version 2.0"),
    ("EPL-2.0", "Made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EPL-1.0", "Made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("EPL", "Licensed under the Eclipse Public License"),
    *((f"CC-{short}-{v}", f"licensed under a Creative Commons {long} {v} {where} License")
      for short, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"),
                          ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                          ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
      for v, where in (("4.0", "International"), ("3.0", "Unported"))),
    *((f"CC-{x}-{v}", f"Licensed under CC {x} {v}") for x in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND") for v in ("4.0", "3.0")),
    ("CC-BY-NC-3.0", "Licensed under CC BY-NC 3.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("CC0-1.0", "Licensed under CC0 1.0 Universal"), ("CC0-1.0", "CC0 1.0 Universal Public Domain Dedication"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
                "accompanying documentation covered by this license"),
)


def body_templates(bodies, size: int = 64, step: int = 60) -> tuple[tuple[str, str], ...]:
    """Stretches of `size` shingles of each body, `step` words apart; their name is joined from those of
    all bodies that hold at least half of their shingles."""
    words = [(name, WORD.findall(text.casefold())) for name, text in bodies]
    grams = [{tuple(w[k:k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)} for _, w in words]
    out = []
    for _, w in words:
        last = max(0, len(w) - size - SHINGLE + 1)
        for at in sorted({*range(0, last, step), last}):
            part = w[at:at + size + SHINGLE - 1]
            own = {tuple(part[k:k + SHINGLE]) for k in range(len(part) - SHINGLE + 1)}
            names = {n for (n, _), g in zip(words, grams) if 2 * len(own & g) >= len(own)}
            out.append(("/".join(sorted(names)), " ".join(part)))
    return tuple(out)


TEMPLATES = NOTICES + body_templates(BODIES)


def _hashes(docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(d) for d in docs], "<i8")
    flat = np.empty(int(counts.sum()), object)
    flat[:] = [w for d in docs for w in d]
    if not len(flat):
        return np.zeros(0, "<u8"), counts
    codes, names = pd.factorize(flat)
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in names), "<u8", len(names))[codes], counts


def _shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words."""
    if len(h) < n:
        return np.zeros(0, "<u8")
    out = np.repeat(np.array([n], "<u8") * _ODD[-1], len(h) - n + 1)
    for k in range(n):
        out += mix(h[k:len(h) - n + 1 + k] + _ODD[k]) * _ODD[k]
    return mix(out)


def _ranked(s: np.ndarray, band: int) -> np.ndarray:
    return mix(s ^ (_ODD[band % 8:band % 8 + 1] * np.uint64(2 * band + 1)))


class Registry:
    """Templates by shingle length and by size class, with their MinHash values."""

    def __init__(self, templates):
        self.names, self.sets, self.groups = [], [], defaultdict(list)
        for name, text in templates:
            h, _ = _hashes([WORD.findall(text.casefold())])
            if not len(h):
                continue
            n = min(SHINGLE, len(h))
            s = np.unique(_shingles(h, n))
            size = 1 << (len(s) - 1).bit_length()      # size classes double
            self.groups[n, size].append(len(self.names))
            self.names.append(name)
            self.sets.append(s)
        self.minima = {i: np.array([_ranked(s, k).min() for k in range(BANDS)], "<u8") for i, s in enumerate(self.sets)}

    def scan(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """Per text the (name, first word, end word) of its notices, merged by name."""
        found = [defaultdict(list) for _ in texts]
        h, counts = _hashes([WORD.findall(t.casefold()) if t else [] for t in texts])
        ends = np.cumsum(counts)
        first = ends - counts
        for n in sorted({n for n, _ in self.groups}):
            s = _shingles(h, n)
            own = np.maximum(counts - n + 1, 0)           # shingles of each text
            classes = {size: members for (m, size), members in self.groups.items() if m == n}
            windows = {size: _windows(own, first, size) for size in classes}
            hits = {size: np.zeros((len(classes[size]), len(windows[size][0])), bool) for size in classes}
            for band in range(BANDS if own.any() else 0):
                value = _ranked(s, band)
                for size, members in classes.items():
                    low = _window_minima(value, *windows[size][1:])
                    for j, i in enumerate(members):
                        hits[size][j] |= low == self.minima[i][band]
            for size, members in classes.items():
                row, lo, hi = windows[size]
                for j, i in enumerate(members):
                    for w in np.flatnonzero(hits[size][j]).tolist():
                        there = np.flatnonzero(np.isin(s[lo[w]:hi[w]], self.sets[i]))
                        if len(np.unique(s[lo[w]:hi[w]][there])) >= CONTAINMENT * len(self.sets[i]):
                            base = int(lo[w] - first[row[w]])
                            found[row[w]][self.names[i]].append((base + int(there[0]), base + int(there[-1]) + n))
        return [sorted((name, a, b) for name, spans in f.items() for a, b in _merged(spans)) for f in found]


def _merged(spans):
    out = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _windows(own: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, lo, hi) of windows of size + step shingles, a step apart, each inside its text."""
    step = max(1, size // 4)
    per = np.where(own > 0, np.maximum(-(-(own - size) // step), 0) + 1, 0)
    row = np.repeat(np.arange(len(own)), per)
    lo = (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * step + first[row]
    return row, lo, np.minimum(lo + size + step, (first + own)[row])


def _window_minima(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of v[lo:hi] of each window (hi > lo), from minima of doubling lengths."""
    out = np.empty(len(lo), "<u8")
    size, left = hi - lo, np.ones(len(lo), bool)
    span, m = 1, v
    while left.any():
        now = left & (size < 2 * span)
        out[now] = np.minimum(m[lo[now]], m[hi[now] - span])
        left &= ~now
        if left.any():
            m = np.minimum(m[:-span], m[span:])
            span *= 2
    return out


def scan(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> DataFrame:
    """`docs` with `notices`: array of (name, first, end) with the notice's words of the text."""
    ready(docs.sparkSession)
    rest = [c for c in docs.columns if c != "notices"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in rest] + ["notices array<struct<name:string,first:int,end:int>>"])
    kind = pa.list_(pa.struct([("name", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        registry = Registry(templates)
        for b, texts in text_batches(batches, text):
            got = [[{"name": n, "first": a, "end": e} for n, a, e in f] for f in registry.scan(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, kind)], [*rest, "notices"])

    return docs.select(*rest).mapInArrow(run, schema)


def specific(docs: DataFrame) -> DataFrame:
    """`docs` without the notices that only name the family of a versioned notice at their place."""
    return docs.withColumn("notices", F.filter("notices", lambda x: ~F.exists("notices", lambda y: (
        y["name"].startswith(F.concat(x["name"], F.lit("-"))) & (y["first"] < x["end"]) & (x["first"] < y["end"])))))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """Per document: n_notices, licenses (distinct names), spans (name:first word:end word)."""
    out = specific(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))
    spans = F.transform("notices", lambda x: F.concat_ws(":", x["name"], x["first"], x["end"]))
    return out.select("doc_id", F.size("notices").cast("bigint").alias("n_notices"),
                      F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["name"]))), ",").alias("licenses"),
                      F.array_join(spans, ",").alias("spans"))
