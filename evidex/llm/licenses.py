"""License scans: winnowed template fingerprints, then banded alignment.

Templates are few and fixed in size.  Their winnowed word trigrams form an inverted index
(fingerprint -> template, position) that goes to every task; a document's trigrams are looked up in
it.  Hits on neighbouring diagonals make a candidate region, which is aligned with the template
inside a band, and the alignment's coverage of the template and its span in the text are reported.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

# Public license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "all-rights-reserved": "All rights reserved.",
}
GRAM, WINDOW = 3, 2  # a common run of GRAM + WINDOW - 1 words is always found
EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def plain(raw: str) -> str:
    return EDGE.sub("", raw).lower()


@dataclass
class Index:
    """Templates as word numbers and their winnowed trigrams."""

    names: list[str]
    texts: list[list[int]]
    number: dict[str, int]
    prints: np.ndarray  # sorted trigram codes
    places: list[list[tuple[int, int]]]  # (template, position) of each

    @staticmethod
    def of(templates: dict[str, str]) -> Index:
        number: dict[str, int] = {}
        texts = [[number.setdefault(w, len(number)) for r in t.split() if (w := plain(r))] for t in templates.values()]
        base = len(number) + 1
        found: dict[int, list[tuple[int, int]]] = {}
        for i, words in enumerate(texts):
            grams = [(words[j] * base + words[j + 1]) * base + words[j + 2] for j in range(len(words) - GRAM + 1)]
            if len(grams) <= WINDOW:
                kept = range(len(grams))
            else:  # the least of each window, by a mixed order
                mixed = [g * 0x9E3779B97F4A7C15 % (1 << 64) for g in grams]
                kept = sorted({min(range(j, j + WINDOW), key=lambda x: (mixed[x], -x)) for j in range(len(grams) - WINDOW + 1)})
            for j in kept:
                found.setdefault(grams[j], []).append((i, j))
        codes = sorted(found)
        return Index(list(templates), texts, number, np.array(codes, np.int64), [found[c] for c in codes])


def align(doc: list[int], template: list[int], shift: int, band: int) -> tuple[int, int, int]:
    """Words of the template matched in order, and the first and last place (exclusive) in ``doc``.

    Global in the template, free at both ends of ``doc``; only cells within ``band`` of the
    diagonal ``doc place = template place + shift`` are filled.  Match 2, mismatch and gap -1."""
    low = -(10**9)
    n, m = len(doc), len(template)
    width = 2 * band + 1
    # cell: (score, matches, start); column j stands for doc place i + shift - band + j
    row = [(0, 0, max(0, shift - band + j)) if 0 <= shift - band + j <= n else (low, 0, 0) for j in range(width)]
    for i in range(1, m + 1):
        new = []
        for j in range(width):
            d = i + shift - band + j
            if not 0 <= d <= n:
                new.append((low, 0, 0))
                continue
            s, c, a = row[j]  # doc place d - 1 in the row before
            best = (low, 0, d)
            if d >= 1 and s > low:
                hit = doc[d - 1] == template[i - 1]
                best = (s + (2 if hit else -1), c + hit, a if c or hit else d - 1 + (not hit))
            if j + 1 < width and row[j + 1][0] > low:
                s, c, a = row[j + 1]
                best = max(best, (s - 1, c, a), key=lambda x: x[0])
            if new and new[-1][0] > low:
                s, c, a = new[-1]
                best = max(best, (s - (1 if c else 0), c, a if c else d), key=lambda x: x[0])
            new.append(best)
        row = new
    j = max(range(width), key=lambda x: (row[x][0], -x))
    score, matched, start = row[j]
    end = min(n, max(0, m + shift - band + j))
    return (matched, start, end) if score > low and matched else (0, 0, 0)


def scan_text(text: str, index: Index, seen: dict[str, int], least: float) -> list[tuple[str, int, int, int, float]]:
    """(license, start, end, matched words, coverage): code points, end exclusive, by start."""
    raw = text.split()
    ids = np.fromiter((seen[w] for w in raw), np.int64, len(raw))
    real = np.flatnonzero(ids >= -1)  # punctuation alone (-2) is no word
    ids = ids[real]
    if len(ids) < GRAM:
        return []
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    known = np.flatnonzero((a >= 0) & (b >= 0) & (c >= 0))
    if not len(known):
        return []
    base = len(index.number) + 1
    codes = (a[known] * base + b[known]) * base + c[known]
    at = np.minimum(np.searchsorted(index.prints, codes), len(index.prints) - 1)
    hits: dict[int, list[tuple[int, int]]] = {}
    for place, k in zip(known[index.prints[at] == codes].tolist(), at[index.prints[at] == codes].tolist()):
        for template, pos in index.places[k]:
            hits.setdefault(template, []).append((place - pos, place))
    if not hits:
        return []
    words, found, spans = ids.tolist(), [], None
    for template, places in sorted(hits.items()):
        pattern = index.texts[template]
        band = 4 + len(pattern) // 8
        places.sort()
        groups: list[list[tuple[int, int]]] = []
        for p in places:  # hits whose diagonals are within the band belong together
            if groups and p[0] - groups[-1][0][0] <= band:
                groups[-1].append(p)
            else:
                groups.append([p])
        taken = -1
        for group in groups:
            shift = group[len(group) // 2][0]
            first = max(0, shift - band)
            part = words[first : shift + len(pattern) + band]
            matched, start, end = align(part, pattern, shift - first, band)
            coverage = matched / len(pattern)
            if coverage < least or first + start < taken:
                continue
            while end > start and part[end - 1] not in pattern:
                end -= 1
            taken = first + end
            if spans is None:
                spans = [m.span() for m in re.finditer(r"\S+", text)]
            found.append((index.names[template], spans[real[first + start]][0], spans[real[first + end - 1]][1], matched, coverage))
    return sorted(found, key=lambda x: (x[1], x[0]))


class Known(dict):
    """Raw word -> template word number, -1 (another word) or -2 (no word)."""

    def __init__(self, number: dict[str, int]):
        super().__init__()
        self.number = number

    def __missing__(self, raw: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        word = plain(raw)
        value = self[raw] = self.number.get(word, -1) if word else -2
        return value


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, license, start, end, matched_words, coverage: one row per match.

    Coverage is the matched share of the template's words, ``least`` or more.  Null and empty
    texts give no rows; a repeated row gives its matches again."""
    index = docs.sparkSession.sparkContext.broadcast(Index.of(templates or TEMPLATES))
    added = StructType.fromDDL("license string, start int, end int, matched_words int, coverage double")
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *added])
    arrow = to_arrow_schema(schema)

    def run(batches):
        seen = Known(index.value.number)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    rows += [(doc_id, *r) for r in scan_text(text, index.value, seen, least)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
