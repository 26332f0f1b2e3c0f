"""License scans: MinHash over overlapping windows of words retrieves templates, exact containment verifies.

A template of m five-word shingles is looked for in windows of L shingles, L the least power of two that is at
least 2 m, each half over the next, so a passage of up to 1.5 m shingles or so lies whole in some window. A
window that holds 75 % of a template has a Jaccard similarity to it of at least 0.75 m / (4 m + 0.25 m), so
with ``BANDS`` bands of one row it is retrieved with probability 1 - (1 - 0.176) ** BANDS, above 0.99999 at
64. Retrieved pairs are kept where the window's shingles contain at least ``LEAST`` of the template's, counted
exactly; overlapping windows of one template become one match, counted again over both.

Words are compared without what stands around them: comment leaders, quotes, brackets and other punctuation end
a word, as white space does, and only ``INNER`` marks between two word characters belong to it ("2.0", "and/or").
What is left empty is no word, so headers wrapped in "#", "//" or " *" comments have the template's shingles.

Signatures are made for all windows of a slice of texts together: per band the shingles are hashed once, and least
values of blocks of 1, 2, 4 and so on shingles follow from each other; a window is two blocks.

One pass over whole texts without a shuffle; templates are a fixed list of bounded size.

Nulls: a null text is empty and has no matches. Repeated rows are scanned alike. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from deltaweave.llm.text import IS_SPACE, LOWER, mix, owners, slices, span_hash, words

WIDTH, BANDS, LEAST = 5, 64, 0.75
_U = np.uint64

#: Marks that belong to a word between two of its characters.
INNER = "-./'_+"
_LETTER = np.zeros(256, bool)
_LETTER[[k for k in range(256) if k >= 128 or chr(k).isalnum()]] = True
_INNER = np.zeros(256, bool)
_INNER[list(INNER.encode())] = True

#: Notices that grant or name a license.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "mit-licensed": "This project is licensed under the MIT License",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-disclaimer": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}


def in_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which bytes belong to words. Of other scripts, U+0080 to U+00BF and U+2000 to U+203F (signs, quotes, dashes,
    bullets) don't; other characters count as letters."""
    letter = _LETTER[data]
    lead = np.flatnonzero(data[:-1] == 0xC2)
    letter[lead] = letter[lead + 1] = False
    lead = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x80))
    letter[lead] = letter[lead + 1] = letter[lead + 2] = False
    inner = _INNER[data]
    inner[:1] = inner[-1:] = False
    edges = offsets[1:-1]  # a mark at the edge of a text has no neighbour
    edges = edges[(edges > 0) & (edges < len(data))]
    inner[edges] = inner[edges - 1] = False
    inner[1:-1] &= letter[:-2] & letter[2:]
    return letter | inner


def sequence(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle at each word, bounds of the texts' shingles, starts and ends of words, bounds of the texts' words).
    Words are of A-Z lower-cased bytes without outer punctuation; a text of fewer words has no shingle."""
    starts, ends, first = words(np.where(in_words(data, offsets), data, np.uint8(0x20)), offsets)
    count = np.diff(first)
    room = np.maximum(count - width + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(room)])
    if not bounds[-1]:
        return np.zeros(0, _U), bounds, starts, ends, first
    h = span_hash(LOWER[data], starts, ends)
    text = owners(bounds)
    at = np.arange(bounds[-1]) - bounds[text] + first[text]
    out = np.zeros(len(at), _U)
    for k in range(width):
        out = out + h[at + k] * _U(pow(0xA24BAED4963EE407 | 1, k + 1, 1 << 64))
    return mix(out), bounds, starts, ends, first


class Scanner:
    """Templates by name, their shingles (and where each comes first), signatures and window lengths."""

    def __init__(self, templates: dict[str, str], width: int = WIDTH, bands: int = BANDS, least: float = LEAST):
        self.width, self.least = width, least
        self.seeds = mix(np.arange(1, bands + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
        self.names, self.sets, self.orders = [], [], []
        for name, text in templates.items():
            for _, _, data, offsets in slices(pa.array([text])):
                own = sequence(data, offsets, width)[0]
                if len(own):
                    self.names.append(name)
                    self.sets.append(np.unique(own))
                    self.orders.append({x: k for k, x in reversed(list(enumerate(own.tolist())))})
        #: By half of the window length: for each band the templates by their least value.
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        for k, own in enumerate(self.sets):
            half = 1 << int(np.ceil(np.log2(len(own))))
            table = self.tables.setdefault(half, [{} for _ in self.seeds])
            for b, value in enumerate(mix(own[None, :] ^ self.seeds[:, None]).min(axis=1).tolist()):
                table[b].setdefault(value, []).append(k)
        #: Which low 16 bits those values have; other values need no look into the tables.
        self.maybe = {half: [np.isin(np.arange(1 << 16), [v & 0xFFFF for v in band]) for band in table] for half, table in self.tables.items()}

    def retrieve(self, h: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int, int, int]]:
        """(text, template, half the window length, window) of windows that share a least value with a template; window
        w begins at shingle w times that half."""
        if not len(h) or not self.tables:
            return set()
        widest = max(self.tables)
        count = -(-np.diff(bounds) // widest)
        begin = np.concatenate([[0], np.cumsum(count)]) * widest  # each text has whole blocks of every size
        text = owners(bounds)
        at = np.arange(len(h)) - bounds[text] + begin[text]
        filled = begin[1:][count > 0]
        found = set()
        line = np.full(begin[-1], ~_U(0))
        for b, seed in enumerate(self.seeds):
            line[at] = mix(h ^ seed)
            blocks, half = line, 1
            while True:
                if half in self.tables:
                    window = blocks.copy()
                    np.minimum(blocks[:-1], blocks[1:], out=window[:-1])
                    last = filled // half - 1  # the next block is of another text
                    window[last] = blocks[last]
                    for w in np.flatnonzero(self.maybe[half][b][(window & _U(0xFFFF)).astype(np.int64)]).tolist():
                        for k in self.tables[half][b].get(int(window[w]), ()):
                            t = int(np.searchsorted(begin, w * half, side="right")) - 1
                            found.add((t, k, half, w - int(begin[t]) // half))
                if half == widest:
                    break
                blocks, half = np.minimum(blocks[::2], blocks[1::2]), 2 * half
        return found

    def find(self, h: np.ndarray, windows: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(template, first word, end word, shingles contained) for the shingles of a text in order and the windows
        (template, half, window) retrieved in it."""
        held: dict[int, set[int]] = {}
        for k, half, w in windows:
            part = h[w * half : (w + 2) * half]
            held.setdefault(k, set()).update((np.flatnonzero(np.isin(part, self.sets[k])) + w * half).tolist())
        found = []
        for k, places in held.items():
            if not places:  # the least values of a window and a template can be equal by chance
                continue
            at = np.array(sorted(places))
            order = self.orders[k]
            nth = np.array([order[x] for x in h[at].tolist()])
            # a place of the template that comes again, or a gap longer than the template, begins another passage
            cuts = np.flatnonzero((np.diff(nth) <= 0) | (np.diff(at) > len(order))) + 1
            for run in np.split(at, cuts):
                shared = len(np.unique(h[run]))
                if shared >= self.least * len(self.sets[k]):
                    found.append((k, int(run[0]), int(run[-1]) + self.width, shared))
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, bands: int = BANDS, least: float = LEAST) -> DataFrame:
    """One row per match: ``doc_id``, ``license`` (the template's name), ``start`` and ``end`` (code points, end
    exclusive; with the punctuation that touches the outer words), ``shared`` and ``size`` (shingles contained and
    of the template)."""
    templates = TEMPLATES if templates is None else templates
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    zero = F.lit(0).cast("long")
    schema = picked.select("doc_id", F.lit("").alias("license"), *(zero.alias(c) for c in ("start", "end", "shared", "size"))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, width, bands, least)
        for batch in batches:
            for first, _, data, offsets in slices(batch.column(1)):
                h, bounds, starts, ends, word = sequence(data, offsets, width)
                windows: dict[int, list[tuple[int, int, int]]] = {}
                for k, *window in sorted(scanner.retrieve(h, bounds)):
                    windows.setdefault(k, []).append(tuple(window))
                rows = []
                stops = np.flatnonzero(in_words(data, offsets) | IS_SPACE[data]) if windows else ()
                for k, near in windows.items():
                    head = np.cumsum((data[offsets[k] : offsets[k + 1]] & 0xC0) != 0x80)
                    for t, s, e, shared in scanner.find(h[bounds[k] : bounds[k + 1]], near):
                        a, b = starts[word[k] + s], ends[word[k] + e - 1]
                        before, after = np.searchsorted(stops, (a, b))
                        a = max(stops[before - 1] + 1 if before else 0, offsets[k]) - offsets[k]
                        b = min(stops[after] if after < len(stops) else len(data), offsets[k + 1]) - offsets[k]
                        rows.append((first + k, scanner.names[t], int(head[a]) - 1, int(head[b - 1]), shared, len(scanner.sets[t])))
                if rows:
                    of, name, *numbers = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(name), *(pa.array(x, pa.int64()) for x in numbers)], schema.names)

    return picked.mapInArrow(run, schema).withColumnRenamed("doc_id", doc_id)
