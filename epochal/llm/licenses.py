"""License notices in texts: winnowed fingerprints, then banded alignment.

Templates are few and fixed, so their inverted index of fingerprints goes with
the tasks; documents are scanned where they lie, without a shuffle. Words are
runs of letters and digits, in any case. Fingerprints are the least hash of
each window of three 3-word grams, so five words in common always share one. A
fingerprint that both have proposes a place for the template; a local alignment
in a band around its diagonal then says how many of the template's words are
there and where. A place with ``least`` of the template's words is a full notice;
one with fewer, but ``least_words``, is a partial one, such as half a header or a
notice that the templates lack but share much text with. Of overlapping places a full
one stays before a partial one, then the one with more matched words (then the greater
coverage, then the first name).

A row per document row; null and empty texts have no spans; texts may have any
length; extra columns are ignored. Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_column, hash_words, shingle_hashes, table

WORD = re.compile(r"[^\W_]+")
# Public license notices, as (name, text).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def winnow(hashes: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the fingerprints of a sequence of word hashes."""
    if len(hashes) < gram:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = shingle_hashes(hashes, gram)
    if len(g) <= window:
        at = np.array([len(g) - 1 - int(np.argmin(g[::-1]))])
    else:
        view = np.lib.stride_tricks.sliding_window_view(g, window)
        at = np.unique(np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], 1))
    return at, g[at]


def align(doc: list, tpl: list, shift: int, band: int) -> tuple[int, int, int] | None:
    """Best local alignment with doc - template position within ``band`` of
    ``shift``: (first doc word, end, matched words); a match is worth 2, a
    mismatch or a gap costs 1."""
    best, row = (0, 0, 0, 0), {}
    none = (0, 0, 0, 0)
    for j, word in enumerate(tpl):
        new: dict[int, tuple] = {}
        for i in range(max(0, j + shift - band), min(len(doc), j + shift + band + 1)):
            s, start, m, _ = row.get(i - 1, none)
            same = doc[i] == word
            options = [(s + 2, start if s else i, m + 1, i + 1) if same else (s - 1, start, m, i + 1)]
            if i in row:
                options.append((row[i][0] - 1, *row[i][1:3], i + 1))
            if i - 1 in new:
                options.append((new[i - 1][0] - 1, *new[i - 1][1:3], i + 1))
            cell = max(options, key=lambda x: (x[0], -x[1]))
            if cell[0] > 0:
                new[i] = cell
                if same and cell[0] > best[0]:
                    best = cell
        row = new
    return (best[1], best[3], best[2]) if best[0] else None


class Scanner:
    def __init__(self, templates, gram: int, window: int, band: int, least: float, least_words: int = 20):
        self.gram, self.window, self.band, self.least, self.least_words, self.memo = gram, window, band, least, least_words, {}
        self.names = [n for n, _ in templates]
        self.words = [WORD.findall(t.lower()) for _, t in templates]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            for at, value in zip(*map(np.ndarray.tolist, winnow(self.hashes(words), gram, window)), strict=True):
                self.index.setdefault(value, []).append((k, at))
        self.known = np.array(sorted(self.index), np.uint64)

    def hashes(self, words: list[str]) -> np.ndarray:
        return hash_words([w.encode("utf-8", "replace") for w in words], self.memo)

    def spans(self, text: str) -> list[tuple[int, int, str, int, float, bool]]:
        """(start, end, license, matched words, coverage, full), in order."""
        low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        words = WORD.findall(low)
        at, values = winnow(self.hashes(words), self.gram, self.window)
        shared = np.flatnonzero(np.isin(values, self.known)) if len(values) else ()
        places: set[tuple[int, int]] = set()
        for x in shared:
            for k, own in self.index[int(values[x])]:
                places.add((k, int(at[x]) - own))
        found, last = [], {}
        for k, shift in sorted(places):
            band = min(self.band, len(self.words[k]) // 5)  # two notices in a row stay apart
            if k in last and shift - last[k] <= band // 2:
                continue
            last[k] = shift
            lo = max(0, shift - band)
            part = words[lo : shift + len(self.words[k]) + band]
            hit = align(part, self.words[k], shift - lo, band)
            full = bool(hit) and hit[2] >= self.least * len(self.words[k])
            if full or hit and hit[2] >= self.least_words:
                found.append((hit[2], hit[2] / len(self.words[k]), self.names[k], lo + hit[0], lo + hit[1], full))
        kept: list[tuple] = []
        for f in sorted(found, key=lambda f: (not f[5], -f[0], -f[1], f[2], f[3])):
            if all(f[4] <= g[3] or f[3] >= g[4] for g in kept):
                kept.append(f)
        if not kept:
            return []
        place = [m.span() for m in WORD.finditer(low)]
        return sorted((place[a][0], place[b - 1][1], name, m, c, full) for m, c, name, a, b, full in kept)


def license_spans(docs: DataFrame, templates=TEMPLATES, gram: int = 3, window: int = 3, band: int = 8, least: float = 0.8, least_words: int = 20) -> DataFrame:
    """doc_id and its spans: license, start, end, matched words, coverage of the template,
    and whether the notice is full."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("matched", pa.int64()), ("coverage", pa.float64()), ("full", pa.bool_())]))

    def run(batches):
        scanner = Scanner(templates, gram, window, band, least, least_words)
        for batch in batches:
            rows = [[dict(zip(("start", "end", "license", "matched", "coverage", "full"), s, strict=True)) for s in scanner.spans(t.decode("utf-8", "replace"))] for t in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(rows, kind)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<start:long,end:long,license:string,matched:long,coverage:double,full:boolean>>")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda full: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(F.filter("spans", lambda s: s["full"] == full), lambda s: s["license"]))))
    listed = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["license"], s["start"], s["end"])))
    return license_spans(table(spark, sf_dir, "documents")).select("doc_id", F.size("spans").cast("long").alias("n_spans"), named(True).alias("licenses"), named(False).alias("partial"), F.array_max("spans.coverage").alias("coverage"), F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["matched"]).alias("matched_words"), listed.alias("spans"))
