"""License scans: winnowed fingerprints pick candidates, banded alignment reports spans.

Texts and templates become words: lower case, runs of letters and digits. Hashes of
``K`` words in a row are winnowed (the least of every ``WINDOW`` neighbours is kept), so
that any common run of ``K + WINDOW - 1`` words shares a fingerprint. The templates'
fingerprints are an inverted index: hash to (template, place). Templates shorter than
such a run keep all their hashes, so that a whole copy is always found.

In a text, the diagonals of a template's hits (place in text minus place in template)
are candidates, those with most hits nearby first. The candidate's window is aligned with
the template, word by word, in a band around the diagonal; matched words give the
coverage (matched / template words), the first and last of them the span. A match is
reported from ``COVERAGE`` on, and its words are taken out of the text; hits in what is
left are tried on, so several copies in one text are separate matches, however close.

Defined results: null, empty and clean texts have no rows; texts of any length are
scanned whole; repeated rows have their matches each; of matches that overlap in a text
the one of most words stays, then of most coverage, then the first; other columns of any
name are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pkgutil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import NO_WORD, Words, slices, texts

K, WINDOW, BAND, COVERAGE = 3, 4, 8, 0.6

#: Texts that projects put into their files to name a license; fixed values, taken from the licenses' own instructions.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "GNU General Public License, version 3.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "All-rights-reserved": "All rights reserved.",
    "GPL-2.0-notice": "GNU General Public License, version 2.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-notice": "GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "GNU Affero General Public License, version 3.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "EPL-2.0-notice": "Licensed under the Eclipse Public License, Version 2.0.",
    "BSD-2-Clause-notice": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "CC0-1.0-notice": "Licensed under CC0 1.0.",
}

_BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES |= {
    "MIT-text": TEMPLATES["MIT"] + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": TEMPLATES["ISC"] + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": _BSD_CONDITIONS,
    "BSD-2-Clause-text": f"{_BSD_CONDITIONS} {_BSD_DISCLAIMER}",
    "BSD-3-Clause-text": f"{TEMPLATES['BSD-3-Clause']} {_BSD_DISCLAIMER}",
}
#: The Creative Commons licenses of each version, by their short and their long names.
CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
for _version, _port in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
    for _short, _long in CC.items():
        TEMPLATES[f"CC-{_short}-{_version}"] = f"This work is licensed under a Creative Commons {_long} {_version} {_port} License."
        TEMPLATES[f"CC-{_short}-{_version}-notice"] = f"Licensed under CC {_short} {_version}."
#: Whole licenses, in files of the package.
WHOLE = ("Apache-2.0", "Artistic-1.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0")
for _name in WHOLE:
    TEMPLATES[f"{_name}-text"] = pkgutil.get_data(__package__, f"license_texts/{_name}.txt").decode()


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places kept: the rightmost least hash of each run of ``window`` hashes, all of a shorter run."""
    n = len(hashes)
    if n <= window:
        return np.arange(n)
    runs = np.lib.stride_tricks.sliding_window_view(hashes, window)[:, ::-1]
    return np.unique(np.arange(n - window + 1) + window - 1 - runs.argmin(axis=1))


class Index:
    """Inverted index of the templates' fingerprints; bounded by the templates given."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        words = Words(pa.array(list(templates.values())), NO_WORD, lower=True)
        self.words = [words.hash[a : a + c] for a, c in zip(words.first, words.count)]
        hashes, row, _ = words.windows(K)
        found: list[tuple[int, int, int]] = []
        for t in range(len(self.names)):
            own = hashes[row == t]
            keep = winnow(own) if len(own) > 2 * WINDOW else np.arange(len(own))
            found += [(int(own[p]), t, int(p)) for p in keep]
        found.sort()
        self.keys = np.array([f[0] for f in found], np.uint64)
        self.template = np.array([f[1] for f in found])
        self.place = np.array([f[2] for f in found])

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the given hashes, entry of the index), every pair of equal hashes."""
        low = np.searchsorted(self.keys, hashes, "left")
        count = np.searchsorted(self.keys, hashes, "right") - low
        at = np.repeat(np.arange(len(hashes)), count)
        entry = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        return at, entry


def align(text: np.ndarray, template: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """Most words matched in order with |i - j - shift| <= band, and the first and last text word of them.

    Banded longest common subsequence: one row for each template word, as wide as the
    band. Of alignments with as many matches, the shortest span wins, then the first.
    """
    n, width = len(text), 2 * band + 1
    # state: (matches, -span) packed as matches * BIG - span so far; begins as a new match
    none = (0, 0, 0, 0)  # matches, -(span), -first, last
    before = [none] * (width + 1)
    best = none
    for j, w in enumerate(template):
        row = [none] * (width + 1)
        for b in range(width):
            i = j + shift + b - band
            # up: the template word is skipped (same i, one column right in the row before); left: the text word is skipped
            cell = max(before[b + 1], row[b - 1] if b else none)
            if 0 <= i < n and text[i] == w:
                m, _, first, _ = before[b]
                first = first if m else -i
                hit = (m + 1, -(i + first), first, i)
                cell = max(cell, hit)
            row[b] = cell
        best = max(best, max(row))
        before = row
    return best[0], -best[2], best[3]


def most_matches(text: np.ndarray, template: np.ndarray, shift: int, band: int = BAND) -> int:
    """Template words that stand in the text within the band: ``align`` matches no more."""
    near = np.zeros(len(text) + len(template) + 2 * abs(shift) + 4 * band, np.uint64)
    pad = abs(shift) + band
    near[pad : pad + len(text)] = text
    found = np.zeros(len(template), bool)
    for d in range(-band, band + 1):
        found |= near[pad + shift + d : pad + shift + d + len(template)] == template
    return int(found.sum())


def find_licenses(words: Words, index: Index, coverage: float = COVERAGE) -> list[tuple[int, int, int, int, float]]:
    """(row, template, first word, last word, coverage) of each match in a slice's words."""
    hashes, row, runs = words.windows(K)
    kept = _winnow_rows(hashes, row)
    at, entry = index.hits(hashes)
    # all hashes of a text meet the index where a template is short; else winnowed ones do
    short = np.array([len(w) - K + 1 <= 2 * WINDOW for w in index.words])
    good = kept[at] | short[index.template[entry]]
    at, entry = at[good], entry[good]
    first_hash = np.cumsum(runs) - runs
    place = at - first_hash[row[at]]  # word place in its text
    template, shift = index.template[entry], place - index.place[entry]
    order = np.lexsort((place, shift, template, row[at]))
    group = np.flatnonzero(np.diff(row[at][order] * len(index.words) + template[order], prepend=-1))
    out = []
    for mine in np.split(order, group[1:]) if len(order) else []:
        r, t = int(row[at[mine[0]]]), int(template[mine[0]])
        own, a = index.words[t], words.first[r]
        text = words.hash[a : a + words.count[r]].copy()
        free = np.ones(len(text), bool)
        s, p = shift[mine], place[mine]
        support = np.searchsorted(s, s + BAND, "right") - np.searchsorted(s, s - BAND, "left")
        failed = set()  # what is taken out of a text later makes no shift better
        for o in np.lexsort((p, s, -support)):  # the diagonals of most hits first
            at_shift, at_place = int(s[o]), int(p[o])
            while at_shift not in failed and free[at_place : at_place + K].all():
                lo, hi = max(0, at_shift - BAND), min(len(text), at_shift + len(own) + BAND)
                matched = 0
                if most_matches(text[lo:hi], own, at_shift - lo) >= coverage * len(own):
                    matched, i, j = align(text[lo:hi], own, at_shift - lo)
                if not matched or matched / len(own) < coverage:
                    failed.add(at_shift)
                    break
                out.append((r, t, lo + i, lo + j, matched / len(own)))
                # the text left is searched on: another copy may follow at once
                text[lo + i : lo + j + 1] = 0
                free[lo + i : lo + j + 1] = False
    # of overlapping matches in a text the one of most words, then of most coverage, then the first
    out.sort(key=lambda m: (m[0], -m[4] * len(index.words[m[1]]), -m[4], m[2], m[1]))
    clear: list[tuple] = []
    taken: dict[int, np.ndarray] = {}
    for m in out:
        used = taken.setdefault(m[0], np.zeros(words.count[m[0]], bool))
        if not used[m[2] : m[3] + 1].any():
            used[m[2] : m[3] + 1] = True
            clear.append(m)
    return sorted(clear, key=lambda m: (m[0], m[2], m[1]))


def _winnow_rows(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which hashes winnowing keeps, each row by itself."""
    n = len(hashes)
    kept = np.zeros(n, bool)
    if n >= WINDOW:
        runs = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
        least = runs[:, ::-1].argmin(axis=1)
        starts = np.arange(n - WINDOW + 1)
        same = row[starts] == row[starts + WINDOW - 1]
        kept[(starts + WINDOW - 1 - least)[same]] = True
    counts = np.bincount(row, minlength=int(row[-1]) + 1 if n else 0)
    return kept | (counts[row] < WINDOW)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per match: doc_id, license, start, end (code points, end exclusive), coverage."""
    templates = templates or TEMPLATES

    def run(batches):
        index = Index(templates)
        schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())])
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column(1), NO_WORD, lower=True)
                rows = []
                for r, t, i, j, c in find_licenses(words, index, coverage):
                    a = words.first[r]
                    begin = words.bounds[r]
                    chars = lambda byte: len(words.raw[begin:byte].tobytes().decode())  # noqa: B023, E731
                    rows.append((part.column(0)[r].as_py(), index.names[t], chars(words.start[a + i]), chars(words.end[a + j]), c))
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    narrow = texts(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, license string, start int, end int, coverage double")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license match in all documents."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("coverage", F.round("coverage", 6))
