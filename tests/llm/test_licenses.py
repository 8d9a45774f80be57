import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wayfare.llm._common import NO_WORD, Words
from wayfare.llm.licenses import TEMPLATES, Index, align, find_licenses, op7_license_scan, scan, winnow


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_winnowing_finds_common_runs():
    rng = np.random.default_rng(1)
    for _ in range(100):
        shared = rng.integers(0, 1000, 8).astype(np.uint64)
        a = np.concatenate([rng.integers(1000, 2000, rng.integers(0, 9)).astype(np.uint64), shared])
        b = np.concatenate([shared, rng.integers(2000, 3000, rng.integers(0, 9)).astype(np.uint64)])
        assert set(a[winnow(a)].tolist()) & set(b[winnow(b)].tolist())


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        a = np.array([rng.randrange(4) for _ in range(rng.randint(0, 12))], np.uint64)
        b = np.array([rng.randrange(4) for _ in range(rng.randint(1, 12))], np.uint64)
        matched, first, last = align(a, b, 0, band=20)
        assert matched == lcs(a.tolist(), b.tolist())
        if matched:
            assert lcs(a[first : last + 1].tolist(), b.tolist()) == matched


def test_every_template_with_edits():
    index, rng = Index(TEMPLATES), random.Random(3)
    noise = lambda n: " ".join(rng.choice(["alpha", "beta", "the", "of", "license"]) for _ in range(n))
    for name, template in TEMPLATES.items():
        for edits in range(5):
            words = template.split()
            for _ in range(edits if len(words) > 20 else 0):
                i = rng.randrange(len(words))
                words[i : i + 1] = rng.choice(([], ["zzz"], [words[i], "extra"]))
            w = Words(pa.array([None, f"{noise(20)} é {' '.join(words)} {noise(9)}", "", noise(60)]), NO_WORD, lower=True)
            found = find_licenses(w, index)
            names = [index.names[m[1]] for m in found]  # versions of a license may tie when the edit is the version
            assert name.split("-")[0] in {n.split("-")[0] for n in names} and {m[0] for m in found} == {1}, (name, edits)


def test_spans_and_awkward_rows(spark, make, awkward, empty, tmp_path):
    text = "É ü. Released under the MIT License.\nx y z. All rights reserved. Again: released under the mit license"
    docs = make([(50, text), (51, text)]).unionByName(awkward).withColumn("license", F.lit("clash"))
    got = [r for r in scan(docs).collect() if r.doc_id == 50]
    assert [(r.license, text[r.start : r.end], r.coverage) for r in sorted(got, key=lambda r: r.start)] == [
        ("MIT-notice", "Released under the MIT License", 1.0), ("All-rights-reserved", "All rights reserved", 1.0), ("MIT-notice", "released under the mit license", 1.0),
    ]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in op7_license_scan(spark, str(tmp_path)).collect()} == {50, 51}
    assert scan(empty).count() == 0
    assert scan(docs, {"own": "x y z"}).where("license = 'own'").count() == 2


def test_every_planted_line_and_whole_texts(make):
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-notice",
        "Released under the MIT License.": "MIT-notice",
        "All rights reserved.": "All-rights-reserved",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0-notice",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-notice",
        "Licensed under CC BY-SA 3.0.": "CC-BY-SA-3.0-notice",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0",
        "Licensed under the Mozilla Public License, Version 2.0.": "MPL-2.0-notice",
        "Under the GNU Affero General Public License, version 3.": "AGPL-3.0-notice",
        "Licensed under the BSD 2-Clause License.": "BSD-2-Clause-notice",
    }
    whole = ["MIT-text", "BSD-2-Clause-text", "Apache-2.0-text", "MPL-2.0-text", "GPL-2.0-text", "GPL-3.0-text", "LGPL-2.1-text"]
    docs = make([(i, f"alpha beta\n{line}\ngamma delta") for i, line in enumerate(lines)] + [(100 + i, f"alpha beta\n{TEMPLATES[name]}\ngamma delta") for i, name in enumerate(whole)])
    got = {}
    for r in scan(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert {i: [r.license for r in rows] for i, rows in got.items()} == {**{i: [n] for i, n in enumerate(lines.values())}, **{100 + i: [n] for i, n in enumerate(whole)}}
    for i, name in enumerate(whole):  # from the first word to the last
        r = got[100 + i][0]
        assert r.coverage == 1.0 and r.end - r.start >= len(TEMPLATES[name].strip()) - 10


def test_copies_that_follow_at_once(make):
    rows = [(1, "All rights reserved.\n" * 10), (2, "Released under the MIT License. " * 7), (3, "All rights reserved. " * 2 + "x. Released under the MIT License. All rights reserved.")]
    got = scan(make(rows)).collect()
    assert {i: sum(r.doc_id == i for r in got) for i in (1, 2, 3)} == {1: 10, 2: 7, 3: 4}
    assert {dict(rows)[r.doc_id][r.start : r.end] for r in got} == {"All rights reserved", "Released under the MIT License"}


def brute_matches(text, templates, coverage):
    """Every template aligned at every shift; the best alignment first, then again in what is left."""
    out = []
    for t, own in enumerate(templates):
        left = text.copy()
        while True:
            best = max((align(left, own, s) for s in range(-len(own), len(text) + 1)), key=lambda m: (m[0], -(m[2] - m[1]), -m[1]))
            if not best[0] or best[0] / len(own) < coverage:
                break
            out.append((t, best[1], best[2], best[0] / len(own)))
            left[best[1] : best[2] + 1] = 0
    out.sort(key=lambda m: (-m[3] * len(templates[m[0]]), -m[3], m[1], m[0]))
    used, clear = np.zeros(len(text), bool), []
    for m in out:
        if not used[m[1] : m[2] + 1].any():
            used[m[1] : m[2] + 1] = True
            clear.append(m)
    return sorted(clear, key=lambda m: (m[1], m[0]))


def test_scan_against_all_alignments(spark, make):
    """Planted whole and edited templates among chance words: the scan's rows are those of brute force."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    templates = {f"t{k}": " ".join(word() for _ in range(n)) for k, n in enumerate((4, 6, 12, 25, 40))}
    templates["t5"] = " ".join(templates["t3"].split()[:15] + [word() for _ in range(10)])  # shares its beginning with another
    rows = []
    for i in range(25):
        parts = []
        for _ in range(rng.randint(0, 3)):
            parts.append(" ".join(word() for _ in range(rng.randint(0, 30))))
            planted = rng.choice(list(templates.values())).split()
            if len(planted) > 10:
                for _ in range(rng.randint(0, len(planted) // 8)):
                    planted[rng.randrange(len(planted))] = word()
            parts.append(" ".join(planted))
        rows.append((i, " ".join(parts + [" ".join(word() for _ in range(rng.randint(0, 20)))])))
    got = sorted((r.doc_id, r.license, r.start, r.end, round(r.coverage, 9)) for r in scan(make(rows), templates).collect())
    index = Index(templates)
    want = []
    for i, text in rows:
        words = Words(pa.array([text]), NO_WORD, lower=True)
        for t, a, b, c in brute_matches(words.hash, index.words, 0.6):
            want.append((i, index.names[t], int(words.start[a]), int(words.end[b]), round(c, 9)))
    assert len(want) > 20 and got == sorted(want)
