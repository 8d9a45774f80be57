import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import wayfare.llm.near as near
from wayfare.llm._common import Words
from wayfare.llm.near import choose_bands, keep_one, link_matrix, near_classes


def grams(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))
    links = Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][1] is None or rows[b][1] is None:
                continue
            common = len(sets[a] & sets[b])
            if rows[a][1] == rows[b][1] or (common and common >= threshold * len(sets[a] | sets[b]) - 1e-9):
                links[a] += 1
                links[b] += 1
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    return sorted((rows[i][0], min(least[find(i)]), links[i]) for i in range(len(rows)))


def test_bands():
    for threshold, recall in ((0.8, 0.9995), (0.7, 0.99), (0.9, 0.999)):
        b, r = choose_bands(threshold, recall)
        assert 1 - (1 - threshold**r) ** b >= recall


def test_word_hashes():
    w = Words(pa.array(["a b  a\tb", None, "", "b", "ab é"]))
    assert w.count.tolist() == [4, 0, 0, 1, 2] and w.row.tolist() == [0, 0, 0, 0, 3, 4, 4]
    h = w.hash
    assert h[0] == h[2] and h[1] == h[3] == h[4] and len(set(h.tolist())) == 4
    g, row, runs = w.windows(3)
    assert runs.tolist() == [2, 0, 0, 1, 1] and row.tolist() == [0, 0, 3, 4]


def test_against_brute_force(make, prose):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        words = prose(rng, rng.randint(5, 150)).split()
        rows.append((len(rows) + 1, " ".join(words)))
        for _ in range(rng.choice((0, 0, 1, 3))):  # edits of between none and a fifth of the words
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = "zz"
            rows.append((len(rows) + 1, " ".join(copy)))
    rows += [(900, ""), (901, ""), (902, None), (903, None), (904, "one two"), (905, "one two"), (906, "one two three")]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_classes(make(rows)).collect())
    assert got == brute(rows)


def test_a_group_in_many_blocks(make, prose, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_TEXTS", 4)
    rng = random.Random(6)
    base = prose(rng, 100).split()
    rows = []
    for i in range(40):
        copy = list(base)
        copy[i] = f"edit{i % 30}"
        rows.append((i + 1, " ".join(copy)))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near_classes(make(rows)).collect())
    assert got == brute(rows)


def test_recall_on_a_table(spark):
    """All pairs of the table by an inverted index over all n-grams: every link is found, and no other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    sets = [grams(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    common = Counter((a, b) for h in holders.values() for x, a in enumerate(h) for b in h[:x])
    want = Counter()
    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            want[rows[a][0]] += 1
            want[rows[b][0]] += 1
    for i, j in ((i, j) for i in range(len(rows)) for j in range(i) if not sets[i] and not sets[j]):
        if rows[i][1] is not None and rows[i][1] == rows[j][1]:
            want[rows[i][0]] += 1
            want[rows[j][0]] += 1
    got = {r.doc_id: r.n_links for r in near_classes(docs).collect()}
    assert sum(want.values()) > 100
    assert got == {d: want[d] for d, _ in rows}


def test_a_pair_counts_once(make, prose, monkeypatch):
    """Pairs that share some bands and not others, in buckets of several blocks."""
    monkeypatch.setattr(near, "BLOCK_TEXTS", 3)
    rng = random.Random(12)
    base = prose(rng, 200).split()
    rows = []
    for i in range(50):
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(1000)}"
        rows.append((rng.randint(1, 60), " ".join(copy)))
    rows += [(None, rows[0][1]), (None, rows[1][1])]
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in near_classes(make(rows)).collect())
    assert got == Counter((d if d < 10**6 else None, c, n) for d, c, n in brute([(d if d is not None else 10**6, t) for d, t in rows]))


def test_large_input_plans(make, prose, monkeypatch):
    """The same rows where nothing is small enough to be sent whole: hot keys are split from the others."""
    from wayfare.operators import components
    from wayfare.plans import tables

    rng = random.Random(13)
    base = prose(rng, 100).split()
    rows = [(i, " ".join([*base[:50], f"w{i % 40}", *base[51:]])) for i in range(120)] + [(200 + i, prose(rng, 60)) for i in range(30)]
    want = sorted((r.doc_id, r.class_id, r.n_links) for r in near_classes(make(rows)).collect())
    assert want == brute(rows)
    monkeypatch.setattr(tables, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(tables, "small", lambda df, *_: df)
    monkeypatch.setattr(components, "FEW_ROWS", 0)
    monkeypatch.setattr(tables, "HOT_LEAST", 10)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in near_classes(make(rows)).collect()) == want


def test_clashing_columns(make):
    names = ["_id", "_node", "node", "class_id", "n_links", "_least", "key", "n", "bands", "grams"]
    docs = make([(1, "a b c"), (2, "a b c"), (1, "a b c"), (3, "other")]).select("*", *(F.concat(F.lit(f"{n} of "), "doc_id").alias(n) for n in names))
    got = keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, *(r[n] for n in names)) for r in got.collect()) == [(i, *(f"{n} of {i}" for n in names)) for i in (1, 3)]


def test_link_matrix():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)]
    want = np.array([[i != j and len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    assert (link_matrix(sets, 0.5) == want).all()


def test_awkward(awkward, empty, make):
    rows = near_classes(awkward.withColumnRenamed("lang", "node")).collect()
    assert len(rows) == awkward.count()
    kept = keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(kept.select("doc_id").collect(), key=str)
    assert [r.doc_id for r in ids].count(4) == 1
    assert near_classes(empty).count() == 0 and keep_one(empty).count() == 0
    once = keep_one(make([(1, "a b c"), (1, "a b c"), (2, "a b c"), (3, "other")]))
    assert sorted(r.doc_id for r in once.collect()) == [1, 3]
