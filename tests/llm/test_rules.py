import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from wayfare.llm.rules import CUTOFFS, RULES, apply_rules, cutoffs, measures, op10_risk_controlled_rules


def brute(text):
    x = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", x)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [a for a in x.split("\n") if re.search(r"[^\x20\x09-\x0D]", a)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_measures(make, awkward):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a ", "b ", "c ", "a\n", "#", "|x ", "é\t", "\n", " "]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    docs = make(list(enumerate(texts))).unionByName(awkward.withColumn("doc_id", F.coalesce("doc_id", F.lit(0)) + 1000))
    # repeated ids have their rows each
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in measures(docs, "doc_id").collect())
    assert got == Counter((r.doc_id, *brute(r.text)) for r in docs.collect())


def _labelled(make, prose, n=400, bad=0.3):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() > bad
        words = [w + ("" if good else "##") for w in prose(rng, 80).split()]
        rows.append((i, " ".join(words), "en" if i % 4 else None))
        labels.append((i, int(good), 0))
    return make(rows), labels


def test_cutoffs_hold_the_bound(spark, make, prose):
    docs, labels = _labelled(make, prose)
    frame = spark.createDataFrame([*labels, (5000, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    alpha, delta = 0.2, 0.1
    m = measures(docs, "doc_id", "lang").cache()
    got = {r.stratum: r for r in cutoffs(m, frame, alpha, delta).collect()}
    assert set(got) == {"en", None}
    quality = {i: q for i, q, _ in labels}
    rows = [r for r in m.collect() if not r.base_failed]
    for stratum in got:
        mine = [r for r in rows if r.lang == stratum]
        good = [r for r in mine if quality[r.doc_id] == 1]
        for rule in RULES:
            allowed, best = [], None
            for c in CUTOFFS:
                k, n = sum(r[rule] > c for r in good), len(good)
                a = alpha / len(RULES)
                p = 1.0 if k >= a * n else sum(math.comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1))
                if p > delta / (2 * len(RULES)):
                    break
                allowed.append(c)
            if allowed:
                gain = lambda c: sum(r[rule] > c for r in mine if quality[r.doc_id] == 0) - 3 * sum(r[rule] > c for r in good)  # noqa: B023, E731
                best = max(allowed, key=lambda c: (gain(c), c))
            assert got[stratum][f"max_{rule}"] == best
    verdicts = {r.doc_id: r.kept for r in apply_rules(docs, frame, alpha, delta).collect()}
    assert all(not verdicts[i] for i, q, _ in labels if q == 0 and i % 4) and all(verdicts[r.doc_id] for r in rows if quality[r.doc_id] == 1)


def test_few_or_no_labels_reject_nothing_more(spark, make, prose, awkward, empty):
    docs, labels = _labelled(make, prose, 30)
    few = spark.createDataFrame(labels[:5], "doc_id bigint, quality int, toxic int")
    assert all(r.kept == (not r.base_failed) for r in apply_rules(docs, few).collect())
    none = few.limit(0)
    assert all(r.kept == (not r.base_failed) for r in apply_rules(awkward, none).collect())
    assert apply_rules(empty, few).count() == 0


def test_query(spark, make, prose, tmp_path):
    docs, labels = _labelled(make, prose, 60)
    docs.withColumn("kept", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = op10_risk_controlled_rules(spark, str(tmp_path))
    assert got.count() == 60 and {"doc_id", "n_words", "base_failed", "kept"} <= set(got.columns)
