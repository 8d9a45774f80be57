import random

import numpy as np
from pyspark.sql import functions as F

import wayfare.llm.langid as langid
from wayfare.llm.langid import fit, held_out, identified, op9_string_kernel_langid, predict, presence, train


def test_accuracy_and_awkward_rows(spark, make, prose, awkward, tmp_path):
    rng = random.Random(3)
    langs = ["en", "de", "fr"]
    rows = [(100 + i, prose(rng, rng.randint(5, 80), langs[i % 3]), langs[i % 3], "s") for i in range(240)]
    docs = make(rows).unionByName(awkward).withColumn("lang_pred", F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op9_string_kernel_langid(spark, str(tmp_path)).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 100}
    right = [by[i].lang_pred == lang for i, _, lang, _ in rows if by[i].held_out]
    assert len(right) > 30 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    und = {r.doc_id for r in got if r.lang_pred == "und"}
    assert {1, 2, 3, 9, 10} <= und and 8 not in und
    kept = identified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 2, 3)").count() == 0
    assert {r.lang_pred for r in kept.select("lang_pred").collect()} == {"clash"}


def test_nothing_held_out_is_learned(make, prose):
    rng = random.Random(1)
    docs = make([(i, prose(rng, 30), "en" if i % 2 else "de") for i in range(40)])
    flipped = docs.withColumn("lang", F.when(held_out(), F.lit("xx")).otherwise(F.col("lang")))
    a, b = train(docs), train(flipped)
    assert a[0] == b[0] and all(np.array_equal(x, y) for x, y in zip(a[1], b[1]))


def test_folded_matrix_is_the_kernel_machine():
    """Scores by the folded matrix equal kernel ridge regression through the landmarks."""
    import pyarrow as pa

    rng = random.Random(2)
    texts = ["".join(rng.choice("abc d") for _ in range(60)) for _ in range(12)]
    langs = ["p" if i % 2 else "q" for i in range(12)]
    x = presence(pa.array(texts))
    names, (matrix,) = fit(np.packbits(x, axis=1), langs, landmarks=12, ridge=1e-3)
    u = x / np.sqrt(x.sum(axis=1, keepdims=True))
    kernel = u @ u.T
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for lang in langs])
    want = kernel @ np.linalg.solve(kernel + 1e-3 * 12 * np.eye(12), y)  # all points are landmarks
    assert np.allclose(u @ matrix, want, atol=1e-3)


def _dense(rng, n, languages):
    import pyarrow as pa

    langs = [f"l{i % languages:03d}" for i in range(n)]
    letters = {name: [chr(97 + rng.randrange(26)) * rng.randint(1, 2) + chr(97 + rng.randrange(26)) for _ in range(6)] for name in sorted(set(langs))}
    return presence(pa.array([" ".join(rng.choice(letters[lang]) + rng.choice(letters[lang]) for _ in range(40)) for lang in langs])), langs


def test_fewer_landmarks_than_rows():
    """Nystrom features written out: kernel with the landmarks times the root of the landmarks' own inverse."""
    rng = random.Random(7)
    x, langs = _dense(rng, 30, 3)
    names, (matrix,) = fit(np.packbits(x, axis=1), langs, landmarks=9, ridge=1e-3)
    u = x / np.sqrt(x.sum(axis=1, keepdims=True))
    marks = u[[i for i in range(30) if sum(langs[j] == langs[i] for j in range(i)) < 3]]  # the first three of each language
    value, vector = np.linalg.eigh(marks @ marks.T)
    z = u @ marks.T @ vector @ np.diag(value**-0.5)
    y = np.array([[1.0 if lang == n else -1.0 for n in names] for lang in langs])
    want = z @ np.linalg.solve(z.T @ z + 1e-3 * 30 * np.eye(9), z.T @ y)
    assert np.allclose(u @ matrix, want, atol=1e-3)


def test_more_languages_than_directions():
    """Two matrices then; every language can be predicted, and the values are those of their product."""
    rng = random.Random(9)
    x, langs = _dense(rng, 600, 300)
    names, matrices = fit(np.packbits(x, axis=1), langs, landmarks=256)
    assert len(names) == 300 and len(matrices) == 2 and matrices[1].shape[1] == 300
    u = x / np.sqrt(x.sum(axis=1, keepdims=True))
    f = u @ matrices[0] @ matrices[1]
    assert np.mean([names[i] == lang for i, lang in zip(f.argmax(axis=1), langs)]) > 0.8
    assert len({names[i] for i in f.argmax(axis=1)}) > 250


def test_the_stage_follows_the_model(make, prose, monkeypatch):
    """Other predictions give another output: languages are replaced, texts that fit none go."""
    rng = random.Random(4)
    docs = make([(i, prose(rng, 40, "en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(60)] + [(100, prose(rng, 40, "de"), "en"), (101, prose(rng, 40, "en"), None)])
    got = {r.doc_id: r.lang for r in identified(docs).collect()}
    assert got == {i: "en" if i % 2 else "de" for i in range(60)} | {100: "de", 101: "en"}
    names, matrices = train(docs)
    monkeypatch.setattr(langid, "train", lambda d: (names, [-m for m in matrices]))
    swapped = {r.doc_id: r.lang for r in identified(docs).collect()}
    assert swapped[1] == "de" and swapped[2] == "en"
    monkeypatch.setattr(langid, "train", lambda d: (names, [m * 0 for m in matrices]))
    monkeypatch.setattr(langid, "LEAST_SCORE", 0.6)
    assert identified(docs).count() == 0


def test_every_language_is_sampled(make, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 5)
    docs = make([(i, f"{chr(97 + i % 20)}{chr(97 + i % 20)} word{chr(97 + i % 20)}", f"l{i % 20:02d}") for i in range(200)])
    assert train(docs)[0] == [f"l{i:02d}" for i in range(20)]


def test_presence():
    import pyarrow as pa

    a = presence(pa.array(["Ab 12 c", "ab--c", None, ""]))
    assert (a[0] == a[1]).all() and a[2].sum() == a[3].sum() == 0


def test_empty(make, empty):
    assert train(empty)[0] == []
    assert identified(empty).count() == 0
    only = make([(1, "abc", None)])
    assert predict(only, train(only), "doc_id").first().lang_pred == "und"


def test_clashing_columns(make, prose):
    rng = random.Random(1)
    names = ["lang_pred", "score", "fits", "_pred", "_score", "_fits", "_text", "_known", "_id", "_lang", "_group", "_size", "n"]
    docs = make([(i, prose(rng, 30, "en" if i % 2 else "de"), "en" if i % 2 else "de") for i in range(40)]).select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    got = identified(docs)
    assert got.columns == docs.columns and got.count() == 40
    assert all(getattr(r, n) == f"own {n}" for r in got.collect() for n in names)
