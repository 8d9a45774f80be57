import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import wayfare.llm.decontam as D
from wayfare.llm._common import NO_WORD, Words
from wayfare.llm.decontam import Search, build_space, candidates, checked, contamination, document_frequencies, keep_uncontaminated, lcs, op6_latent_decontamination, randomised_svd, weights_of


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(1, 80)).astype(np.uint64) for _ in range(2))
        assert lcs(a, b) == slow_lcs(a.tolist(), b.tolist())


def test_svd(spark):
    rng = np.random.default_rng(1)
    a = (rng.standard_normal((60, 5)) @ rng.standard_normal((5, 40))).astype(float)  # rank 5
    rows = spark.createDataFrame([(list(range(40)), r.tolist()) for r in a], "idx array<int>, w array<double>").repartition(3)
    basis = randomised_svd(rows, [], 40, 5)
    assert np.allclose(a @ basis @ basis.T, a, atol=1e-2)


def corpus(make, prose):
    rng = random.Random(9)
    stops, prose = prose, lambda r, n: " ".join(w if r.random() < 0.4 else w + stops(r, 1) for w in stops(r, n).split())  # noqa: E731  as rich as written language: few words are common, most are rare
    items = [(i, prose(rng, rng.randint(13, 70))) for i in range(30)]
    rows, truth = [], set()
    for d in range(240):
        words = prose(rng, rng.randint(40, 400)).split()
        if d % 4 == 0:
            item, text = items[rng.randrange(30)]
            copy = text.split()
            if d % 8 == 0:  # a paraphrase that keeps five words in six
                copy = [w for i, w in enumerate(copy) if i % 6 != 3]
            at = rng.randrange(len(words))
            words[at:at] = copy
            truth.add((d, item))
        rows.append((d, " ".join(words)))
    return make(rows), items, truth


def test_finds_copies_and_paraphrases(spark, make, prose, tmp_path):
    docs, items, truth = corpus(make, prose)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs.withColumn("cosine", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in op6_latent_decontamination(spark, str(tmp_path)).collect()}
    assert len(truth & got) >= 0.95 * len(truth) and got <= truth
    kept = {r.doc_id for r in keep_uncontaminated(docs, bench).collect()}
    assert kept == {d for d in range(240)} - {d for d, _ in got}


def test_candidate_recall_against_brute_force(make, prose):
    """Windows whose exact TF-IDF cosine is well above the cutoff are found in the latent space."""
    docs, items, _ = corpus(make, prose)
    n, df = document_frequencies(docs, D.runs_of(items))
    space = build_space(docs, [(i, t, None) for i, t in items], weights_of(n, df))
    words = Words(pa.array([r.text for r in docs.collect()]), NO_WORD, lower=True)
    found = {(p, a, b) for _, p, a, b, _ in candidates(words, space)}
    want = set()
    passages = [p for _, w, _ in space.items for p in D._passages(w)]
    weight, place = space.weights(words.hash).astype(float), space.places(words.hash)
    for p, passage in enumerate(passages):
        i, x = D._tfidf(passage, space)
        q = np.zeros(len(space.vocabulary))
        q[i] = x
        size = D.SCALES[space.passage_scale[p]]
        for r in range(len(words.first)):
            stop = words.first[r] + words.count[r]
            for a in range(words.first[r], max(words.first[r] + 1, stop - size + D.STEP), D.STEP):
                b = min(a + size, stop)
                good = place[a:b] >= 0
                cos = (weight[a:b][good] * q[place[a:b][good]]).sum() / np.sqrt((weight[a:b] ** 2).sum())
                if cos >= D.COSINE + 0.05:
                    want.add((p, a, b))
    assert len(want) > 30 and len(want & found) >= 0.9 * len(want)


def test_a_full_block_of_long_items_keeps_its_passages(make, prose):
    """More passages than the space's rank: verbatim copies stay well above the cutoff."""
    rng = random.Random(12)
    items = [(i, " ".join(prose(rng, 1) + prose(rng, 1) for _ in range(rng.randint(80, 150))), None) for i in range(24)]
    docs = make([(i, f"{prose(rng, 20)} {t} {prose(rng, 20)}") for i, t, _ in items] + [(50 + i, prose(rng, 90)) for i in range(20)])
    n, df = document_frequencies(docs, D.runs_of(items))
    space = build_space(docs, items, weights_of(n, df), rank=16)
    passages = [p for _, w, _ in space.items for p in D._passages(w)]
    assert len(passages) > 48
    for p in passages:
        i, x = D._tfidf(p, space)
        assert np.linalg.norm(x @ space.basis[i]) > 0.98
    words = Words(pa.array([t for _, t, _ in items]), NO_WORD, lower=True)
    found = {(r, p) for r, p, *_ in candidates(words, space, cosine=0.8)}
    assert {(int(k), p) for p, k in enumerate(space.passage_item)} <= found


def test_blocks_are_bounded_by_passages(spark, make, prose, monkeypatch):
    rng, blocks = random.Random(13), []
    items = [(i, prose(rng, 150)) for i in range(12)]
    build = D.build_space
    monkeypatch.setattr(D, "build_space", lambda docs, items, *a: blocks.append(len(items)) or build(docs, items, *a))
    docs = make([(i, t) for i, t in items[:5]])
    got = contamination(docs, spark.createDataFrame(items, "item_id bigint, text string"), rank=16).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(5)}
    assert len(blocks) == 3 and sum(blocks) == 12  # 48 passages


def test_short_items_and_common_words_copied_verbatim(spark, make, prose):
    rng = random.Random(21)
    common = "the of and to in is that it was for".split()
    items = [(i, " ".join(rng.choice(common) for _ in range(k))) for i, k in enumerate((6, 8, 9, 12, 7))]
    items += [(10 + k, prose(rng, k)) for k in range(5, 12)] + [(30, "今天天气很好我们去公园散步")]
    filler = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else prose(rng, 1) for _ in range(n))
    rows = [(i, f"{filler(60)} {t} {filler(60)}") for i, t in items[:-1]] + [(30, "早上好。" + items[-1][1] + "再见了。")]
    got = contamination(make(rows + [(100 + i, filler(90)) for i in range(60)]), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(i, i) for i, _ in items} <= {(r.doc_id, r.item_id) for r in got}
    assert all(r.coverage == 1.0 for r in got if r.doc_id == r.item_id)


def test_document_frequencies(make):
    n, df = document_frequencies(make([(1, "a b a"), (2, "a c"), (3, None), (4, "")]))
    h = Words(pa.array(["a b c"]), NO_WORD, lower=True).hash
    assert n == 2 and df[D._bin(h)].tolist() == [2, 1, 1]


def test_an_item_in_a_third_of_the_documents(spark, make, prose):
    rng = random.Random(7)
    items = [(i, " ".join(prose(rng, 1) + prose(rng, 1) for _ in range(25))) for i in range(4)]
    rows = [(d, prose(rng, 60) + " " + (items[1][1] if d % 3 == 0 else prose(rng, 9)) + " " + prose(rng, 30)) for d in range(150)]
    got = {(r.doc_id, r.item_id) for r in contamination(make(rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == {(d, 1) for d in range(0, 150, 3)}


def test_blocks_and_answers(spark, make, prose, monkeypatch):
    monkeypatch.setattr(D, "ITEMS_PER_BLOCK", 2)
    rng = random.Random(4)
    items = [(i, prose(rng, 20), prose(rng, 4)) for i in range(5)] + [(7, None, None), (8, "too short", None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string, answer string")
    rows = [(i, f"{prose(rng, 15)} {t} {prose(rng, 9)} {a}") for i, t, a in items[:5]] + [(20 + i, prose(rng, 90)) for i in range(20)]
    got = contamination(make(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(5)}


def test_every_window_is_asked_for_the_answer(make):
    """A place of more coverage without the answer doesn't hide one of less that has it."""
    own = [f"w{i}" for i in range(40)]
    more, less = " ".join(own[:24]), " ".join(own[:14] + own[32:])  # coverage 0.6, and 0.55 with the last words
    docs = make([(1, "x"), (2, "y z")])
    space = build_space(docs, [(5, " ".join(own), None)], weights_of(2, np.zeros(D.IDF_BINS)))
    filler = " ".join(f"f{i}" for i in range(200))
    for text, want in ((more, []), (less, [5]), (f"{more} {filler} {less}", [5]), (f"{less} {filler} {more}", [5])):
        words = D.words_of(pa.array([text]))
        n = len(words.hash)
        hits = checked(words, space, [(0, 0, a, min(a + 24, n), 0.9) for a in range(0, n, 24)])
        assert [h[1] for h in hits] == want
        assert [h[1] for h in Search([space])(words)] == want


def test_paraphrases_with_other_words_and_moved_parts(spark, make, prose):
    """Every fifth word replaced; two halves changed about; a clause put in between."""
    rng = random.Random(31)
    word = lambda: prose(rng, 1) + prose(rng, 1)
    items = [(i, " ".join(word() for _ in range(rng.randint(20, 60)))) for i in range(30)]
    rows, truth = [], set()
    for i, text in items:
        w = text.split()
        half = len(w) // 4
        forms = (
            [word() if k % 5 == 2 else x for k, x in enumerate(w)],
            w[half:] + w[:half],
            w[: len(w) // 2] + [word() for _ in range(8)] + w[len(w) // 2 :],
        )
        for k, form in enumerate(forms):
            rows.append((10 * i + k, " ".join([word() for _ in range(60)] + form + [word() for _ in range(60)])))
            truth.add((10 * i + k, i))
    rows += [(1000 + i, " ".join(word() for _ in range(150))) for i in range(60)]
    got = {(r.doc_id, r.item_id) for r in contamination(make(rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got <= truth and len(got) >= 0.95 * len(truth)


def test_items_of_few_words_equal_whole_texts(spark, make):
    items = [(1, "Paris"), (2, "forty two"), (3, "  "), (4, "Forty, TWO!"), (5, "a b c d")]
    docs = make([(1, "paris"), (2, "Paris is a town"), (3, "forty two."), (4, "forty two three"), (5, ""), (6, "a b c d"), (7, "a b c d e"), (8, None)])
    got = contamination(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in got) == [(1, 1, 1.0), (3, 2, 1.0), (3, 4, 1.0), (6, 5, 1.0)]


def test_three_reads_for_any_number_of_blocks(spark, make, prose, monkeypatch, tmp_path):
    """Documents are read for the counts, the sample and the search, with one block and with five; the same hits."""
    rng = random.Random(17)
    items = [(i, prose(rng, 30)) for i in range(10)]
    docs = make([(i, f"{prose(rng, 20)} {t} {prose(rng, 20)}") for i, t in items] + [(50 + i, prose(rng, 90)) for i in range(20)])
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.createDataFrame(items, "item_id bigint, text string")

    def reads(per_block, bytes_at_once=D.SPACES_BYTES):
        monkeypatch.setattr(D, "ITEMS_PER_BLOCK", per_block)
        monkeypatch.setattr(D, "SPACES_BYTES", bytes_at_once)
        seen = spark.sparkContext.accumulator(0)

        @F.udf("bigint")
        def marked(x):
            seen.add(1)
            return x

        source = spark.read.parquet(f"{tmp_path}/documents.parquet").select(marked.asNondeterministic()("doc_id").alias("doc_id"), "text")
        hits = sorted((r.doc_id, r.item_id) for r in contamination(source.where("doc_id >= 0"), bench).collect())
        return seen.value / 30, hits

    one, five = reads(10), reads(2)
    assert one[1] == five[1] == [(i, i) for i in range(10)] and one[0] == five[0] <= 3
    assert reads(2, 0)[1] == one[1]  # a search for each space


def test_the_sample_is_never_empty_at_scale(make, monkeypatch):
    """Far more documents than the sample takes: the share is not rounded to nothing."""
    monkeypatch.setattr(D, "SAMPLE_DOCS", 40)
    docs = make([(i, f"text {i}") for i in range(300)] + [(None, "same")] * 300)
    got = D.sample_of(docs, 600).count()
    assert 20 <= got <= 65
    monkeypatch.setattr(D, "SAMPLE_DOCS", 20_000)
    assert D.sample_of(docs, 2 * 10**9).count() <= 1 and D.sample_of(docs, 25_000).count() > 400


def plain_rows(texts, vocabulary, idf):
    """TF-IDF rows of passages, text by text and word by word."""
    at, rows = {int(h): k for k, h in enumerate(vocabulary)}, []
    for text in texts:
        words = [int(h) for h in D.words_of(pa.array([text], pa.string())).hash]
        for a in range(0, len(words), D.PASSAGE):
            row = np.zeros(len(vocabulary))
            for h in words[a : a + D.PASSAGE]:
                if h in at:
                    row[at[h]] += idf[D._bin(np.array([h], np.uint64))[0]]
            if row.any():
                rows.append(row / np.linalg.norm(row))
    return np.array(rows)


def test_products_of_all_texts_against_plain_loops(make, prose, monkeypatch):
    """Every passage of every text is in the sums, for each block's vocabulary, however small the parts."""
    monkeypatch.setattr(D, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(D, "SUMS_HELD", 120)
    monkeypatch.setattr(D, "TILE", 7)
    docs, items, _ = corpus(make, prose)
    docs = docs.limit(60).union(make([(None, None), (900, ""), (901, items[0][1]), (901, items[0][1])])).cache()
    n, df = document_frequencies(docs, D.runs_of(items))
    idf = weights_of(n, df)
    vocabularies = [D._known([(i, t, None) for i, t in some], idf)[1] for some in (items[:3], items[2:9], [])]
    tiles = D.text_products(docs, vocabularies, idf).collect()
    texts = [r.text for r in docs.collect()]
    for block, v in enumerate(vocabularies):
        got = np.zeros((len(v), len(v)))
        for r in tiles:
            if r.block == block:
                i, j = (np.frombuffer(x, np.int32) for x in (r.i, r.j))
                assert (i // D.TILE == r.tile).all() and not got[i, j].any()
                got[i, j] = np.frombuffer(r.g, np.float32)
        rows = plain_rows(texts, v, idf) if len(v) else np.zeros((0, 0))
        assert np.allclose(got, rows.T @ rows, rtol=1e-5, atol=1e-6)


def test_spaces_are_fitted_on_all_documents(spark, make, prose, monkeypatch):
    """The bound of the sample changes nothing, and the directions hold as much of all rows as a plain decomposition's."""
    monkeypatch.setattr(D, "SAMPLE_DOCS", 1)
    docs, items, truth = corpus(make, prose)
    docs = docs.cache()
    build, spaces = D.build_space, []
    monkeypatch.setattr(D, "build_space", lambda *a: spaces.append(build(*a)) or spaces[-1])
    got = {(r.doc_id, r.item_id) for r in contamination(docs, spark.createDataFrame(items, "item_id bigint, text string"), 32).collect()}
    assert len(truth & got) >= 0.95 * len(truth) and got <= truth
    n, df = document_frequencies(docs, D.runs_of(items))
    texts = [r.text for r in docs.collect()]
    for space in spaces:
        rows = plain_rows(texts, space.vocabulary, weights_of(n, df))
        own = np.zeros((len(space.passages), len(space.vocabulary)))
        for k, p in enumerate(p for _, w, _ in space.items for p in D._passages(w)):
            i, x = D._tfidf(p, space)
            own[k, i] = x
        both = np.concatenate([rows, own * np.sqrt(D.OWN * (rows**2).sum() / (own**2).sum())])
        best = (np.linalg.svd(both, compute_uv=False)[:32] ** 2).sum()
        assert ((both @ space.basis[:, :32]) ** 2).sum() > 0.995 * best
    whole = [build(docs, [(i, t, None) for i, t in items if i in {x[0] for x in s.items}], weights_of(n, df), 32) for s in spaces]
    for s, w in zip(spaces, whole):
        assert (s.vocabulary == w.vocabulary).all() and np.allclose(s.basis @ s.basis.T, w.basis @ w.basis.T, atol=1e-3)


def test_clashing_columns(spark, make, prose):
    rng = random.Random(3)
    item = prose(rng, 30)
    names = ["_id", "_node", "node", "item_id", "cosine", "text_md5", "block", "answer"]
    docs = make([(1, f"{prose(rng, 30)} {item}"), (2, prose(rng, 60))]).select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    kept = keep_uncontaminated(docs, spark.createDataFrame([(7, item, "x", 5)], "item_id bigint, text string, block string, doc_id int"))
    assert kept.columns == docs.columns
    assert [(r.doc_id, *(r[n] for n in names)) for r in kept.collect()] == [(2, *(f"own {n}" for n in names))]


def test_awkward(spark, awkward, empty):
    bench = spark.createDataFrame([(1, "some words that nobody has written anywhere before today")], "item_id bigint, text string")
    assert contamination(awkward, bench).count() == 0
    assert keep_uncontaminated(awkward, bench).count() == awkward.count()
    assert keep_uncontaminated(awkward, bench.limit(0)).count() == awkward.count()
    assert keep_uncontaminated(empty, bench).count() == 0
