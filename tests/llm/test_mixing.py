import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.llm.mixing import BUDGET, TEMPERATURE, mix, op2_raked_mixture, probabilities, with_cells


@pytest.fixture(scope="module")
def corpus(make, prose):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(1, 60)), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c"])) for i in range(600)]
    return make(rows).withColumn("topic", F.when(F.col("doc_id") % 3 == 0, "x").otherwise("y"))


def rake(cells, sweeps=400):
    """Plain raking to tempered targets."""
    tokens = np.array([c[3] for c in cells], float)
    w = np.ones(len(cells))
    for _ in range(sweeps):
        for d in range(3):
            values = sorted({c[d] for c in cells}, key=str)
            totals = {v: sum(t for c, t in zip(cells, tokens) if c[d] == v) for v in values}
            whole = sum(t**TEMPERATURE for t in totals.values())
            for v in values:
                mine = np.array([c[d] == v for c in cells])
                w[mine] *= tokens.sum() * totals[v] ** TEMPERATURE / whole / (tokens * w)[mine].sum()
    return w


def test_marginals_and_budget(corpus):
    celled = with_cells(corpus).cache()
    cells = {tuple(r[:3]): r[3] for r in celled.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens")).collect()}
    got = {(r.source, r.lang, r.topic): r for r in probabilities(celled).collect()}
    keys = list(cells)
    want = rake([(*k, cells[k]) for k in keys])
    assert [got[k].ratio for k in keys] == pytest.approx(want.tolist(), rel=1e-4)
    assert sum(cells[k] * got[k].prob * got[k].weight for k in keys) == pytest.approx(BUDGET * sum(cells.values()), rel=1e-3)
    c = got[keys[0]].prob * got[keys[0]].weight / got[keys[0]].ratio
    assert all(r.prob * r.weight == pytest.approx(c * r.ratio) for r in got.values())


def test_table_and_driver_agree(corpus):
    celled = with_cells(corpus).cache()
    for targets in (None, {"lang": {"en": 0.5, "de": 0.5}}):
        a, b = ({tuple(r)[:3]: (r.ratio, r.prob) for r in probabilities(celled, targets, local_cells=n).collect()} for n in (10**6, 0))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-6, abs=1e-9) for k in a)
        if targets:
            assert all(p == 0 for k, (_, p) in a.items() if k[1] is None)


def test_sampling_meets_the_targets(make, prose):
    rng = random.Random(2)
    docs = make([(i, prose(rng, 5), rng.choice(["en", "en", "en", "de"]), rng.choice("aab")) for i in range(6000)]).withColumn("topic", F.lit("t"))
    kept = mix(docs, {"lang": {"en": 0.5, "de": 0.5}}, budget=0.4)
    shares = {r.lang: r["count"] for r in kept.groupBy("lang").count().collect()}
    assert kept.columns == docs.columns
    assert shares["en"] / sum(shares.values()) == pytest.approx(0.5, abs=0.03) and kept.count() == pytest.approx(2400, rel=0.06)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in mix(docs, {"lang": {"en": 0.5, "de": 0.5}}, budget=0.4).select("doc_id").collect())


@pytest.mark.parametrize("targets", [None, {"source": {"a": 0.2, "b": 0.3, "c": 0.5}}])
def test_shares_hold_where_documents_are_repeated(corpus, targets):
    """Small sources that must be taken more than once: kept tokens meet the targets in every dimension."""
    corpus = corpus.unionByName(corpus.where("source = 'a'").withColumn("doc_id", F.col("doc_id") + 1000)).unionByName(corpus.where("source = 'a'").withColumn("doc_id", F.col("doc_id") + 2000))
    celled = with_cells(corpus)
    cells = probabilities(celled, targets).collect()
    assert any(r.weight > 1.2 for r in cells)
    kept = with_cells(mix(corpus, targets)).cache()
    total = kept.agg(F.sum("_tokens")).first()[0]
    every = celled.agg(F.sum("_tokens")).first()[0]
    assert total == pytest.approx(BUDGET * every, rel=0.08)
    for d in ("source", "lang", "topic"):
        own = dict(celled.groupBy(f"_{d}").agg(F.sum("_tokens")).collect())
        want = targets[d] if targets and d in targets else {v: t**TEMPERATURE / sum(x**TEMPERATURE for x in own.values()) for v, t in own.items()}
        got = dict(kept.groupBy(f"_{d}").agg(F.sum("_tokens")).collect())
        assert {v: got[v] / total for v in want} == pytest.approx(want, abs=0.05)


def test_targets_that_cannot_hold(make):
    docs = make([(1, "a b c", "en", "x"), (2, "a b", "de", "y")]).withColumn("topic", F.lit("t"))
    with pytest.raises(ValueError, match="can't hold"):
        mix(docs, {"lang": {"en": 0.9, "de": 0.1}, "source": {"x": 0.2, "y": 0.8}})
    with pytest.warns(UserWarning, match="still miss"):
        probabilities(with_cells(make([(1, "a b c d", "en", "x"), (2, "a b", "de", "x"), (3, "a", "de", "y"), (4, "a " * 50, "fr", "z"), (5, "b " * 7, "fr", "x")]).withColumn("topic", F.col("source"))).withColumn("_topic", F.concat("_lang", "_source")))


def test_clashing_columns(make):
    names = ["_tokens", "_kept", "_prob", "_weight", "_ratio", "_cell", "_copies", "_turn", "_row", "n", "prob", "weight"]
    docs = make([(i, "a b c", "en", "s") for i in range(50)]).select("*", *(F.concat(F.lit(f"{n} of "), "doc_id").alias(n) for n in names))
    got = mix(docs)
    assert got.columns == docs.columns and 20 < got.count() < 48
    assert all(r[n] == f"{n} of {r.doc_id}" for r in got.collect() for n in names)


def test_awkward(spark, awkward, empty, tmp_path):
    awkward.withColumn("prob", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = op2_raked_mixture(spark, str(tmp_path))
    assert got.count() == awkward.count()
    assert mix(awkward).columns == awkward.columns
    assert mix(empty).count() == 0
