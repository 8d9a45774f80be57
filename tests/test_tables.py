"""Written tables, size checks and joins with hot keys."""

import os
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from wayfare.operators import components
from wayfare.plans import tables
from wayfare.plans.tables import clean_up, forget, fresh, join_keyed, shared_dir, small, written


def _local(path):
    return path.removeprefix("file://")


def test_off_one_machine_the_folder_must_be_given():
    for master, ok in (("local", True), ("local[4]", True), ("spark://host:7077", False), ("yarn", False), ("local-cluster[2,1,1024]", False)):
        spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None), sparkContext=SimpleNamespace(master=master))
        if ok:
            tables._MADE.remove(shared_dir(spark, "x"))
        else:
            with pytest.raises(RuntimeError, match="checkpoint"):
                shared_dir(spark, "x")


def test_folders_are_removed(spark):
    one, two = written(spark.range(5), "one"), written(spark.range(5), "two")
    assert one.count() == 5 and os.path.isdir(_local(one._written_to))
    forget(one, spark.range(3))
    assert not os.path.exists(_local(one._written_to)) and two.count() == 5
    kept = list(tables._MADE)
    tables._MADE[:] = [two._written_to]
    clean_up(spark)
    assert not tables._MADE and not os.path.exists(_local(two._written_to))
    tables._MADE[:] = [p for p in kept if p != two._written_to]


def test_small_is_of_rows_and_bytes(spark):
    df = written(spark.range(100).select("id", F.lit("x" * 1000).alias("s"), F.array(F.lit(1), F.lit(2)).alias("a"), F.struct(F.lit("y").alias("t")).alias("r")), "small")
    assert small(df, 1000) is not df
    assert small(df, 99) is df and small(df, 1000, 50_000) is df


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_join_like_others(spark, monkeypatch, how):
    rows = spark.createDataFrame([(i, i % 7 if i % 3 else 1) for i in range(200)] + [(900, None), (901, 99)], "i int, k int").cache()
    counts = written(rows.where("k is not null and k <> 99").groupBy("k").agg(F.count("*").alias("n"), F.min("i").alias("least")), "counts")
    want = Counter(map(tuple, rows.join(counts, "k", how).select("i", "k", "least").collect()))
    monkeypatch.setattr(tables, "small", lambda df, *_: df)
    monkeypatch.setattr(tables, "HOT_LEAST", 20)
    got = join_keyed(rows, counts, "k", "n", how)
    assert Counter(map(tuple, got.select("i", "k", "least").collect())) == want


def test_fresh_names():
    assert fresh(["A", "_x", "_X_"], "_x", "a", "b") == ["_x__", "a_", "b"]


@pytest.mark.parametrize("few", [0, 10**6])
def test_components_of_awkward_shapes(spark, monkeypatch, few):
    """Chains, a hub above and a hub below its leaves, zigzags, loops and repeated edges, by plain union-find."""
    monkeypatch.setattr(components, "FEW_ROWS", few)
    monkeypatch.setattr(tables, "HOT_LEAST", 5)
    if not few:
        monkeypatch.setattr(tables, "small", lambda df, *_: df)
    edges = [(i, i + 1) for i in range(100, 140)] + [(999, i) for i in range(200, 230)] + [(300, i) for i in range(301, 330)]
    edges += [(400 + i, 500 - i) for i in range(20)] + [(400 + i, 499 - i) for i in range(20)] + [(7, 7), (1, 2), (2, 1), (1, 2), (-5, 1)]
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {v: find(v) for v in root if v != 7}
    got = {r.node: r.root for r in components.star_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == want
    assert components.star_components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).count() == 0
