import random

import corpus_pipeline

from wayfare.llm.queries import oracle_sql, queries


def test_stages(spark, make, prose, tmp_path):
    rng = random.Random(3)
    items = [(i, prose(rng, 30)) for i in range(6)]
    clean = [(i, prose(rng, 120, "en" if i % 2 else "de"), "en" if i % 2 else "de", f"s{i % 3}") for i in range(80)]
    copies = [(100 + i, clean[i][1] + (" more" if i % 2 else ""), clean[i][2], "s1") for i in range(10)]
    leaked = [(200 + i, f"{prose(rng, 50)} {items[i][1]} {prose(rng, 40)}", "en", "s2") for i in range(6)]
    junk = [(300, None, "en", "s1"), (301, "1234 !!!", "en", "s1")]
    docs = make(clean + copies + leaked + junk)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, left, str(tmp_path))
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out{i}")
        left = spark.read.parquet(f"{tmp_path}/out{i}")
        seen.append({r.doc_id for r in left.select("doc_id").collect()})
    assert seen[0] == {r[0] for r in clean + copies + leaked}
    assert seen[1] == {r[0] for r in clean + leaked}
    assert seen[2] == {r[0] for r in clean}
    assert seen[3] <= seen[2] and seen[4] == seen[3]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, left.collect()))
    starts = [(r.start, r.n_tokens) for r in whole.orderBy("doc_id").collect()]
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_names():
    names = list(queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)] + ["pipeline"]
    assert set(oracle_sql()) <= set(names)


def test_sql_agrees(spark, make, prose, tmp_path):
    """The SQL gives the same rows, nulls and empty texts included."""
    import duckdb

    rng = random.Random(6)
    docs = make([(i, prose(rng, rng.randint(1, 150)) + rng.choice(("", " ## $$ %%%", "\nx y z\nx y z\nx y z")), rng.choice(("en", "de", None)), rng.choice("abc")) for i in range(300)] + [(400, None), (401, ""), (402, " \n\t")])
    labels = spark.createDataFrame([(i, int(rng.random() < 0.8), 0) for i in range(0, 300, 2)], "doc_id bigint, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name, sql in oracle_sql().items():
        got = queries()[name](spark, str(tmp_path))
        want = db.sql(sql)
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns
        rows = lambda x: sorted(map(tuple, x), key=repr)
        assert rows(got.select(*columns).collect()) == rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall()), name
