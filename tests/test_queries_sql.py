"""Every registered graph query against its SQL, on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from wayfare import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(round(r[i], 7) if isinstance(r[i], float) else r[i] for i in order) for r in found)


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_query(spark, db, name):
    want = db.execute(Q.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    found = Q.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(columns)
    assert rows(columns, [tuple(r) for r in found.select(*columns).collect()]) == rows(columns, want.fetchall())


def test_all_but_one_have_sql():
    assert set(Q.queries()) - set(Q.oracle_sql()) == {"k_centres"}
