"""Every registered query of the engine against its SQL twin in DuckDB (sf0.001)."""

import os

import pytest

from gavelworks.plans import catalog

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def norm(rows):
    def one(v):
        if v is None or v != v:
            return "None"
        if isinstance(v, float):
            return f"{v:.6f}".rstrip("0").rstrip(".")
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert norm(map(tuple, got)) == norm(tuple(r[i] for i in at) for r in rel.fetchall())


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert e.entry(spark).count() > 0 and set(catalog.QUERIES) <= set(e.queries())
