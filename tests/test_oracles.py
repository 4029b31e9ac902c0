"""Every registered query of the core against its SQL oracle, and the rest for their rows."""

import duckdb
import pytest

from lodestrand.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Q, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q))
def test_query(name, spark, sf, duck):
    df = Q[name](spark, sf)
    cols = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    if name not in SQL:
        assert rows
        return
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert rows == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
