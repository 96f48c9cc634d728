"""Each query of the engine against its SQL in DuckDB."""

import os

import pytest

from vecspark.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    import duckdb

    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted((tuple(rounded(r[c]) for c in names) for r in df.collect()), key=repr)
    if name in SQL:
        rel = con.sql(SQL[name])
        order = [rel.columns.index(c) for c in names]
        assert sorted(rel.columns) == names
        assert rows == sorted((tuple(rounded(x[i]) for i in order) for x in rel.fetchall()), key=repr)
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
