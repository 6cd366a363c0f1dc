"""Every query with SQL gives the rows of that SQL in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, small, duck, name):
    got = entry.queries()[name](spark, small)
    wanted = duck.execute(SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(columns, wanted.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
