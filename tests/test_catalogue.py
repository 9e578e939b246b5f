"""Every core query against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    other = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in other.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, other.fetchall())
