"""Every registered query of the language's operators against its SQL, on the smallest tables."""

import duckdb
import pytest

from asclepia.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows(records, columns, wanted):
    at = [columns.index(c) for c in wanted]
    return sorted((tuple(plain(r[i]) for i in at) for r in records), key=lambda r: [(v is None, str(v)) for v in r])


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got, want = QUERIES[name](spark, SF), db.sql(ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows([tuple(r) for r in got.collect()], got.columns, columns) == rows(want.fetchall(), want.columns, columns)
