"""Every query of the catalog against DuckDB on the same tables."""

import duckdb
import pytest

from gridloom.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    key = lambda rows: sorted(map(repr, rows))
    assert key([tuple(r) for r in got.select(*names).collect()]) == key(want.select(*names).fetchall())
