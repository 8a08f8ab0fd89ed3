"""Every query with an oracle SQL must agree with DuckDB on the sf0.001 tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import digest
from ideolens.sources.fixtures import TABLES

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sp = entry.queries()[name](spark, SF).toPandas()
    od = con.execute(entry.oracle_sql()[name]).df()
    assert len(sp) == len(od)
    assert sorted(sp.columns) == sorted(od.columns)
    assert digest(sp)[0] == digest(od)[0]


def test_every_query_has_callable():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 66
