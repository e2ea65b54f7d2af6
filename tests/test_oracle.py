"""Every query with SQL equals DuckDB on the smallest driver tables."""
import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    status, note, *_ = compare(spark, duck, name, QUERIES[name], ORACLE[name], SF)
    assert status in ("OK", "EMPTY"), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
