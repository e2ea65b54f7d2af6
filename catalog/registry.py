"""Where bound queries and their reference SQL are collected."""
from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str | Callable[[], str]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame, with the SQL it must equal if there is any."""
    def add(fn):
        assert name not in QUERIES, name

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # dates are read and shown in UTC, as the reference SQL does
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def r6(c: Column | str) -> Column:
    """Six decimals, no negative zero: floats are compared by value."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def r6s(expression: str) -> str:
    return f"(round(CAST({expression} AS DOUBLE), 6) + CAST(0 AS DOUBLE))"


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
