"""Named queries with, where SQL can say it, the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom.plans.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Registers a function of DataFrames as a query over the tables named."""
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in tables])
        if sql:
            ORACLES[name] = sql
        return f

    return add
