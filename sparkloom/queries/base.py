"""Registry: a query takes ``(spark, sf_dir)``; its function here takes a reader of tables by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.sources.tables import table

Tables = Callable[[str], DataFrame]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of ``(tables, spark, sf_dir)`` under its name."""

    def put(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda name: table(spark, sf_dir, name), spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return put


def exact_sum(column: str) -> str:
    """SQL of a sum of two-digit amounts that does not depend on the order of addition."""
    return f"CAST(sum(CAST({column} AS DECIMAL(18,2))) AS DOUBLE)"
