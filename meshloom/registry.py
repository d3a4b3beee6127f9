"""Queries by name, and the SQL that states what each returns."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from meshloom.shared import few_broadcasts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, less a trailing `_query`, or under `name`. What it runs before it gives its result
        broadcasts little (few_broadcasts)."""

    def put(f: Query) -> Query:
        key = name or f.__name__.removesuffix("_query")
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")

        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with few_broadcasts(spark):
                return f(spark, sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return f

    return put
