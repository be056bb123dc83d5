"""Registration of runnable queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}


_TABLES: dict[tuple, Tables] = {}


def tables(spark: SparkSession, folder: str) -> Tables:
    """The table bindings of a folder, kept per application so that schemas are read once."""
    key = (spark.sparkContext.applicationId, id(spark), folder)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = Tables(spark, folder)
    return _TABLES[key]


def query(name: str, sql: str | None = None):
    """Register `fn(tables) -> DataFrame`, with SQL giving the same rows if there is any."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(tables(spark, folder))
        if sql is not None:
            CHECK_SQL[name] = sql
        return fn

    return register
