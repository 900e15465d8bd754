"""Registry of the queries that run over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MODULE_OF: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``, and the SQL that must give the same rows."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        MODULE_OF[name] = fn.__module__.rsplit(".", 1)[-1]
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap
