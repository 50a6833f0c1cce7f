"""The queries of the library by name, and the SQL that restates them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows, if SQL can."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


from .plans import audits, claims, delivery, ingestion, intake, keys, landing, places, portfolio, resolution, screening, texts, views  # noqa: E402, F401
