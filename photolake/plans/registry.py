"""Where queries register with their twin in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, body: str | None = None, *tables: str) -> Callable[[Query], Query]:
    """Registers a query; ``body`` is its SQL over the derived ``tables``."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if body is not None:
            ORACLES[name] = sql(body, *tables)
        return f

    return add
