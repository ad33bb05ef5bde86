"""Name -> (Spark query, SQL twin) for every operator of the engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    """Adds a query under a name; sql is its ANSI twin, None where SQL cannot express it."""

    def add(run):
        assert name not in QUERIES, name
        QUERIES[name] = Query(run, sql)
        return run

    return add
