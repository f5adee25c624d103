"""How a query is registered: a function of the tables, with the DuckDB statement that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tenderflow.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def carrier(sql: str | None = None) -> Callable:
    """Registers the decorated function of Tables under its name."""

    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLE_SQL[build.__name__] = sql
        return build

    return register


def cents(x: str) -> str:
    """DuckDB: x rounded half up to cents by its shortest decimal form, as DOUBLE."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), 2) AS DOUBLE)"


def places(x: str, n: int) -> str:
    """DuckDB: x rounded half up to n places, as DOUBLE."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {n}) AS DOUBLE)"


def total(x: str) -> str:
    """DuckDB: an exact sum of cents, as DOUBLE."""
    return f"CAST(sum(CAST({x} AS DECIMAL(18, 2))) AS DOUBLE)"
