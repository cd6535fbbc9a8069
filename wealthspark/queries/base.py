"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may name the stand-in tables."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = fixtures.with_views(sql)
        return f

    return keep


def x(lon: str = "lon") -> str:
    return f"6378137.0 * radians({lon})"


def y(lat: str = "lat") -> str:
    return f"6378137.0 * ln(tan(pi() / 4 + radians({lat}) / 2))"


def xy(table: str, rest: str = "*") -> str:
    """A subquery with projected points."""
    return f"(SELECT {rest}, {x()} AS x, {y()} AS y FROM {table})"
