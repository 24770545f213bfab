"""The registered queries and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name that must be new, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"{name} is registered already")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


from scoreloom.plans import aggregates, joins, records, sets, sources, streams, text, windows  # noqa: E402, F401
