"""Registered queries by name, with their SQL for an independent engine where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: tuple[str, ...] = (), recursive: bool = False) -> Callable[[Query], Query]:
    """Register a function under its name; ``ctes`` are put before its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            head = f"WITH {'RECURSIVE ' * recursive}{', '.join(c.strip() for c in ctes)}" if ctes else ""
            ORACLE_SQL[f.__name__] = f"{head} {sql}".strip()
        return f

    return register
