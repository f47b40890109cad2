"""Named queries of the core library, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query under ``name``; a second registration of another function is an error."""

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES and QUERIES[name] is not fn:
            raise ValueError(f"query {name!r} is already registered")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add
