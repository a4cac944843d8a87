"""Query registry: a callable per operator, and the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairlens.catalog.views import duck_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query. ``sql`` may use the named views; ``WITH`` clauses are merged."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return fn

    return add


def with_views(sql: str, views: tuple[str, ...]) -> str:
    heads = [f"{v} AS ({duck_view(v)})" for v in views]
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        inner = body[5:]
        return "WITH " + ",\n".join([*heads, inner])
    return ("WITH " + ",\n".join(heads) + "\n" + body) if heads else body
