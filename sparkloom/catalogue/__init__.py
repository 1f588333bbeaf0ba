"""Registered queries: each operator over the test tables, with the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


def load() -> Registry:
    from . import documents, graphs, knowledge, kpi, matching, metrics, plans, quality, retrieval, streams, sync, warehouse

    out = Registry()
    for module in (plans, metrics, warehouse, quality, documents, graphs, matching, streams, kpi, retrieval, knowledge, sync):
        out.queries |= module.query.queries
        out.sql |= module.query.sql
    return out
