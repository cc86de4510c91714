"""Queries on the driver tables: each registers a Spark callable and, where SQL can say it, the equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            self.queries[fn.__name__] = fn
            if sql is not None:
                self.oracles[fn.__name__] = sql
            return fn

        return add

    def merge(self, other: Registry) -> None:
        clash = set(self.queries) & set(other.queries)
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        self.queries.update(other.queries)
        self.oracles.update(other.oracles)


def catalog() -> Registry:
    """All registered queries."""
    from voxtable.catalog import audit, evaluation, geometry, images, volumes

    out = Registry()
    for module in (evaluation, audit, images, geometry, volumes):
        out.merge(module.REGISTRY)
    return out
