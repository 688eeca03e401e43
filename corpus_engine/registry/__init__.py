"""Registered queries over the driver tables, each with its SQL counterpart."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

# one module per area
AREAS = (
    "text_queries",
    "url_queries",
    "page_queries",
    "chunk_queries",
    "dedup_queries",
    "search_queries",
    "conversation_queries",
    "analytics_queries",
    "incremental_queries",
    "job_queries",
    "access_queries",
    "graph_queries",
    "stream_queries",
    "function_queries",
)


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its own name."""

    def register(fn: Run) -> Run:
        if fn.__name__ in _QUERIES:
            raise ValueError(f"duplicate query {fn.__name__}")
        _QUERIES[fn.__name__] = Query(fn.__name__, fn, sql)
        return fn

    return register


def all_queries() -> dict[str, Query]:
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
    return dict(_QUERIES)
