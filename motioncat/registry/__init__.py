"""Registered queries: one per operator, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_MODULES = ["catalog", "rollups", "dashboard", "occupancy", "tags", "tracks", "vectors", "clusters", "labeling", "files", "streams"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under ``name``."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def load_all() -> None:
    for module in _MODULES:
        import_module(f"{__name__}.{module}")
