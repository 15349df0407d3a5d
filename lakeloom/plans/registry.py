"""Names of all registered queries, with the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("usage", "relational", "windows", "texts", "retrieval", "documents", "products", "graphs", "events", "evaluation", "questions", "knowledge", "monitoring", "grounding", "lookups", "hydration", "normalising", "matching", "memory", "conversing", "variants", "records")

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name; ``sql`` is DuckDB SQL for the same rows."""

    def add(f: Query) -> Query:
        if f.__name__ in _QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def alias(name: str, other: Query) -> None:
    """Register a query under one more name."""
    _QUERIES[name] = other
    if other.__name__ in _SQL:
        _SQL[name] = _SQL[other.__name__]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"lakeloom.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
