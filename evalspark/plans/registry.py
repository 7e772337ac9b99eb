"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where the semantics are expressible in SQL, the equivalent DuckDB text.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from evalspark.plans import (  # noqa: F401
        q_core, q_report, q_score, q_ingest, q_classify, q_route, q_runs, q_store, q_stream)
