"""Registry of named queries and their ANSI-SQL oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame`` built from library
operators; the oracle is an independent SQL text over the raw driver tables
(DuckDB dialect), used to check results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(qid: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if qid in QUERIES:
            raise ValueError(f"duplicate query id {qid}")
        QUERIES[qid] = fn
        if sql is not None:
            ORACLES[qid] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so their queries register."""
    from . import (q_aggregates, q_calendar, q_clean, q_joins, q_missing,  # noqa: F401
                   q_ml, q_series, q_sources, q_stats)
