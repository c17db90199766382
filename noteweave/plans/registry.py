"""Registry of named queries: Spark callable + optional DuckDB oracle SQL.

Each registered query takes ``(spark, sf_dir)`` and returns a DataFrame whose
columns are scalars (arrays are joined into strings), so that results can be
compared value by value with the oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import oracle_with

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is DuckDB SQL over the base tables and fixture views."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle_with(oracle)
        return fn
    return deco


def load_all() -> None:
    """Import every query module so that its ``@register`` calls run."""
    from . import (q_cohort, q_search, q_ontology, q_deid, q_context,  # noqa: F401
                   q_exchange, q_display, q_jobs)
