"""Query catalogue: one Spark plan per operator plus its DuckDB oracle twin.

``register`` records (name -> builder(spark, sf_dir)) and, when the
operator is expressible in SQL, the equivalent DuckDB query over the same
driver tables. ``__spark_entry__`` exposes both dictionaries.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from logsight.plans import queries_parse  # noqa: F401
    from logsight.plans import queries_stats  # noqa: F401
    from logsight.plans import queries_misc  # noqa: F401
    from logsight.plans import queries_ml  # noqa: F401
    from logsight.plans import queries_sources  # noqa: F401
    from logsight.plans import queries_stream  # noqa: F401
