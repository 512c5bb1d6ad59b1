"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL.

Every query reads the test tables through the fixture views, so its work
grows with the scale factor.  Presentation ORDER BY is kept where the
reference has one; the value check ignores order.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle as O
from .session import utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str, sql: str | None = None):
    """Register a query function; ``sql`` is the oracle body (CTEs added)."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            utc(spark)
            return fn(spark, sf_dir)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            O.register(name, sql)
        return fn
    return deco


def load_all() -> None:
    from .queries import warehouse, operators, quality, loading, changes, scaling, streams  # noqa: F401
