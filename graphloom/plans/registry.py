"""Where queries and their oracles are registered."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..storage import plain_sizes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function of (spark, sf_dir) by its name, with the statement that says the same (None: tested on a fixture)."""

    def add(f):
        @functools.wraps(f)
        def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
            plain_sizes(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = planned
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
