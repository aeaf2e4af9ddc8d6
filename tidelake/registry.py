"""Every registered query with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import store_queries, suite, topic_queries  # noqa: F401  (they register their queries)

flagship = suite.flagship


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(suite.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(suite.SQL)
