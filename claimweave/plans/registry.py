"""Where queries and their DuckDB counterparts are registered."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_memo: dict[tuple, object] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is SQL giving the same rows on the same tables."""

    def wrap(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # dates of the data model are UTC dates
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def once(spark: SparkSession, *key, build: Callable[[], object]):
    """Build a materialised table set once per application; later queries read the written tables."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _memo:
        _memo[full] = build()
    return _memo[full]
