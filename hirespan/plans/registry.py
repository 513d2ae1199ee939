"""Where queries and their SQL counterparts are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hirespan.plans.bindings import Loader, tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of a table loader under ``name``, with SQL giving the same rows."""

    def register(build: Callable[[Loader], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(tables(spark, sf_dir))

        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register
