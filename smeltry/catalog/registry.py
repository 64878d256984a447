"""Registration of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from smeltry.catalog.tables import with_tables
from smeltry.workload import Workload, plain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(workload) -> DataFrame`` with its SQL twin."""

    def register(fn: Callable[[Workload], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(Workload(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_tables(sql)
        return fn

    return register
