"""Where named queries and their SQL are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, paths: bool = False):
    """Registers a function of a table reader (name -> DataFrame) as a query, with the SQL that checks it.

    With ``paths`` the function takes (spark, sf_dir) itself.
    """

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir) if paths else f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return register
