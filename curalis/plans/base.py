"""Registration of queries: a function of (spark, sf_dir) and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Registers ``f(t)``, where ``t(name)`` reads a table; ``t.spark`` is the session and ``t.sf_dir`` the folder."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            read = lambda n: table(spark, sf_dir, n)
            read.spark, read.sf_dir = spark, sf_dir
            return f(read)

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return register
