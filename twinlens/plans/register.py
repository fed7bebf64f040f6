"""The table of queries and their SQL, filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from .demo import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a callable under ``name``, with its SQL where SQL can express it."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def projection(name: str, source: str, columns: Callable[[], dict[str, Column | str]], sql: str) -> None:
    """Register a query that projects one table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        return df.select(*((c if isinstance(c, Column) else df[c]).alias(k) for k, c in columns().items()))

    QUERIES[name] = run
    ORACLE[name] = sql
