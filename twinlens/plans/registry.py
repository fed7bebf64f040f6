"""All agreement-analysis queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import lint_queries, plan_queries, scalar_queries  # noqa: F401  they fill the register
from .register import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lint_queries.a2_raw_summary(spark, sf_dir)
