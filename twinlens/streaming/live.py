"""Running counts over a stream of diagnostics, by micro-batches; an extension beyond batch reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mappings import Mappings


def severity_counts(stream: DataFrame, mappings: Mappings, time_col: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window, side, canonical rule and severity of a stream with an event time; rows later than ``late`` are dropped by the watermark."""
    d = stream.withWatermark(time_col, late).withColumn("canonical_code", mappings.canonical(F.col("code")))
    return d.groupBy(F.window(time_col, window), "side", "canonical_code", "severity").count()
