"""Spans of one file that overlap or begin on the same line, and probable matches among what a linkage leaves, which are off unless asked for.

Spans are laid into buckets of lines whose width grows with their length, so that each lies in two at most at its own width, and at
the wider ones too; two spans meet in buckets of the wider of their widths, and only in the bucket in which the later one
begins. So long spans are neither lost nor met twice. Keys that very many spans share are dealt to several places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import NO_POSITION
from ..shared import Steps

#: Lines of a bucket by width; spans beyond the widest lie in as many of its buckets as they cover.
WIDTHS = [16 << (6 * k) for k in range(5)]
#: Spans of one side under one key that a place takes, about.
HOT = 20_000


def _end(start: Column, end: Column) -> Column:
    return F.coalesce(end, start)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two spans share a line or begin on the same one; a span without an end is one line."""
    return (a_start == b_start) | ((a_start <= _end(b_start, b_end)) & (b_start <= _end(a_start, a_end)))


def _laid(spans: DataFrame, side: str) -> DataFrame:
    """(path, level, bucket, own, id, start, end) of spans: a row a bucket, at the span's own width and all wider ones."""
    start, last = F.col("start_line"), F.greatest(F.col("start_line"), _end(F.col("start_line"), F.col("end_line")))
    own = F.lit(len(WIDTHS) - 1)
    for k in range(len(WIDTHS) - 2, -1, -1):
        own = F.when(last - start < WIDTHS[k], k).otherwise(own)
    width = F.element_at(F.array(*(F.lit(w).cast("long") for w in WIDTHS)), F.col("level") + 1)
    rows = spans.where("path IS NOT NULL AND start_line IS NOT NULL").select("path", F.col("id").alias(f"{side}_id"), start.alias(f"{side}_start"), F.col("end_line").alias(f"{side}_end"), last.alias("_last"), own.alias(f"{side}_level"))
    rows = rows.withColumn("level", F.explode(F.sequence(F.col(f"{side}_level"), F.lit(len(WIDTHS) - 1))))
    return rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(f"{side}_start") / width), F.floor(F.col("_last") / width)))).drop("_last")


def overlap_pairs(left: DataFrame, right: DataFrame, hot: int = HOT) -> DataFrame:
    """(path, left_id, right_id): each pair of spans (id, path, start_line, end_line) of one file that overlap, once.

    Ids are kept as they are and should be distinct on each side; spans without a path or a start meet none. An end before its start counts
    as it stands. Extra columns are dropped.
    """
    a, b = _laid(left, "left"), _laid(right, "right")
    key = ["path", "level", "bucket"]
    # places of a hot key: its left spans are dealt among them, its right ones go to all
    ways = a.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > hot).select(*key, F.ceil(F.col("n") / hot).cast("int").alias("ways"))
    a = a.join(ways, key, "left").withColumn("way", F.pmod(F.xxhash64("left_id"), F.coalesce("ways", F.lit(1))).cast("int")).drop("ways")
    b = b.join(ways, key, "left").withColumn("way", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1))).drop("ways")
    met = a.join(b, [*key, "way"]).where(F.col("level") == F.greatest("left_level", "right_level"))
    width = F.element_at(F.array(*(F.lit(w).cast("long") for w in WIDTHS)), F.col("level") + 1)
    later = F.floor(F.greatest("left_start", "right_start") / width)
    found = met.where((F.col("bucket") == later) & overlaps(F.col("left_start"), F.col("left_end"), F.col("right_start"), F.col("right_end")))
    return found.select("path", "left_id", "right_id")


def with_probable(links: DataFrame) -> DataFrame:
    """Links (bucket, path, kind, confidence, b, c) in which residuals that overlap are probable matches.

    A residual of each side is paired if each is the other's nearest among those it overlaps: by lines, then columns, then the order of
    diagnostics. Others stay residuals. Without a call of this nothing is ever a probable match.
    """
    # written, so that the numbers stay while the rows are read for both sides and for the rest
    rows = links.withColumn("id", F.monotonically_increasing_id())
    steps = Steps(links.sparkSession)
    rows = steps.write(rows)
    side = lambda name, other: rows.where(F.col(name).isNotNull() & F.col(other).isNull()).select("id", "path", F.col(f"{name}.start_line").alias("start_line"), F.col(f"{name}.end_line").alias("end_line"), F.col(name).alias("d"))
    b, c = side("b", "c"), side("c", "b")
    own = lambda df, name: df.select(F.col("id").alias(f"{name}_id"), F.col("d").alias(name))
    pairs = overlap_pairs(b, c).join(own(b, "left"), "left_id").join(own(c, "right"), "right_id")
    column = lambda x: F.coalesce(F.col(f"{x}.start_column"), F.lit(NO_POSITION))
    near = [F.abs(F.col("left.start_line") - F.col("right.start_line")), F.abs(column("left") - column("right"))]
    first = lambda by, other: F.row_number().over(Window.partitionBy(by).orderBy(*near, F.col(f"{other}.key"), F.col(f"{other}_id")))
    chosen = pairs.withColumn("l", first("left_id", "right")).withColumn("r", first("right_id", "left")).where("l = 1 AND r = 1")
    chosen = steps.write(chosen.select("path", "left_id", "right_id", "left", "right"))
    used = chosen.select(F.explode(F.array("left_id", "right_id")).alias("id"))
    rest = rows.join(used, "id", "left_anti").drop("id")
    made = chosen.select(F.lit("match").alias("bucket"), "path", F.lit("probable_match").alias("kind"), F.lit(None).cast("int").alias("confidence"), F.col("left").alias("b"), F.col("right").alias("c"))
    return rest.unionByName(made)
