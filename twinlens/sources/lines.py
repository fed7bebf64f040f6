"""Line starts of source texts, made once a source, and positions of byte offsets by binary search in them.

An index row (path, starts, size) holds the byte offset at which each line begins. Diagnostics join the index, never the text: a
position costs a search over the lines, in the same projection that drops the array again, so rows stay small however many
of them point into one source.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the search: the index of a text of up to 2**31 bytes has no more lines.
STEPS = [1 << k for k in range(30, -1, -1)]
INDEX = "path string, starts array<long>, size long"


class LineStarts:
    """The line starts of one text, for positions where the text itself is at hand."""

    def __init__(self, text: str):
        raw = text.encode("utf-8", "surrogatepass")
        self.size, self.starts = len(raw), [0, *(np.flatnonzero(np.frombuffer(raw, dtype=np.uint8) == 10) + 1).tolist()]

    def position(self, offset: int) -> tuple[int, int]:
        """(line, column) from 1, in bytes; offsets past the end are the end."""
        offset = min(offset, self.size)
        line = bisect.bisect_right(self.starts, offset)
        return line, offset - self.starts[line - 1] + 1


def line_index(sources: DataFrame) -> DataFrame:
    """(path, starts, size) of sources (path, text); a source without a text has no row. Extra columns are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(1)
            # the batch's texts lie one after the other, so one look finds the line ends of all
            at = np.frombuffer(raw.buffers()[1], dtype="<i4", count=raw.offset + len(raw) + 1)[raw.offset :].astype(np.int64)
            data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[: at[-1]] if raw.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
            after = np.flatnonzero(data[at[0] :] == 10) + at[0] + 1
            cuts = np.searchsorted(after, at, side="right")
            counts = np.diff(cuts) + 1
            first = np.concatenate([[0], np.cumsum(counts)])
            starts = np.zeros(first[-1], dtype=np.int64)
            lines = np.ones(first[-1], dtype=bool)
            lines[first[:-1]] = False  # a text's first line starts at 0
            starts[lines] = after[cuts[0] : cuts[-1]] - np.repeat(at[:-1], counts - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(starts)), pa.array(np.diff(at))], names=["path", "starts", "size"])

    return sources.where("text IS NOT NULL").select(F.col("path").cast("string").alias("path"), F.col("text").cast("binary").alias("text")).mapInArrow(run, INDEX)


def position(starts: Column, size: Column, offset: Column) -> Column:
    """struct(line, column) of a byte offset, from 1 and in bytes; past the end it is the end. Null without an index or an offset."""
    at = F.least(offset, size)
    # the number of starts at or before the offset, one bit after the other
    steps = F.filter(F.lit(STEPS), lambda p: p <= F.size(starts))
    line = F.aggregate(steps, F.lit(0), lambda n, p: F.when((n + p <= F.size(starts)) & (F.try_element_at(starts, n + p) <= at), n + p).otherwise(n))
    found = F.transform(F.array(line), lambda n: F.struct(n.cast("long").alias("line"), (at - F.try_element_at(starts, n) + 1).alias("column")))[0]
    return F.when(starts.isNotNull() & offset.isNotNull(), found)


def with_positions(rows: DataFrame, index: DataFrame, path: str, **offsets: str) -> DataFrame:
    """``rows`` with a position for each of ``offsets`` (new column: column of byte offsets), through one join with the index.

    Rows whose path has no index, and rows without an offset, get null. The index is one row a path.
    """
    own = index.select(F.col("path").alias("_index_path"), F.col("starts").alias("_index_starts"), F.col("size").alias("_index_size"))
    joined = rows.join(own, rows[path] == own["_index_path"], "left")
    spots = {name: position(F.col("_index_starts"), F.col("_index_size"), F.col(c)) for name, c in offsets.items()}
    return joined.select(*rows.columns, *(c.alias(name) for name, c in spots.items()))
