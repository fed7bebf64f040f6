"""Whitening of embeddings: components of falling variance, each scaled to variance one, from exactly centred rows.

Entries become whole numbers, so sums and centred rows are exact: with n distinct vectors x and sums S, a centred row is
(n * x - S) / n, and n * x - S is a whole number. MLlib's RowMatrix adds up the products of centred rows (a matrix of dimension
by dimension, whatever the number of rows), a local ``eigh`` gives the components, and the projection is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, limit_arrow_batches

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows that are projected at once.
SLICE = 4096
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Space:
    """What whitens vectors of one length: rows and sums of the fit, the projection (a column a component), shares of variance."""

    n: int
    sums: np.ndarray
    projection: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as whole numbers; Python's where 64 bits might not hold them."""
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.sums.tolist()), default=0)
        x = x if most < 1 << 62 else x.astype(object)
        return self.n * x - self.sums

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Exact sums of squares; null beyond 64 bits."""
        most = max(abs(int(centred.max(initial=0))), abs(int(centred.min(initial=0))))
        wide = centred if most * most * max(1, centred.shape[1]) < 1 << 63 else centred.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (wide * wide).sum(axis=1)]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.projection


def whole_numbers(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of each entry."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long") + F.lit(SHIFT))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def gramian(rows: DataFrame) -> np.ndarray:
    """The sum of products over rows (one column of array<double>), by MLlib inside the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(F.col(rows.columns[0])).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray()


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Space]:
    """A Space for each length among the written, distinct vectors ``x``. Vectors without entries have none."""
    counts = {r["d"]: r["n"] for r in distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).where("d > 0").collect()}
    sums = {d: np.zeros(d, dtype=np.int64) for d in counts}
    for r in distinct.select(F.size("x").alias("d"), F.posexplode("x").alias("i", "c")).groupBy("d", "i").agg(F.sum("c").alias("s")).collect():
        sums[r["d"]][r["i"]] = r["s"]
    out = {}
    for d, n in counts.items():
        own = distinct.where(F.size("x") == d)
        exact = F.zip_with("x", F.lit(sums[d].tolist()), lambda c, s: (F.lit(n).cast("long") * c - s).cast("double") / F.lit(float(n)))
        covariance = gramian(own.select(exact.alias("v"))) / n
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:components]
        e, trace = values[order], float(np.trace(covariance))
        # a direction without variance has no scale: its values are null
        flat = e <= d * np.finfo(np.float64).eps * max(float(values.max()), 0.0)
        projection = np.where(flat, np.nan, vectors[:, order] / np.sqrt(np.where(flat, 1.0, e)))
        explained = np.clip(e, 0.0, None) / trace if trace > 0 else np.full(len(e), np.nan)
        out[d] = Space(n, sums[d], projection, explained)
    return out


def _projected(rows: DataFrame, space: Space) -> DataFrame:
    """(v): the whitened values of vectors ``x``, of the components that have a variance."""
    shared = rows.sparkSession.sparkContext.broadcast(space)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        used = ~np.isnan(own.projection).any(axis=0)
        for f in frames:
            for at in range(0, len(f), SLICE):
                x = np.stack(f["x"].iloc[at : at + SLICE].to_list())
                yield pd.DataFrame({"v": list(own.whitened(own.centred(x))[:, used])})

    return rows.select("x").mapInPandas(run, "v array<double>")


def identity_error(rows: DataFrame, space: Space) -> float | None:
    """The largest absolute entry of the whitened fit's covariance minus the identity; null without a component of any variance."""
    if np.isnan(space.projection).any(axis=0).all():
        return None
    white = _projected(rows, space)
    vectors = MLUtils.convertVectorColumnsFromML(white.select(array_to_vector("v").alias("v")), "v")
    mean = RowMatrix(vectors).computeColumnSummaryStatistics().mean()
    centred = white.select(F.zip_with("v", F.lit([float(m) for m in mean]), lambda c, m: c - m).alias("v"))
    covariance = gramian(centred) / space.n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable vector and component.

    Null vectors and vectors with null or non-finite entries are dropped; the fit takes each distinct vector once, so copies,
    however many, weigh nothing. Every row is returned, repeated ones and null ids too. Vectors of another length are a space of
    their own with its own fit; vectors without entries have no components. A component without variance (all, for one distinct
    vector) has null ``whitened``, and null ``explained`` where there is no variance at all. Sums of squares beyond 64 bits are
    null. Other columns are not read; an empty table gives no rows. Entries of 10**12 and more are too large for exact sums and
    raise an arithmetic error.
    """
    spark = vectors.sparkSession
    limit_arrow_batches(spark, rows=SLICE)
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").cast("string").alias("vec_id"), whole_numbers(F.col(vector_col)).alias("x"))
    distinct = Scratch(spark).write(rows.select("x").distinct())
    spaces = {}
    for d, s in fit(distinct, components).items():
        error = identity_error(distinct.where(F.size("x") == d), s)
        spaces[d] = Space(s.n, s.sums, s.projection, s.explained, error)
    shared = spark.sparkContext.broadcast(spaces)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for d, part in f.groupby(f["x"].map(len), sort=False):
                own = shared.value.get(d)
                for at in range(0, len(part) if own else 0, SLICE):
                    some = part.iloc[at : at + SLICE]
                    y = own.centred(np.stack(some["x"].to_list()))
                    k = own.projection.shape[1]
                    yield pd.DataFrame({
                        "vec_id": some["vec_id"].repeat(k).array, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(some)), "n": own.n,
                        "deviation": pd.array(own.deviations(y), dtype="Int64").repeat(k), "whitened": own.whitened(y).ravel(),
                        "explained": np.tile(own.explained, len(some)), "identity_error": own.identity_error,
                    })

    # ids travel as text: pandas would make floats of long ids beside nulls
    out = rows.mapInPandas(run, SCHEMA.replace("vec_id long", "vec_id string"))
    return out.withColumn("vec_id", F.col("vec_id").cast("long"))
