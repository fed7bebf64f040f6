"""Helpers shared by the training-data operators: table access, shared-folder writes, Arrow batch limits."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that an Arrow batch may carry into a Python worker; whole texts make rows large.
ARROW_ROWS = 512
ARROW_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data directory, read by Spark so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def limit_arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> None:
    """Lower the Arrow batch sizes of the session, in rows and bytes, when they are larger; they are never raised."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where none is set in a local session, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="twinlens-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, by: str, ways: int = 8) -> DataFrame:
    """Inner join of ``rows`` with one row a key, where a hot key's rows go to ``ways`` places by the column ``by``.

    ``per_key`` is repeated that often; both sides are dealt anew, so a place that is still too large can be split at run time.
    """
    left = rows.withColumn("_way", F.pmod(F.xxhash64(by), F.lit(ways)))
    right = per_key.withColumn("_way", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ways - 1).cast("long"))))
    return left.join(right, [key, "_way"]).drop("_way")


class Scratch:
    """Tables written once into the shared folder and read back, which cuts lineage without losing rows to a lost executor."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark).rstrip('/')}/twinlens-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        path, schema = f"{self.base}/{self.n}", df.schema
        self.n += 1
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._twinlens_path, out._twinlens_rows = path, seen.get["n"]
        return out

    def tidy(self) -> None:
        """Ask the driver to collect its garbage.

        Shuffle files, broadcasts and plans of steps that are over are freed only then; many short jobs seldom fill its memory.
        """
        gc.collect()
        self.spark._jvm.System.gc()

    def rows(self, df: DataFrame) -> int:
        """How many rows a table of this scratch has, as counted while it was written."""
        return df._twinlens_rows

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this scratch that no later plan reads."""
        for df in tables:
            path = getattr(df, "_twinlens_path", None)
            if path:
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
