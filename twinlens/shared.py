"""Tables written between steps into the folder that driver and executors share, which cuts lineage without losing rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where none is set in a local session, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="twinlens-")
        spark.sparkContext.setCheckpointDir(found)
    return found


class Steps:
    """A folder of written tables, one a step."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark).rstrip('/')}/steps-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        path, schema = f"{self.base}/{self.n}", df.schema
        self.n += 1
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)
