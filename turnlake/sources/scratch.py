"""Steps of iterative work, written to the folder that a cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and the session runs on this
    machine alone, as in tests, a temporary folder.  A cluster without it is an
    error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="turnlake-"))
        context.setCheckpointDir(found)
    return found.rstrip("/")


class Steps:
    """Tables written on the way of an iteration: lineage ends at each, so a lost
    executor costs no step that is written, and ``clear`` deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/{what}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []
