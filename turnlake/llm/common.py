"""Session helpers of the subpackage: shared storage, Python path, table scans."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the driver was started.

    An installed package needs nothing; a plain checkout is put on the workers'
    path.  AQE may split the skewed side of a join (its default), nothing else
    of the session is changed.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is spark.checkpoint.dir of the session; only where that is unset and the
    session runs on this machine alone, as in tests, a temporary folder is made
    and set.  A cluster without the setting is an error.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        found = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="turnlake-"))
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of an action go when it ends."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def stored(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, and
    a lost executor costs no recomputation of what is already written."""
    path = new_path(df.sparkSession, what)
    with shuffles_freed(df.sparkSession):
        df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


class Scratch:
    """Tables that only steps on the way read: ``clear`` deletes their files,
    once what was made from them is stored itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, what: str, **options: str) -> DataFrame:
        out = stored(df, what, **options)
        self.paths.append(out._stored_at)
        return out

    def clear(self) -> None:
        for path in self.paths:
            deleted(self.spark, path)
        self.paths = []


def deleted(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def only(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and the text under their fixed names; other columns, whatever
    their names, take no part."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
