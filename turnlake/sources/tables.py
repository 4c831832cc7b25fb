"""Reading and writing relations: Parquet, CSV, JSON lines, JSON documents."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.sources.session import importable

_FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".jsonl": "json"}

TURN = "struct<speaker:string,text:string>"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: list[str] | None = None, required: bool = True, fmt: str | None = None) -> DataFrame:
    """Read by suffix.  A relation that isn't required and isn't there is an
    empty frame of ``schema``; an unknown suffix is an error."""
    kind = fmt or _FORMATS.get(Path(path).suffix.lower())
    if kind is None:
        raise ValueError(f"no reader for {path}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not required and not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema or T.StructType([]))
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df.select(*columns) if columns else df


def read_many(spark: SparkSession, pattern: str) -> DataFrame:
    """All Parquet files of a glob; columns that a file lacks are null in it."""
    return spark.read.option("mergeSchema", True).parquet(pattern)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A table as read, over all cores: files that hold fewer row groups than
    there are cores are dealt anew, any other table is left where it lies."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def decode_turns(cell: str = "structured_content") -> F.Column:
    """array<struct<speaker,text>> of a JSON cell; a cell that isn't JSON is one
    turn of an unknown speaker, a null or blank one has no turns."""
    parsed = F.from_json(cell, f"array<{TURN}>")
    single = F.array(F.struct(F.lit("Unknown").alias("speaker"), F.col(cell).alias("text")))
    broken = parsed.isNull() | F.exists(F.coalesce(parsed, F.array()), lambda t: t.isNull())
    return F.when(F.col(cell).isNull() | (F.trim(cell) == ""), F.array().cast(f"array<{TURN}>")).when(broken, single).otherwise(parsed)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Nested columns stay nested."""
    df.write.mode("overwrite").json(path)


def _place(spark: SparkSession, path: str):
    """(file system, path) of a path of any store that Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def write_json(content: dict, path: str, spark: SparkSession | None = None) -> None:
    """A document, written where Spark writes: the folder is made, a file that is
    there is replaced."""
    files, place = _place(spark or SparkSession.active(), path)
    stream = files.create(place, True)
    try:
        stream.write(bytearray(json.dumps(content, indent=2, sort_keys=True, default=str).encode()))
    finally:
        stream.close()


def read_json(path: str, spark: SparkSession | None = None) -> dict | None:
    """The document, or None if there is none or it isn't one."""
    spark = spark or SparkSession.active()
    files, place = _place(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        text = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        return None
    return found if isinstance(found, dict) else None


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, sha256) of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"))


def digest(path: str) -> str:
    found = hashlib.sha256()
    with open(path, "rb") as file:
        while block := file.read(1 << 20):
            found.update(block)
    return found.hexdigest()


def content_digest(df: DataFrame) -> str:
    """A digest of the rows and columns of a table, in one pass: the same
    whatever the order of rows and however many files hold them."""
    row = F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) if t.startswith(("map", "variant")) else F.col(f"`{c}`") for c, t in df.dtypes], F.concat_ws(",", *[F.col(f"`{c}`").isNull().cast("string") for c in df.columns]))
    n, mixed, total = df.select(row.alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((df.dtypes, n, mixed, total and int(total))).encode()).hexdigest()


def code_digest() -> str:
    """A digest of the package's own sources."""
    root, found = Path(__file__).resolve().parents[1], hashlib.sha256()
    for file in sorted(p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts):
        found.update(str(file.relative_to(root)).encode() + b"\0" + file.read_bytes())
    return found.hexdigest()


FINGERPRINT = "_fingerprint.json"


def materialised(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False, inputs: dict[str, str] | None = None) -> DataFrame:
    """Write a stage once: an output that is there is read unless forced.

    With ``inputs``, digests of what the stage is made from (tables, parameters,
    code), they are kept beside the output, and an output made from others is made
    anew.  An output that was cut short has no digests and is made anew too.
    """
    files, done = _place(spark, path + "/_SUCCESS")
    kept = f"{path}/{FINGERPRINT}"
    stale = inputs is not None and read_json(kept, spark) != inputs
    if force or stale or not files.exists(done):
        make().write.mode("overwrite").parquet(path)
        if inputs is not None:
            write_json(inputs, kept, spark)
    return spark.read.parquet(path)


def first_rows(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """A development sample: the first n rows by key."""
    return df.orderBy(*key).limit(n)
