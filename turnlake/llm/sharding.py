"""Sharding by a two-pass external shuffle.

The first pass scatters records uniformly, by a seeded hash of all they hold,
into buckets that fit in memory.  The second sets each bucket in an order that
only its records decide, puts a Fisher-Yates shuffle on it (``shuffle`` is that,
seeded by the bucket's number) and writes it.  All buckets one after another are
the shuffled table, which is cut into shards whose row counts differ by at most
one.  DataFrame functions alone; a bucket is the most that a task ever holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnlake.llm.common import new_path, shuffles_freed

#: Bytes of text in a bucket, on average; a bucket is a task of the second pass,
#: which holds it some three times.  A longer text fills a bucket by itself.
BUCKET_BYTES = 16 << 20


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text, none of a null, and one more."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def write_shards(docs: DataFrame, target: str, shards: int = 16, seed: int = 11, bucket_bytes: int = BUCKET_BYTES, text_col: str = "text") -> int:
    """Write all rows and columns of ``docs``, shuffled, to ``target``/shard=N as
    Parquet with ``slot``, the gapless place in the shard; returns the row count.

    The result depends on rows, seed and bucket_bytes alone, not on how the
    table is dealt over tasks.  Nulls in any column, empty texts and equal texts
    are records like others; rows alike in every column share a bucket, being
    one record to a hash.  An empty table gives an empty folder.  Columns named
    ``shard`` or ``slot`` are an error, other names are free; a column that
    can't be ordered (a map) is an error of Spark.
    """
    if clash := {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns of the result: {sorted(clash)}")
    spark = docs.sparkSession
    own = [F.col(f"`{c}`") for c in docs.columns]
    records = docs.select(F.struct(*own).alias("record"), text_size(F.col(f"`{text_col}`")).alias("size"))
    rows, size = records.agg(F.count("*"), F.sum("size")).first()
    buckets = max(1, -(-(size or 0) // bucket_bytes))
    hashed = records.select("record", F.xxhash64(F.lit(seed), "record").alias("h"))
    # Uniform over the buckets; what is left of the hash orders a bucket.
    scattered = hashed.select(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"), F.struct("h", "record").alias("item"))
    counts = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    none = F.lit(None).cast(scattered.schema["item"].dataType)
    before = F.sum("n").over(Window.orderBy("bucket")) - F.col("n")  # over one row a bucket
    bases = counts.select("bucket", none.alias("item"), before.alias("base"))
    # A bucket's rows and how many rows stand before it meet in one exchange; the
    # partition is the bucket, so that the shuffle's seed is seed + bucket.
    met = scattered.withColumn("base", F.lit(None).cast("long")).unionByName(bases).repartitionById(buckets, F.col("bucket"))
    held = met.groupBy("bucket").agg(F.collect_list("item").alias("items"), F.max("base").alias("base"))
    placed = held.select("base", F.posexplode(F.shuffle(F.sort_array("items"), seed)).alias("place", "item")).select("item.record", (F.col("base") + F.col("place")).alias("g"))
    # Shard s has the places from s * rows div shards on.
    dealt = placed.withColumn("shard", F.expr(f"int(((g + 1) * {shards} - 1) div {max(rows, 1)})"))
    out = dealt.select(*[F.col("record")[c].alias(c) for c in docs.columns], "shard", F.expr(f"g - (shard * {rows}L) div {shards}").alias("slot"))
    with shuffles_freed(spark):
        out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(target)
    return rows


def read_shards(spark: SparkSession, target: str, docs: DataFrame) -> DataFrame:
    """The written rows with ``shard`` and ``slot``; ``docs`` gives the schema,
    which an empty folder can't."""
    return spark.read.schema(T.StructType([*docs.schema, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])).parquet(target)


def digests(records: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of written rows;
    rows are what the shards have alike, at most one more or less."""
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0))
    return records.select("doc_id", text_size(F.col("text")).alias("size"), crc.cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame, shards: int = 16, seed: int = 11) -> DataFrame:
    """Write the shards of (doc_id, text) to the shared folder, and the digests
    of what is read back."""
    target = new_path(docs.sparkSession, "shards")
    write_shards(docs, target, shards, seed)
    return digests(read_shards(docs.sparkSession, target, docs))

