import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.data import frame, rows
from turnlake.llm.common import new_path
from turnlake.llm.queries import op11_external_shuffle
from turnlake.llm.sharding import digests, read_shards, write_shards

SF = "/root/testdata/sf0.001"


def _made(spark, docs, **more):
    target = new_path(spark, "shards")
    n = write_shards(docs, target, **more)
    return n, read_shards(spark, target, docs)


def _lawful(found, n, shards=16):
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1


@pytest.mark.parametrize("bucket_bytes", [200, 5_000, 16 << 20])
def test_every_record_once(spark, bucket_bytes):
    docs = frame(spark)
    n, out = _made(spark, docs, bucket_bytes=bucket_bytes)
    found = out.collect()
    _lawful(found, n)
    key = lambda r: (r.doc_id is None, r.doc_id, r.text or "", r.part, r.bucket)
    assert sorted(map(key, found)) == sorted(map(key, docs.collect())) and {r.lang for r in found} == {None}


def test_digests(spark):
    docs = frame(spark, repeat=False).select("doc_id", "text")
    _, out = _made(spark, docs, bucket_bytes=3_000)
    texts = dict(rows())
    for r in digests(out).collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_same_order_however_dealt(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    place = lambda df, **more: sorted((r.shard, r.slot, r.doc_id) for r in _made(spark, df, bucket_bytes=20_000, **more)[1].collect())
    first = place(docs)
    assert first == place(docs.repartition(7, "text").orderBy(F.desc("doc_id")))
    assert first != place(docs, seed=12)


def test_order_is_uniform(spark):
    """Where 2,000 rows land tells nothing of where they were: their ids in 20
    stretches of the new order are spread as draws are (chi-square, 361 cells)."""
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"))
    _, out = _made(spark, docs, bucket_bytes=2_500)
    found = sorted((r.shard, r.slot, r.doc_id) for r in out.collect())
    cells = defaultdict(int)
    for at, (_, _, i) in enumerate(found):
        cells[at // 100, i // 100] += 1
    assert sum((cells[a, b] - 5) ** 2 / 5 for a in range(20) for b in range(20)) < 460


def test_nothing_and_less_than_a_row_a_shard(spark):
    n, out = _made(spark, frame(spark, [], repeat=False))
    assert n == 0 and out.count() == 0
    n, out = _made(spark, frame(spark, rows()[:3], repeat=False))
    _lawful(out.collect(), 3)


def test_own_columns_clash(spark):
    with pytest.raises(ValueError):
        write_shards(spark.range(2).selectExpr("id AS doc_id", "'x' AS text", "1 AS Shard"), new_path(spark, "shards"))


def test_query_runs_no_python(spark):
    out = op11_external_shuffle(spark, SF)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    _lawful(out.collect(), spark.read.parquet(f"{SF}/documents.parquet").count())
