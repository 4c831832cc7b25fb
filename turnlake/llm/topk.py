"""Exact top-k search by term-at-a-time accumulation over a grid of blocks.

Candidates are dealt into blocks, queries into groups, and each (block, group)
cell scores all its pairs: the block's vectors become postings by component,
and each component of the query rows adds its weighted postings into dense
score arrays.  A cell keeps k rows a query; the cells' rows are merged by rank.
Both sides of a cell are bounded by parameters; the queries are a stated set.
An exhaustive search scores every pair, so what is moved grows with candidates
times queries, divided by the rows of a block or a group: both are as large as a
worker's memory allows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.common import prepare

#: Candidates of a block, queries of a group, scores held at once.
BLOCK_ROWS, GROUP_ROWS, SCORES = 32_768, 32_768, 1 << 20


def usable(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector.cast("array<double>"), finite), F.lit(False))


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, with x as a double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))


def dense(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of equal width; a shorter vector has zeros for what it lacks."""
    lists = lists.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def postings(block: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, weights) of each component (term); zeros are no postings."""
    terms = np.ascontiguousarray(block.T)
    return [(rows, term[rows]) for term in terms for rows in [np.flatnonzero(term)]]


def accumulate(queries: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], rows: int) -> np.ndarray:
    """Inner products, one term at a time: each query that has the term scatters
    its postings, weighted, into the query's score array."""
    scores = np.zeros((len(queries), rows), np.int64)
    for term, (at, weights) in enumerate(lists):
        for q in np.flatnonzero(queries[:, term]).tolist():
            if len(at) == rows:
                scores[q] += queries[q, term] * weights
            else:
                scores[q, at] += queries[q, term] * weights
    return scores


def best(scores: np.ndarray, open_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best open cells of each row; ties: first columns."""
    scores = np.where(open_, scores, np.iinfo(np.int64).min)
    n = scores.shape[1]
    k = min(k, n)
    floor = np.partition(scores, n - k, axis=1)[:, n - k]
    above = scores > floor[:, None]
    level = scores == floor[:, None]
    room = k - above.sum(1)
    keep = (above | (level & (np.cumsum(level, 1) <= room[:, None]))) & open_
    return np.nonzero(keep)


def _cells(k: int):
    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
        if block.num_rows and queries.num_rows:
            block = block.sort_by("vec_id")
            width = max(int(np.max(np.diff(t.column("v").combine_chunks().offsets.to_numpy()), initial=0)) for t in (block, queries))
            vectors, ids = dense(block.column("v"), width), block.column("vec_id").to_numpy()
            asked, query_ids = dense(queries.column("v"), width), queries.column("query_id").to_numpy()
            lists, step = postings(vectors), max(1, SCORES // len(ids))
            for at in range(0, len(asked), step):
                own = query_ids[at : at + step]
                scores = accumulate(asked[at : at + step], lists, len(ids))
                row, column = best(scores, own[:, None] != ids[None, :], k)
                out.append(np.stack([own[row], ids[column], scores[row, column]]))
        found = np.concatenate(out, 1)
        return pa.table({"query_id": found[0], "vec_id": found[1], "score": found[2]})

    return run


def exact_topk(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query.

    ``queries`` is (query_id, v array<long>), ``candidates`` (vec_id, v); ids
    that are null take no part, a query's own id is no candidate of it, ties go
    to the smaller vec_id.  A query id that occurs again is asked once, with the
    least of its vectors; repeated candidate rows are candidates each.  With fewer than k candidates all are
    returned, with none no row.  Sums are 64-bit and wrap beyond.
    """
    spark = prepare(candidates.sparkSession)
    queries = queries.filter("query_id IS NOT NULL").groupBy("query_id").agg(F.min("v").alias("v"))
    candidates = candidates.filter("vec_id IS NOT NULL")
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, asked = candidates.count(), queries.count()
    blocks, groups = max(1, min(parallel, -(-n // 512)), -(-n // BLOCK_ROWS)), max(1, -(-asked // GROUP_ROWS))
    cell = "cell"
    left = candidates.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key = (F.col("block").cast("long") * groups + F.col("group")).alias(cell)
    found = left.select(key, "vec_id", "v").groupBy(cell).cogroup(right.select(key, "query_id", "v").groupBy(cell)).applyInArrow(_cells(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
