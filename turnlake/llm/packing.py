"""Best-fit packing of documents into sequences, certified by lower bounds.

Each partition packs by best-fit decreasing and bounds from below, by dual
feasible functions over its lengths, how many sequences any packing needs.
Where the two differ, the partitions take the documents of their underfull
sequences out, exchange them and pack those again; a round counts only if it
needs fewer sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.arrowtext import blocks
from turnlake.llm.bpe import encoder
from turnlake.llm.common import only, prepare, stored

#: Pieces a partition packs, and rounds of exchange at most (a round that saves
#: nothing ends the exchange before).
PARTITION_PIECES, ROUNDS = 20_000, 4

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: longest first, into the fullest bin it fits."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_sizes, made = 0, 0  # bit f: some bin has f left
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = open_sizes >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                open_sizes &= ~(1 << left)
        else:
            left, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - left
        if left > size:
            free[left - size].append(b)
            open_sizes |= 1 << (left - size)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of the volume bound and two
    families of dual feasible functions, in whole numbers throughout."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    for k in range(1, 33):  # x -> floor((k+1) x) / k, x itself where (k+1) x is whole
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    for e in range(1, capacity // 2 + 1):  # above C - e: whole, below e: nothing
        value = np.where(size > capacity - e, capacity, np.where(size < e, 0, size))
        best = max(best, -(-int((count * value).sum()) // capacity))
    return best


def cut(total: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: the remainder, then full ones."""
    start = total % capacity or min(total, capacity)
    if start:
        yield 0, start
    while start < total:
        yield start, capacity
        start += capacity


def token_pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row): what has to be packed.

    ``row`` tells repeated document ids apart.  A null text counts as empty: its
    document is the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for block, data, offsets in blocks(batches):
            ids, before = coder.encode(data, offsets)
            wide = np.insert(ids, before[1:], end_id).astype("<u4")
            edge = (before + np.arange(len(before))).tolist()
            raw = memoryview(wide).cast("B") if len(wide) else memoryview(b"")
            out: list[list] = [[], [], [], [], [], []]
            for doc, row, a, b in zip(block.column(0).to_pylist(), block.column(2).to_pylist(), edge[:-1], edge[1:], strict=True):
                for k, (start, length) in enumerate(cut(b - a, capacity)):
                    at = a + start
                    for column, x in zip(out, (doc, k, start, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), row), strict=True):
                        column.append(x)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return only(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, _PIECES)


def pack_once(pieces: DataFrame, parts: int, capacity: int, turn: int) -> DataFrame:
    """Pack every partition on its own; partition, bin, its fill and the
    partition's bins and bound come with each piece."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        order = np.lexsort([group.column(c).fill_null(0).to_numpy() for c in ("piece", "row", "doc_id")])
        group = group.take(order)
        lengths = group.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        n, bound = len(fill), lower_bound(lengths, capacity)
        more = {"bin": bins, "offset": offsets, "fill": fill[bins], "bins": np.full(len(bins), n), "bound": np.full(len(bins), bound)}
        for name, values in more.items():
            group = group.append_column(name, pa.array(values, pa.int64()))
        return group

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "row", F.lit(turn)), F.lit(parts)).cast("int"))
    packed = dealt.groupBy("part").applyInArrow(run, _PIECES + ", part int, bin long, offset long, fill long, bins long, bound long")
    return packed.withColumn("turn", F.lit(turn))


def pack(pieces: DataFrame, capacity: int = 1024, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, row, sequence_id, offset,
    partition, bins, bound).

    ``pieces`` must be stored (it is read more than once).  Full pieces are
    sequences of their own.  Every piece is packed once; an empty table gives an
    empty result.  ``bins`` is the number of sequences of the piece's partition
    and ``bound`` the fewest that any packing of its pieces needs: where both are
    equal the partition is certified.  A partition that still has a gap after
    ``rounds``, or when a round has saved nothing, says so by them.
    """
    prepare(pieces.sparkSession)
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
    full = pieces.filter(F.col("length") == capacity).select(*keep, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(-1).cast("long").alias("partition"), F.lit(1).cast("long").alias("bins"), F.lit(1).cast("long").alias("bound"))
    partial = pieces.filter(F.col("length") < capacity)
    parts = max(1, -(-partial.count() // partition_pieces))
    packed = stored(pack_once(partial, parts, capacity, 0), "packing")
    for turn in range(1, rounds + 1):
        gaps = packed.groupBy("turn", "part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"), F.min("fill").alias("least"))
        sums = gaps.agg(F.count("*").alias("parts"), F.count_if(F.col("bins") > F.col("bound")).alias("open")).first()
        spare = packed.filter(F.col("offset") == 0).agg(F.sum(F.lit(capacity) - F.col("fill"))).first()[0] or 0
        if not sums["open"] and spare < capacity:
            break  # every partition and the whole are certified
        # A partition with a gap releases its underfull sequences, any other its emptiest.
        marks = gaps.select("turn", "part", (F.col("bins") > F.col("bound")).alias("gap"), "least")
        loose = (F.col("gap") & (F.col("fill") < capacity)) | (F.col("fill") == F.col("least"))
        marked = packed.join(marks, ["turn", "part"]).withColumn("loose", loose & (F.col("fill") < capacity))
        released = stored(marked.filter("loose").select(*keep, "fill", "offset"), "released")
        facts = released.agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("bins")).first()
        if facts["bins"] < 2:
            break
        again = stored(pack_once(released.select(*keep), max(1, -(-facts["n"] // (2 * partition_pieces))), capacity, turn), "packing")
        if again.filter(F.col("offset") == 0).count() >= facts["bins"]:
            break
        # What stays is certified: full sequences alone of a partition with a gap; of any other
        # all but r of n sequences, and if those needed fewer than n - r, the n weren't needed.
        left = marked.filter(~F.col("loose")).drop("gap", "least", "loose", "bins", "bound")
        counted = left.groupBy("turn", "part").agg(F.count_if(F.col("offset") == 0).alias("bins"))
        rest = left.join(counted, ["turn", "part"]).withColumn("bound", F.col("bins"))
        packed = stored(rest.unionByName(again), "packing")
    partition = F.col("turn").cast("long") * (1 << 24) + F.col("part")
    return packed.select(*keep, (partition * (1 << 32) + F.col("bin")).alias("sequence_id"), "offset", partition.alias("partition"), "bins", "bound").unionByName(full)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize whole texts, cut what is longer than a sequence, pack."""
    prepare(docs.sparkSession)
    return pack(stored(token_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces"), capacity)
