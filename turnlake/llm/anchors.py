"""Content-chosen anchors: which places of which texts can repeat elsewhere.

Every window of W units (bytes or words) has one anchor, the leftmost of its
k-unit strings whose hash is least.  Equal windows have equal anchors at equal
places, so two texts can share a window only where they share an anchor, and
windows with neighbouring starts mostly share theirs: a run of windows with one
anchor is handled as one unit.  No window is left out and nothing is sampled.

A part of the corpus counts its anchors before anything is sent: the exchange
has one row for each distinct anchor of a part, so the commonest line there is
costs one row a part, and only the hashes that repeat come back.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.arrowtext import blocks

#: Bytes of text in one part of the corpus, and parts for each core of the cluster at least.
PART_BYTES, PARTS_A_CORE = 8 << 20, 2

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a followed by b."""
    h = a * _C1
    h += b
    h *= _C2
    h ^= h >> np.uint64(29)
    return h


def rolled(units: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k units from each place; shorter by k - 1."""
    power, size, out, have = units, 1, None, 0
    while k:
        if k & 1:
            if out is None:
                out, have = power, size
            else:
                n = max(len(units) - have - size + 1, 0)
                out = combine(out[:n], power[have : have + n])
                have += size
        k >>= 1
        if k:
            n = max(len(power) - size, 0)
            power = combine(power[:n], power[size : size + n])
            size *= 2
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours; shorter by width - 1."""
    if len(values) < width:
        return values[:0]
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def window_runs(units: np.ndarray, offsets: np.ndarray, k: int, width: int) -> dict[str, np.ndarray]:
    """Runs of windows that share an anchor: document index, anchor place, first
    and last window start (places within the block) and the anchor's hash."""
    nothing = {c: np.zeros(0, np.int64) for c in ("doc", "anchor", "first", "last")} | {"hash": np.zeros(0, np.uint64)}
    if len(units) < width:
        return nothing
    hashes = rolled(units, k)
    place = np.arange(len(hashes), dtype=np.uint64)
    least = sliding_min((hashes & np.uint64(0xFFFFFFFF00000000)) | place, width - k + 1)
    at = least.astype(np.uint32)  # the anchor's place
    lead = offsets[:-1][offsets[1:] - offsets[:-1] >= width]
    # A run begins with a document and where the anchor changes, and ends before the next or with the last window.
    head = np.union1d(np.flatnonzero(at[1:] != at[:-1]) + 1, lead)
    if not len(lead):
        return nothing
    doc = np.searchsorted(offsets, head, side="right") - 1
    final = offsets[doc + 1] - width
    last = np.minimum(np.append(head[1:] - 1, len(units)), final)
    fits = head <= final
    anchor = at[head[fits]].astype(np.int64)
    return {"doc": doc[fits], "anchor": anchor, "first": head[fits], "last": last[fits], "hash": hashes[anchor]}


def part_of(doc_id: np.ndarray, parts: int) -> np.ndarray:
    return (doc_id ^ (doc_id >> 15)) % parts


def part_column(doc_id: Column, parts: int) -> Column:
    """The same as part_of, in Spark."""
    return F.pmod(doc_id.bitwiseXOR(F.shiftright(doc_id, 15)), F.lit(parts)).cast("int")


def part_count(docs: DataFrame, part_bytes: int | None = None) -> int:
    """Parts of PART_BYTES of text: they grow with the corpus, and are never
    fewer than keep the cluster busy."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // (part_bytes or PART_BYTES)), PARTS_A_CORE * docs.sparkSession.sparkContext.defaultParallelism)


def placed(docs: DataFrame, parts: int) -> DataFrame:
    """With the number of its part; rows without an id are in part 0."""
    return docs.withColumn("part", F.coalesce(part_column(F.col("doc_id"), parts), F.lit(0)))


def packed(columns: list[np.ndarray | list[bytes]]) -> bytes:
    """Columns of equal length as one blob: a few bytes of header a column, so
    that a blob of one row costs little more than the row."""
    out = [struct.pack("<BI", len(columns), len(columns[0]))]
    for c in columns:
        if isinstance(c, list):
            out += [b"\0", np.fromiter(map(len, c), "<i4", len(c)).tobytes(), *c]
        else:
            out += [c.dtype.char.encode(), np.ascontiguousarray(c).tobytes()]
    return b"".join(out)


def unpacked(blob: bytes) -> list[np.ndarray | list[bytes]]:
    """The columns of one blob."""
    many, rows = struct.unpack_from("<BI", blob)
    at, out = 5, []
    for _ in range(many):
        kind, at = blob[at : at + 1], at + 1
        if kind == b"\0":
            size = np.frombuffer(blob, "<i4", rows, at)
            edge = (at + 4 * rows + np.concatenate([[0], np.cumsum(size, dtype=np.int64)])).tolist()
            out.append([blob[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)])
            at = edge[-1]
        else:
            out.append(np.frombuffer(blob, np.dtype(kind.decode()), rows, at))
            at += out[-1].nbytes
    return out


def joined(blobs: pa.ChunkedArray) -> list[np.ndarray]:
    """The columns, all of numbers, of many blobs, one after the other."""
    return [np.concatenate(c) for c in zip(*(unpacked(b) for b in blobs.to_pylist()), strict=True)]


def dealt(key: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """One blob for each value of ``key``, rows in their order."""
    order = np.argsort(key, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0, [True]])) if len(key) else np.zeros(1, np.int64)
    columns = [c[order] for c in columns]
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(key[order[a]]), packed([c[a:b] for c in columns])


def own_blocks(docs: pa.Table, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, fresh, bytes, offsets) of a part's documents in the order of their
    ids; null ids are left out, and of rows that repeat an id the first is fresh."""
    docs = docs.filter(pc.is_valid(docs.column("doc_id"))).combine_chunks()
    docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending")]))
    seen = None
    for block, data, offsets in blocks(iter(pa.table({"doc_id": docs.column("doc_id"), "text": docs.column("text")}).combine_chunks().to_batches()), limit=limit):
        ids = block.column(0).to_numpy()
        fresh = np.concatenate([[ids[0] != seen], ids[1:] != ids[:-1]])
        seen = ids[-1]
        yield ids, fresh, data, offsets


def fresh_runs(runs: dict[str, np.ndarray], fresh: np.ndarray, wanted: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The runs of fresh documents, and of ``wanted`` (sorted) anchors alone."""
    keep = fresh[runs["doc"]]
    if wanted is not None:
        keep &= wanted[np.minimum(np.searchsorted(wanted, runs["hash"]), len(wanted) - 1)] == runs["hash"] if len(wanted) else False
    return {c: x[keep] for c, x in runs.items()}


def repeated_anchors(docs: DataFrame, find: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], limit: int) -> DataFrame:
    """(part int, hash long, n long) of placed documents: for each part, those of
    its anchors that occur at least twice in the corpus, and how often there."""

    def count(group: pa.Table) -> pa.Table:
        held, part = [np.zeros(0, np.uint64)], group.column("part")[0].as_py()
        for _, fresh, data, offsets in own_blocks(group, limit):
            held.append(fresh_runs(find(data, offsets), fresh)["hash"])
        own, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.table({"part": pa.array(np.full(len(own), part, np.int32)), "hash": pa.array(own.view(np.int64)), "n": pa.array(n.astype(np.int64))})

    rows = docs.groupBy("part").applyInArrow(count, "part int, hash long, n long")
    return rows.withColumn("n", F.sum("n").over(Window.partitionBy("hash"))).filter("n > 1")
