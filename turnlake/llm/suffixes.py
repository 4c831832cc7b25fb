"""Substring deduplication over bytes by a distributed suffix merge sort.

The suffixes that take part begin at anchors that occur more than once, so
every repeated W-byte string lies around one of them.  A part of the corpus
sorts its suffixes into runs, front-codes each run (a suffix is stored as the
length of the prefix it shares with the one before, and the rest) and sends it
to the bucket of its anchor string.  A bucket merges the runs in a loser tree
whose matches carry common prefix lengths: two suffixes that share different
lengths with the last winner are ordered by those lengths alone, and equal
lengths are compared only from there on.

The repeats are read off the common prefix lengths alone.  A window that begins
a bytes before its anchor is the same in two suffixes if no neighbour between
them in the merged order shares fewer than W - a bytes, and if the a bytes
before their anchors are equal, which the order of those bytes, read backwards,
and its common prefix lengths tell in the same way.  Nothing is hashed for that.
An anchor that occurs very often goes into the same merge as the W-byte suffixes
at each of its window starts, so that its occurrences spread over all buckets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.anchors import fresh_runs, own_blocks, packed, part_column, part_count, placed, repeated_anchors, rolled, unpacked, window_runs
from turnlake.llm.arrowtext import binary_slices, blocks, ragged
from turnlake.llm.common import only, prepare

#: Bytes of an anchor, and of text hashed at once (fits a core's cache).
ANCHOR_BYTES, BLOCK = 32, 256 << 10

#: An anchor that occurs more often is sent by window, spread over all buckets.
HOT_ANCHOR = 30_000


def _values() -> np.ndarray:
    """Random 64-bit value of each byte, from a fixed seed."""
    return np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def _find(width: int):
    value = _values()

    def find(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        return window_runs(value[data], offsets, min(ANCHOR_BYTES, width), width)

    return find


def shared_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, of which ``start`` bytes are known."""
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    low, high = start, n
    while high - low > 8:  # the first difference is in [low, high)
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    while a[low] == b[low]:
        low += 1
    return low


def front_coded(suffixes: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """(length shared with the one before, the rest) of sorted suffixes."""
    shared = np.zeros(len(suffixes), np.int32)
    for i in range(1, len(suffixes)):
        shared[i] = shared_prefix(suffixes[i - 1], suffixes[i])
    return shared, [s[k:] for s, k in zip(suffixes, shared.tolist(), strict=True)]


class Run:
    """A front-coded run, decoded one suffix at a time: what each shares with the
    one before, the rest, the bytes before it, its document and its place, and
    the other places of the same bytes."""

    def __init__(self, blob: bytes):
        shared, self.rest, self.left, doc, place, self.others = unpacked(blob)
        self.shared, self.doc, self.place = shared.tolist(), doc.tolist(), place.tolist()
        self.at, self.suffix = -1, b""

    def step(self) -> bool:
        self.at += 1
        if self.at == len(self.rest):
            return False
        self.suffix = self.suffix[: self.shared[self.at]] + self.rest[self.at]
        return True


def merged(runs: list[Run]):
    """Yield (run, length shared with the suffix yielded before), in order.

    ``known[i]`` is the length that run i's suffix shares with the last winner;
    it is kept right in the nodes of the tree as losers are parked there.
    """
    k = len(runs)
    alive = [r.step() for r in runs]
    known = [0] * k
    tree = [-1] * k

    def wins(a: int, b: int) -> bool:
        """Whether run a's suffix comes before b's; the loser's length becomes
        the one it shares with the winner."""
        if not alive[a] or not alive[b]:
            return alive[a]
        if known[a] != known[b]:  # the longer share with the last winner is smaller
            return known[a] > known[b]
        x, y = runs[a].suffix, runs[b].suffix
        same = shared_prefix(x, y, known[a])
        if same == min(len(x), len(y)):
            first = len(x) < len(y) or (len(x) == len(y) and a < b)
        else:
            first = x[same] < y[same]
        known[b if first else a] = same
        return first

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        if not wins(a, b):
            a, b = b, a
        tree[node] = b
        return a

    if not k:
        return
    best = play(1) if k > 1 else 0
    while alive[best]:
        run = runs[best]
        yield run, known[best]
        alive[best] = run.step()
        # What the next suffix of this run shares with the winner is stored in the run.
        known[best] = run.shared[run.at] if alive[best] else 0
        node = (best + k) // 2
        while node:
            other = tree[node]
            if wins(other, best):
                tree[node], best = best, other
            node //= 2


def _runs(width: int, parts: int):
    """Front-coded runs of a part's suffixes, by bucket."""
    value, k = _values(), min(ANCHOR_BYTES, width)

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        hashes, n = marks.column("hash").to_numpy().view(np.uint64), marks.column("n").to_numpy()
        order = np.argsort(hashes)
        wanted, hot = hashes[order], n[order] > HOT_ANCHOR
        texts, facts = [pa.array([], pa.binary())], [np.zeros((4, 0), np.int64)]  # bucket, bytes before the anchor, document, place

        def put(data: np.ndarray, base: np.ndarray, first: np.ndarray, end: np.ndarray, anchor: np.ndarray, doc: np.ndarray, key: np.ndarray) -> None:
            texts.append(binary_slices(data, first, end))
            facts.append(np.stack([(key >> np.uint64(20)).astype(np.int64) % parts, anchor - first, doc, anchor - base]))

        if docs.num_rows and len(wanted):
            for ids, fresh, data, offsets in own_blocks(docs, BLOCK):
                units = value[data]
                found = fresh_runs(window_runs(units, offsets, k, width), fresh, wanted)
                often = hot[np.searchsorted(wanted, found["hash"])]
                some = {c: x[~often] for c, x in found.items()}
                put(data, offsets[some["doc"]], some["first"], some["last"] + width, some["anchor"], ids[some["doc"]], some["hash"])
                if often.any():
                    some = {c: x[often] for c, x in found.items()}
                    size = some["last"] - some["first"] + 1
                    start, doc = ragged(some["first"], size), np.repeat(some["doc"], size)
                    put(data, offsets[doc], start, start + width, start, ids[doc], rolled(units, width)[start])
        # Bytes that are there more than once in this part go once, with the other places.
        coded = pa.concat_arrays(texts).dictionary_encode()
        bucket, left, doc, place = np.concatenate(facts, 1)
        order = np.argsort(coded.indices.to_numpy(), kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(coded.indices.to_numpy()[order]) != 0, [True]])) if len(order) else np.zeros(1, np.int64)
        both = np.stack([doc, place], 1)[order]
        lead = order[edge[:-1]]
        by: dict[int, list] = {}
        for text, to, l, d, at, a, b in zip(coded.dictionary.to_pylist(), bucket[lead].tolist(), left[lead].tolist(), doc[lead].tolist(), place[lead].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            by.setdefault(to, []).append((text[l:], text[:l], d, at, both[a + 1 : b].tobytes() if b > a + 1 else b""))
        out: list[tuple[int, bytes]] = []
        for to, rows in by.items():
            rows.sort()
            shared, rest = front_coded([r[0] for r in rows])
            out.append((to, packed([shared, rest, [r[1] for r in rows], np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64), [r[4] for r in rows]])))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "blob": pa.array([x[1] for x in out], pa.binary())})

    return run


def classes(shared: np.ndarray, least: int) -> np.ndarray:
    """Number of the group of each entry of a sorted list whose neighbours share
    at least so much."""
    return np.cumsum(shared < least)


def later_windows(shared: np.ndarray, size: np.ndarray, left: list[bytes], doc: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, a, b): of an entry, the windows that begin a to b bytes before its
    anchor are those of an earlier one.

    Entries are in merged order: ``shared`` is the common prefix length with the
    one before, ``size`` the suffix length, ``left`` the bytes before the anchor,
    (``doc``, ``place``) where the anchor is.
    """
    n = len(shared)
    # The bytes before the anchors, read backwards, in their own order.
    distinct = sorted({x[::-1] for x in left})
    alike, _ = front_coded(distinct)
    at = {x: i for i, x in enumerate(distinct)}
    side = np.fromiter((at[x[::-1]] for x in left), np.int64, n)
    room = np.fromiter(map(len, left), np.int64, n)
    early = np.lexsort([place, doc])  # entries by their places
    rank = np.empty(n, np.int64)
    rank[early] = np.arange(n)
    close = np.maximum(shared, np.append(shared[1:], 0))
    begun, until = np.full(n, -1, np.int64), np.full(n, -2, np.int64)
    out = []
    for a in range(int(room.max(initial=-1)) + 1):
        some = np.flatnonzero((room >= a) & (size >= width - a) & (close >= width - a))
        if len(some) < 2:
            continue
        both = classes(shared, width - a)[some] * (len(distinct) + 1) + classes(alike, a)[side[some]]
        if n * n * (len(distinct) + 1) < 1 << 62:
            order = np.sort(both * n + rank[some])
            both, some = order // n, early[order % n]
        else:
            order = np.lexsort([rank[some], both])
            both, some = both[order], some[order]
        later = some[1:][both[1:] == both[:-1]]
        fresh = later[until[later] != a - 1]
        done = fresh[until[fresh] >= 0]
        out.append(np.stack([done, begun[done], until[done]]))
        begun[fresh], until[later] = a, a
    done = np.flatnonzero(until >= 0)
    return tuple(np.concatenate([*out, np.stack([done, begun[done], until[done]])], 1))


def united(doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [first, last) of documents, overlapping and touching ones as one."""
    if not len(doc):
        return doc, first, last
    order = np.lexsort([first, doc])
    doc, first, last = doc[order], first[order], last[order]
    number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
    reach = np.maximum.accumulate(last + number * (int(last.max()) + 1)) - number * (int(last.max()) + 1)  # so far, within a document
    head = np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] > reach[:-1])])
    return doc[head], first[head], reach[np.append(np.flatnonzero(head)[1:] - 1, len(doc) - 1)]


def _merge(width: int):
    """Merge a bucket's runs; the ranges to remove follow from the lengths that
    neighbours share."""

    def run(blobs: pa.Table) -> pa.Table:
        shared, size, left, doc, place = [], [], [], [], []
        docs, firsts, lasts = [], [], []
        for r, common in merged([Run(b) for b in blobs.column("blob").to_pylist()]):
            i = r.at
            shared.append(common), size.append(len(r.suffix)), left.append(r.left[i]), doc.append(r.doc[i]), place.append(r.place[i])
            if r.others[i]:  # equal in full to an earlier place of their part
                more = np.frombuffer(r.others[i], np.int64).reshape(-1, 2)
                docs.append(more[:, 0]), firsts.append(more[:, 1] - len(r.left[i])), lasts.append(more[:, 1] + len(r.suffix))
        doc, place = np.array(doc, np.int64), np.array(place, np.int64)
        entry, a, b = later_windows(np.array(shared, np.int64), np.array(size, np.int64), left, doc, place, width)
        found = united(np.concatenate([doc[entry], *docs]), np.concatenate([place[entry] - b, *firsts]), np.concatenate([place[entry] - a + width, *lasts]))
        return pa.table(dict(zip(("doc", "first", "last"), found, strict=True)))

    return run


def _result(with_text: bool):
    def run(docs: pa.Table, ranges: pa.Table) -> pa.Table:
        doc, first, last = (ranges.column(c).to_numpy() for c in ("doc", "first", "last"))
        order = np.argsort(doc, kind="stable")
        doc, first, last = doc[order], first[order], last[order]
        out: list[list] = [[], [], [], [], [], []]
        for block, data, offsets in blocks(iter(pa.table({"doc_id": docs.column("doc_id"), "text": docs.column("text")}).combine_chunks().to_batches())):
            ids = block.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            change = np.zeros(len(data) + 1, np.int32)
            a, b = np.searchsorted(doc, ids), np.searchsorted(doc, ids, side="right")
            which, row = ragged(a, b - a), np.repeat(np.arange(len(ids)), b - a)
            room = np.diff(offsets)
            np.add.at(change, offsets[row] + np.minimum(first[which], room[row]), 1)
            np.add.at(change, offsets[row] + np.minimum(last[which], room[row]), -1)
            gone = np.cumsum(change[:-1]) > 0
            kept, edge = data[~gone].tobytes(), np.concatenate([[0], np.cumsum(~gone)])[offsets].tolist()
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            lead = offsets[:-1][room > 0]
            begins[lead] = gone[lead]
            parts = [kept[x:y] for x, y in zip(edge[:-1], edge[1:], strict=True)]
            out[0] += block.column(0).to_pylist()
            out[1] += room.tolist()
            out[2] += (room - np.diff(edge)).tolist()
            out[3] += np.diff(np.concatenate([[0], np.cumsum(begins)])[offsets]).tolist()
            out[4] += [hashlib.sha256(x).hexdigest() for x in parts]
            out[5] += parts if with_text else [None] * len(parts)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def suffix_dedup(docs: DataFrame, width: int = 100, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) of each row.

    Null, empty and short texts keep all they have.  Rows that repeat an id and
    its text count as one document and get equal results; rows with a null id
    neither remove nor lose anything.  Texts of any length are used whole.
    """
    if width < 1:
        raise ValueError("a window has at least one byte")
    prepare(docs.sparkSession)
    docs = only(docs, id_col, text_col)
    parts = part_count(docs)
    docs = placed(docs, parts)
    marks = repeated_anchors(docs, _find(width), BLOCK)
    runs = docs.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(_runs(width, parts), "bucket int, blob binary")
    ranges = runs.groupBy("bucket").applyInArrow(_merge(width), "doc long, first long, last long").withColumn("part", part_column(F.col("doc"), parts))
    out = docs.groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(_result(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if with_text else out.drop("kept")
