"""Substring deduplication over words by a compacted De Bruijn graph.

The edges are the W-word strings of the corpus, the nodes the places between
them.  Consecutive edges of a text that share an anchor form a local path; an
anchor under which the corpus has one path only doesn't branch there, and where
it has several the paths fall apart into their edges.  Paths and edges are then
compacted by a join: a piece follows another without a branch if it begins, at
all of its source places, exactly where the other ends, so that in-degree and
out-degree of the node between them are one.  Chains of such pieces are the
nonbranching paths, however many anchors they run over.

A chain's first place in the corpus is its source; every other place is a
repeated span, which is removed if its words are those at the source: both are
read again at their coordinates and compared by SHA-256.  Up to there, 128 bits
identify a path, an edge or a set of places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from turnlake.llm.anchors import fresh_runs, own_blocks, part_column, part_count, placed, repeated_anchors, rolled, window_runs
from turnlake.llm.arrowtext import BLOCK_BYTES, blocks, ragged, word_hashes, word_spans
from turnlake.llm.common import Scratch, only, prepare, stored

#: Words of an anchor.
ANCHOR_WORDS = 8


def _find(width: int):
    def find(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        starts, ends, before = word_spans(data, offsets)
        return window_runs(word_hashes(data, starts, ends), before, min(ANCHOR_WORDS, width), width)

    return find


def place_hashes(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """64-bit hash of each place.  A set of places is known by the exclusive or
    of its hashes."""
    h = doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


_PATHS = "anchor long, path_a long, path_b long, doc long, first long, n int, edges binary, others binary, count long, begins long, ends long"


def _paths(width: int):
    """Distinct paths of a part under repeated anchors: where each is first, its
    edges, the other places of the part that have it, and the sets of places
    where it starts and ends."""

    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        wanted = np.sort(marks.column("hash").to_numpy().view(np.uint64))
        found: dict[bytes, list] = {}
        if docs.num_rows and len(wanted):
            for ids, fresh, data, offsets in own_blocks(docs, BLOCK_BYTES):
                starts, ends, before = word_spans(data, offsets)
                units = word_hashes(data, starts, ends)
                own = fresh_runs(window_runs(units, before, min(ANCHOR_WORDS, width), width), fresh, wanted)
                raw = memoryview(rolled(units, width)).cast("B") if len(own["doc"]) else memoryview(b"")
                place = own["first"] - before[own["doc"]]
                for anchor, doc, first, at, stop in zip(own["hash"].tolist(), ids[own["doc"]].tolist(), place.tolist(), (8 * own["first"]).tolist(), (8 * own["last"] + 8).tolist(), strict=True):
                    key = xxhash.xxh3_128_digest(raw[at:stop], anchor & 0xFFFFFFFF)
                    entry = found.get(key)
                    if entry is None:
                        found[key] = [anchor, doc, first, bytes(raw[at:stop]), []]
                    else:
                        entry[4] += (doc, first)
        rows = list(found.values())
        key = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
        doc, first = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        n = np.array([len(r[3]) // 8 for r in rows], np.int64)
        count = np.array([1 + len(r[4]) // 2 for r in rows], np.int64)
        every = np.array([x for r in rows for x in (r[1], r[2], *r[4])], np.int64).reshape(-1, 2)
        edge = np.cumsum(count) - count
        places = lambda at: np.bitwise_xor.reduceat(place_hashes(every[:, 0], every[:, 1] + at), edge) if len(edge) else edge
        return pa.table({
            "anchor": np.array([r[0] for r in rows], np.uint64).view(np.int64), "path_a": key[:, 0], "path_b": key[:, 1], "doc": doc, "first": first, "n": n.astype(np.int32),
            "edges": pa.array([r[3] for r in rows], pa.binary()), "others": pa.array([np.array(r[4], np.int64).tobytes() for r in rows], pa.binary()), "count": count,
            "begins": places(0), "ends": places(np.repeat(n, count)),
        })

    return run


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [_column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


_EDGES = "anchor long, edge long, doc long, start long, at int, count long, begins long, ends long"


def _slices(batch: pa.RecordBatch, limit: int = 400_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of some ``limit`` places: rows, all places (document, word) of each
    row, and how many each row has."""
    others = _column(batch, "others")
    count = 1 + pc.binary_length(others).to_numpy(zero_copy_only=False).astype(np.int64) // 16
    edge = np.flatnonzero(np.diff(np.concatenate([[-1], np.cumsum(count) // limit]))).tolist() + [batch.num_rows]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        some = batch.slice(a, b - a)
        doc, first = _numbers(some, "doc", "first")
        own = np.stack([doc, first], 1)
        raw = b"".join(x for i, o in enumerate(others.slice(a, b - a).to_pylist()) for x in (own[i].tobytes(), o))
        yield some, np.frombuffer(raw, np.int64).reshape(-1, 2), count[a:b]


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each edge of a path with its sets of places; ``at`` is its number in it."""
    for whole in batches:
        for batch, places, count in _slices(whole):
            anchor, doc, first, n = _numbers(batch, "anchor", "doc", "first", "n")
            edges = np.frombuffer(b"".join(_column(batch, "edges").to_pylist()), np.int64)
            before = np.cumsum(count) - count
            sets = np.zeros((int(n.max()) + 1, len(n)), np.int64)  # of the node after so many edges
            for at in range(len(sets)):
                some = np.flatnonzero(n >= at)
                own = ragged(before[some], count[some])
                sets[at, some] = np.bitwise_xor.reduceat(place_hashes(places[own, 0], places[own, 1] + at), np.cumsum(count[some]) - count[some])
            at, path = ragged(np.zeros(len(n), np.int64), n), np.repeat(np.arange(len(n)), n)
            yield pa.record_batch({
                "anchor": anchor[path], "edge": edges, "doc": doc[path], "start": first[path] + at, "at": at.astype(np.int32), "count": count[path],
                "begins": sets[at, path], "ends": sets[at + 1, path],
            })


def _digests(width: int):
    """(doc, first, n, digest): SHA-256 of the words of each span of the part."""

    def run(docs: pa.Table, spans: pa.Table) -> pa.Table:
        spans = spans.select(["doc", "first", "n"]).combine_chunks()
        doc, first, n = (spans.column(c).to_numpy() for c in ("doc", "first", "n"))
        order = np.argsort(doc, kind="stable")
        doc, first, n = doc[order], first[order], n[order]
        out: list[bytes | None] = [None] * len(doc)
        if docs.num_rows and len(doc):
            for ids, fresh, data, offsets in own_blocks(docs, BLOCK_BYTES):
                a, b = np.searchsorted(doc, ids), np.searchsorted(doc, ids, side="right")
                some = np.where(fresh, b - a, 0)
                if some.any():
                    which, row = ragged(a, some), np.repeat(np.arange(len(ids)), some)
                    words = Words(data, offsets)
                    for i, x in zip(which.tolist(), words.digests(row, first[which], first[which] + n[which] + width - 1), strict=True):
                        out[i] = x
        return pa.table({"doc": doc, "first": first, "n": n, "digest": pa.array(out, pa.binary())})

    return run


class Words:
    """The words of a block of documents, each followed by one space."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.before = word_spans(data, offsets)
        size = self.ends - self.starts + 1
        text = np.append(data, np.uint8(0x20))[ragged(self.starts, size)]
        self.edge = np.concatenate([[0], np.cumsum(size)])
        text[self.edge[1:] - 1] = 0x20
        self.text = memoryview(text)

    def digests(self, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[bytes | None]:
        """SHA-256 of the words [first, last) of documents, one space between
        them; None where a document is shorter."""
        fits = self.before[row] + last <= self.before[row + 1]
        a, b = self.edge[np.where(fits, self.before[row] + first, 0)], self.edge[np.where(fits, self.before[row] + last, 0)]
        return [hashlib.sha256(self.text[x : y - 1]).digest() if ok else None for x, y, ok in zip(a.tolist(), b.tolist(), fits.tolist(), strict=True)]


_SPANS = "doc long, first long, last long, digest binary"


def _copies(width: int):
    """The places of a chain but its source (``at``: edges from a place of the
    row to the chain's first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, places, count in _slices(whole):
                at, length, source, begin = _numbers(batch, "at", "length", "source", "begin")
                row = np.repeat(np.arange(len(count)), count)
                doc, first = places[:, 0], places[:, 1] + at[row]
                copy = (doc != source[row]) | (first != begin[row])
                row, doc, first = row[copy], doc[copy], first[copy]
                yield pa.record_batch({"doc": doc, "first": first, "last": first + length[row] + width - 1, "digest": _column(batch, "digest").take(pa.array(row))})

    return run


def _cover(group_docs: pa.Table, ranges: pa.Table) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray]]:
    """Blocks of the rows, and whether each word is covered by a span whose words
    are those of its source."""
    ranges = ranges.combine_chunks()
    order = np.argsort(ranges.column("doc").to_numpy(), kind="stable")
    doc, first, last = (ranges.column(c).to_numpy()[order] for c in ("doc", "first", "last"))
    digest = ranges.column("digest").to_pylist()
    table = pa.table({"doc_id": group_docs.column("doc_id"), "text": group_docs.column("text")}).combine_chunks()
    for block, data, offsets in blocks(iter(table.to_batches())):
        words = Words(data, offsets)
        ids = block.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
        a, b = np.searchsorted(doc, ids), np.searchsorted(doc, ids, side="right")
        which, row = ragged(a, b - a), np.repeat(np.arange(len(ids)), b - a)
        same = np.array([x is not None and x == digest[i] for x, i in zip(words.digests(row, first[which], last[which]), order[which].tolist(), strict=True)], bool)
        which, row = which[same], row[same]
        change = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(change, words.before[row] + first[which], 1)
        np.add.at(change, words.before[row] + last[which], -1)
        yield block, words, np.cumsum(change[:-1]) > 0


def _result(with_text: bool):
    def run(docs: pa.Table, ranges: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        for block, words, gone in _cover(docs, ranges):
            before, size = words.before, np.diff(words.edge)
            keep = np.flatnonzero(~gone)
            kept = memoryview(np.asarray(words.text)[ragged(words.edge[keep], size[keep])])
            edge = np.concatenate([[0], np.cumsum(size[keep])])[np.searchsorted(keep, before)].tolist()
            removed = np.concatenate([[0], np.cumsum(gone)])[before]
            parts = [bytes(kept[a : max(a, b - 1)]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            out[0] += block.column(0).to_pylist()
            out[1] += np.diff(before).tolist()
            out[2] += np.diff(removed).tolist()
            out[3] += [hashlib.sha256(x).hexdigest() for x in parts]
            out[4] += [x.decode("utf-8", "replace") for x in parts] if with_text else [None] * len(parts)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def chains(paths: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(nonbranching paths of the corpus, edges of branching anchors).

    A chain is (doc, first, length: edges, by_edge, a, b): its source, and the
    piece it begins with, a path (a, b) or the edge b of anchor a.
    """
    # A place as one number, so that the least is found by hashing, not sorting.
    number = lambda doc, word: F.expr(f"CAST({doc} AS DECIMAL(20, 0)) * 4294967296BD + {word}").cast("decimal(38,0)")
    word = F.expr("CAST(pmod(lead, 4294967296BD) AS BIGINT)")
    opened = lambda df: df.withColumn("first", word).withColumn("doc", ((F.col("lead") - F.col("first")) / F.expr("4294967296BD")).cast("long")).drop("lead")
    sets = [F.sum("count").alias("count"), F.bit_xor("begins").alias("begins"), F.bit_xor("ends").alias("ends")]
    distinct = scratch.stored(paths.groupBy("path_a", "path_b").agg(F.min(number("doc", "first")).alias("lead"), F.first("n").alias("n"), F.first("anchor").alias("anchor"), *sets), "distinct-paths")
    branching = distinct.groupBy("anchor").agg(F.count("*").alias("paths")).filter("paths > 1").select("anchor")
    edges = scratch.stored(paths.select("anchor", "doc", "first", "n", "edges", "others").join(branching, "anchor", "left_semi").mapInArrow(_spread, _EDGES), "edges")
    singles = edges.groupBy("anchor", "edge").agg(F.min(number("doc", "start")).alias("lead"), *sets).filter("count > 1")
    whole = distinct.filter("count > 1").join(branching, "anchor", "left_anti")
    pieces = whole.select("lead", F.col("n").cast("long").alias("n"), F.lit(False).alias("by_edge"), F.col("path_a").alias("a"), F.col("path_b").alias("b"), "begins", "ends").unionByName(
        singles.select("lead", F.lit(1).cast("long").alias("n"), F.lit(True).alias("by_edge"), F.col("anchor").alias("a"), F.col("edge").alias("b"), "begins", "ends")
    )
    pieces = scratch.stored(opened(pieces), "pieces")
    # The node before a piece has one way in and one way out if a piece ends where
    # this one begins, in all places, so in the first of them as well.
    previous = pieces.select("doc", (F.col("first") + F.col("n")).alias("first"), F.col("ends").alias("begins"), F.lit(1).alias("inner"))
    linked = pieces.join(previous.hint("merge"), ["doc", "first", "begins"], "left")
    # The sources of a chain's pieces follow one another in one document.
    chain = F.count_if(F.col("inner").isNull()).over(Window.partitionBy("doc").orderBy("first"))
    grown = linked.withColumn("chain", chain).groupBy("doc", "chain").agg(F.min("first").alias("first"), F.sum("n").alias("length"), *[F.min_by(c, "first").alias(c) for c in ("by_edge", "a", "b")]).drop("chain")
    return scratch.stored(grown, "chains"), edges


def repeated_ranges(docs: DataFrame, parts: int, width: int) -> DataFrame:
    """(part, doc, first, last, digest): words [first, last) that stand earlier in
    the corpus if their SHA-256 is the digest, which is that of the words there.
    ``docs`` are placed."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("part", "doc_id", "text").filter("doc_id IS NOT NULL")
    marks = repeated_anchors(docs, _find(width), BLOCK_BYTES)
    paths = scratch.stored(docs.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(_paths(width), _PATHS), "paths")
    found, edges = chains(paths, scratch)
    sources = found.select(part_column(F.col("doc"), parts).alias("part"), "doc", "first", F.col("length").alias("n"))
    digests = docs.groupBy("part").cogroup(sources.groupBy("part")).applyInArrow(_digests(width), "doc long, first long, n long, digest binary")
    known = scratch.stored(found.join(digests.drop("n").hint("merge"), ["doc", "first"]).select(F.col("doc").alias("source"), F.col("first").alias("begin"), "length", "by_edge", "a", "b", "digest"), "sources")
    # The other places of a chain are those of the piece it begins with.
    places, facts = paths.select("path_a", "path_b", "doc", "first", "others"), ["source", "begin", "length", "digest"]
    by_path = places.join(known.filter("NOT by_edge").withColumnsRenamed({"a": "path_a", "b": "path_b"}).hint("merge"), ["path_a", "path_b"]).select("doc", "first", "others", F.lit(0).alias("at"), *facts)
    heads = edges.select("anchor", "edge", "doc", (F.col("start") - F.col("at")).alias("first"), "at").join(known.filter("by_edge").withColumnsRenamed({"a": "anchor", "b": "edge"}).hint("merge"), ["anchor", "edge"]).drop("anchor", "edge")
    by_edge = places.join(heads.hint("merge"), ["doc", "first"]).select("doc", "first", "others", "at", *facts)
    spans = by_path.unionByName(by_edge).mapInArrow(_copies(width), _SPANS).withColumn("part", part_column(F.col("doc"), parts))
    out = stored(spans, "ranges")
    scratch.clear()
    return out


def _rewritten(docs: pa.Table, ranges: pa.Table) -> pa.Table:
    """The rows; a text that loses words is joined anew."""
    made = _result(with_text=True)(docs, ranges)
    cut = pc.greater(made.column("n_removed"), 0)
    return pa.table({"text": pc.if_else(cut, made.column("kept"), docs.column("text")), "cut": cut, "carried": docs.column("carried")})


def without_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """``docs`` (doc_id, text and any others, whatever their names) with repeated
    spans removed from its texts: a text that loses words has the words it
    keeps, joined by one space, and its ``n_chars`` anew; others are as they
    were."""
    prepare(docs.sparkSession)
    slim = only(docs, "doc_id", "text")
    parts = part_count(slim)
    ranges = repeated_ranges(placed(slim, parts), parts, width)
    carried = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("carried")
    rows = placed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), carried), parts)
    schema = StructType([StructField("text", StringType()), StructField("cut", BooleanType()), rows.schema["carried"]])
    out = rows.groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(_rewritten, schema)
    own = lambda c: F.col("text") if c == "text" else F.when(F.col("cut"), F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col("carried")[c]) if c == "n_chars" else F.col("carried")[c]
    return out.select(*[own(c).alias(c) for c in docs.columns])


def substring_dedup(docs: DataFrame, width: int = 20, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of every row.

    Null, empty and short texts keep all they have.  Rows that repeat an id and
    its text count as one document and get equal results; rows with a null id
    neither remove nor lose anything.  Texts of any length are used whole.
    """
    prepare(docs.sparkSession)
    docs = only(docs, id_col, text_col)
    parts = part_count(docs)
    docs = placed(docs, parts)
    ranges = repeated_ranges(docs, parts, width)
    out = docs.groupBy("part").cogroup(ranges.groupBy("part")).applyInArrow(_result(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept")
