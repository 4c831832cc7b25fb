"""Alignment of two tokenizers' tokens, one distinct segment at a time.

Texts are cut before a space that follows a character which isn't white space:
no token of either vocabulary crosses such a place (checked, not assumed), so
segments are encoded alike alone and in their text.  Blocks of documents keep
segment numbers and send each distinct segment once; distinct segments of the
corpus are encoded by both tokenizers and aligned once, the alignments are
joined back to the blocks, and a block composes its documents from them.
Document counts of linked pairs go the same way: counted in blocks, summed,
joined back.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.llm.arrowtext import blocks, flat, ragged
from turnlake.llm.bpe import Encoder, Vocabulary
from turnlake.llm.common import Scratch, only, prepare

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 8 << 20

#: White space beyond ASCII, after which no cut is made.  Fixed values: U+0085,
#: U+00A0, U+1680, U+180E, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
_WIDE_BLANKS = tuple(chr(x).encode() for x in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))

#: A token of an alignment is 32 bits: id, side (B is 1), what stands after it
#: when groups are written: 0 a comma, 1 the bar between sides, 2 the group's end.
_SIDE, _AFTER = 16, 17

_CODED = "block long, doc_id long, size int, codes binary, code int, segment binary"
_COMPOSED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, size int, vector binary, code int, pair long, n long"
_DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


@lru_cache(maxsize=2)
def _encoder_a(path: str) -> tuple[Encoder, pa.Array]:
    """Byte-level BPE in which special tokens' strings are plain text."""
    vocabulary = Vocabulary(path)
    tokens = pa.array(vocabulary.token_bytes, pa.binary())
    vocabulary.special = {}
    return Encoder(vocabulary), tokens


@lru_cache(maxsize=2)
def _encoder_b(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]
    return model, pa.array(pieces, pa.binary())


def check_cuts(path_a: str, path_b: str) -> None:
    """A ValueError if a token of either vocabulary has a space after a character
    that isn't white space, or A doesn't split its texts by the byte-level rules."""
    with open(path_a, encoding="utf-8") as file:
        spec = json.load(file)
    rules = spec["pre_tokenizer"] or {}
    if rules.get("type") != "ByteLevel" or not rules.get("use_regex", True) or rules.get("add_prefix_space") or spec["normalizer"]:
        raise ValueError("tokenizer A must be byte-level BPE without a normalizer or prefix")
    for tokens in (_encoder_a(path_a)[1], _encoder_b(path_b)[1]):
        if len(tokens) > 1 << 16:
            raise ValueError("ids are held in 16 bits")
        for token in tokens.to_pylist():
            if b" " in token[1:] and regex.search(r"[^\s] ", token.decode("utf-8", "replace")):
                raise ValueError(f"token {token!r} crosses a cut")


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the segments of all documents of a buffer."""
    at = np.flatnonzero(data == 0x20)
    at = at[at > 0]
    before = data[at - 1]
    good = before > 0x20
    for i in np.flatnonzero(before >= 0x80).tolist():
        good[i] = not data[max(0, at[i] - 3) : at[i]].tobytes().endswith(_WIDE_BLANKS)
    starts = np.zeros(len(data), bool)
    starts[at[good]] = True
    starts[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(starts)


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as segment numbers of their block, and its distinct segments;
    frequent segments have small numbers."""
    pack, seen = pa.Codec("zstd", compression_level=1), 0
    first = TaskContext.get().partitionId() << 32
    for rows, _, _ in blocks(batches, limit=BLOCK):
        text = pc.fill_null(rows.column(1), "")
        spaced = pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(" ", text, ""))
        data, offsets = flat(spaced)
        starts = cuts(data, offsets)
        edge = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edge), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        which = coded.indices.to_numpy()
        order = np.argsort(-np.bincount(which, minlength=len(coded.dictionary)), kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order))
        codes, before = number[which], np.searchsorted(starts, offsets)
        packed = [pack.compress(codes[a:b].tobytes(), asbytes=True) for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
        n, k, block = rows.num_rows, len(order), first + seen
        seen += 1
        void = lambda kind, m: pa.nulls(m, kind)
        yield pa.record_batch([pa.repeat(pa.scalar(block, pa.int64()), n), rows.column(0), pa.array(np.diff(before), pa.int32()), pa.array(packed, pa.binary()), void(pa.int32(), n), void(pa.binary(), n)], _names(_CODED))
        if k:
            yield pa.record_batch([pa.repeat(pa.scalar(block, pa.int64()), k), void(pa.int64(), k), void(pa.int32(), k), void(pa.binary(), k), pa.array(np.arange(k), pa.int32()), coded.dictionary.take(pa.array(order))], _names(_CODED))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _same(parts: pa.Array, word: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether the joined tokens of each segment are its bytes."""
    made, edges = flat(parts)
    own = np.searchsorted(word, np.arange(len(offsets)))
    at = edges[own]
    good = np.diff(at) == np.diff(offsets)
    if good.all() and np.array_equal(made, data):
        return good
    for i in np.flatnonzero(good).tolist():
        good[i] = np.array_equal(made[at[i] : at[i + 1]], data[offsets[i] : offsets[i + 1]])
    return good


def aligned(segments: pa.Array, path_a: str, path_b: str) -> pa.Array:
    """The alignment of each segment (which begins with a space), null where its
    bytes aren't those of its tokens."""
    (encoder, tokens_a), (model, tokens_b) = _encoder_a(path_a), _encoder_b(path_b)
    data, offsets = flat(segments)
    encoder.forget()  # segments are distinct: what it keeps of others is of no use
    a, before = encoder.encode(data, offsets)
    # B adds the space that each segment begins with, but not to an empty text.
    lone = model.piece_to_id("▁")
    lists = [x if s != b" " else [lone] for s, x in zip(segments.to_pylist(), model.encode([s[1:].decode("utf-8", "replace") for s in segments.to_pylist()], num_threads=1), strict=True)]
    b = np.array([i for x in lists for i in x], np.int64)
    n = len(segments)
    word_a, word_b = np.repeat(np.arange(n), np.diff(before)), np.repeat(np.arange(n), [len(x) for x in lists])
    good = _same(tokens_a.take(pa.array(a.astype(np.int32))), word_a, data, offsets) & _same(tokens_b.take(pa.array(b)), word_b, data, offsets)
    ids, words, ends = [], [], []
    for tokens, i, w in ((tokens_a, a.astype(np.int64), word_a), (tokens_b, b, word_b)):
        i, w = i[good[w]], w[good[w]]
        size = np.diff(np.frombuffer(tokens.buffers()[1], np.int32)[: len(tokens) + 1])
        ids.append(i), words.append(w), ends.append(np.cumsum(size[i]))
    common = np.intersect1d(*ends, assume_unique=True)
    key = np.concatenate([2 * np.searchsorted(common, ends[0]), 2 * np.searchsorted(common, ends[1]) + 1])
    order = np.argsort(key, kind="stable")
    key, side = key[order], key[order] & 1
    last = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)
    token = (np.concatenate(ids)[order] | side << _SIDE | np.where(last, 1 + side, 0) << _AFTER).astype("<u4")
    edge = np.concatenate([[0], np.cumsum(4 * np.bincount(np.concatenate(words), minlength=n))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [pa.array(good).buffers()[1], pa.py_buffer(edge), pa.py_buffer(token)])


@lru_cache(maxsize=1)
def _shown() -> pa.Array:
    """Each id as decimal digits with each of the three marks after it."""
    return pa.array([b"%d%c" % (i, mark) for i in range(1 << 16) for mark in b",|;"], pa.binary())


class _Alignments:
    """The alignments of a block's segments, by segment number."""

    def __init__(self, table: pa.Table):
        code = table["code"].to_numpy()
        column = table["tokens"].combine_chunks().take(pa.array(np.argsort(code)))
        self.n = len(column)
        self.good = np.asarray(column.is_valid())
        data, offsets = flat(column)
        token, before = np.frombuffer(data.tobytes(), "<u4").astype(np.int64), offsets // 4
        ids, side, after = token & 0xFFFF, token >> _SIDE & 1, token >> _AFTER
        word = np.repeat(np.arange(self.n), np.diff(before))
        count = lambda pick: np.bincount(word[pick], minlength=self.n)
        self.n_a, self.n_b, self.n_groups = count(side == 0), count(side == 1), count(after == 2)
        text, edges = flat(_shown().take(pa.array(3 * ids + after)))
        self.text = pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(edges[before].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(text))])
        # Links of a group: its distinct A ids with its distinct B ids, counted.
        group = np.cumsum(after == 2) - (after == 2)
        (ka, ca), (kb, cb) = (np.unique(group[side == s] << 16 | ids[side == s], return_counts=True) for s in (0, 1))
        low, high = np.searchsorted(kb >> 16, ka >> 16, "left"), np.searchsorted(kb >> 16, ka >> 16, "right")
        ia, ib = np.repeat(np.arange(len(ka)), high - low), ragged(low, high - low)
        own = word[after == 2][ka[ia] >> 16]
        self.weight = ca[ia] * cb[ib]
        self.pairs, self.pair = np.unique((ka[ia] & 0xFFFF) << 16 | kb[ib] & 0xFFFF, return_inverse=True)
        self.pair_before = np.searchsorted(own, np.arange(self.n + 1))
        total = np.concatenate([[0], np.cumsum(self.weight)])
        self.n_links = np.diff(total[self.pair_before])


#: Segments of documents that are composed at once.
_SLICE = 400_000


def _compose(left: pa.Table, right: pa.Table, digest: bool) -> pa.Table:
    """A block's documents, each with its links as pair numbers and weights, and
    the block's pairs with how many of its documents hold them."""
    known = _Alignments(right)
    size, docs, hits, row = np.concatenate([[0], np.cumsum(left["size"].to_numpy())]), [], np.zeros(len(known.pairs), np.int64), 0
    while row < left.num_rows:
        end = max(row + 1, int(np.searchsorted(size, size[row] + _SLICE, "right")) - 1)
        docs.append(_some(left.slice(row, end - row), known, hits, digest))
        row = end
    some = np.flatnonzero(hits)
    m = len(some)
    void = [pa.nulls(m, docs[0].schema.field(c).type) for c in _names(_COMPOSED)[1:9]]
    pairs = pa.table([pa.repeat(left["block"][0], m), *void, pa.array(some, pa.int32()), pa.array(known.pairs[some], pa.int64()), pa.array(hits[some], pa.int64())], _names(_COMPOSED))
    return pa.concat_tables([*docs, pairs])


def _some(left: pa.Table, known: _Alignments, hits: np.ndarray, digest: bool) -> pa.Table:
    """Some documents of a block; ``hits`` gets those that hold each pair."""
    codec, size = pa.Codec("zstd", compression_level=1), left["size"].to_numpy()
    parts = [np.frombuffer(codec.decompress(x, decompressed_size=4 * n, asbytes=True), np.uint32) for x, n in zip(left["codes"].to_pylist(), size.tolist(), strict=True) if n]
    codes = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    before, n = np.concatenate([[0], np.cumsum(size)]), len(size)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[codes])])[before])
    good = total(~known.good) == 0
    facts = {c: np.where(good, total(getattr(known, c)), 0) for c in ("n_a", "n_b", "n_groups", "n_links")}
    text, edges = flat(known.text.take(pa.array(codes)))
    groups = []
    for a, b, fine in zip(edges[before[:-1]].tolist(), edges[before[1:]].tolist(), good.tolist(), strict=True):
        piece = text[a : b - 1].tobytes() if fine and b > a else b""
        groups.append(sha256(piece).hexdigest() if digest and piece else piece.decode())
    doc = np.repeat(np.arange(n), size)
    held = good[doc]
    key, often = np.unique(doc[held] * max(known.n, 1) + codes[held], return_counts=True)
    code = key % max(known.n, 1)
    low, many = known.pair_before[code], np.diff(known.pair_before)[code]
    at, p = ragged(low, many), max(len(known.pairs), 1)
    key, weight = np.repeat(key // max(known.n, 1), many) * p + known.pair[at], np.repeat(often, many) * known.weight[at]
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    weight = np.add.reduceat(weight, new) if len(new) else weight
    key = key[new]
    pair, edge = key % p, np.searchsorted(key // p, np.arange(n + 1))
    vectors = [codec.compress(pair[a:b].astype("<u4").tobytes() + weight[a:b].astype("<u8").tobytes(), asbytes=True) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
    hits += np.bincount(pair, minlength=len(hits))
    return pa.table([left["block"], left["doc_id"], *[pa.array(x, pa.int64()) for x in facts.values()], pa.array(groups, pa.string()), pa.array(np.diff(edge), pa.int32()), pa.array(vectors, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], _names(_COMPOSED))


def _scored(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents with the sums over their links."""
    code = right["code"].to_numpy()
    count, best = (np.zeros(int(code.max(initial=-1)) + 1, np.int64) for _ in range(2))
    count[code], best[code] = right["n"].to_numpy(), right["best"].to_numpy()
    codec, sums = pa.Codec("zstd", compression_level=1), []
    for x, n in zip(left["vector"].to_pylist(), left["size"].to_pylist(), strict=True):
        raw = codec.decompress(x, decompressed_size=12 * n, asbytes=True) if n else b""
        pair, weight = np.frombuffer(raw[: 4 * n], "<u4"), np.frombuffer(raw[4 * n :], "<u8").astype(np.int64)
        sums.append((int(best[pair] @ weight), int(count[pair] @ weight)))
    columns = [left[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*columns, *[pa.array([s[i] for s in sums], pa.int64()) for i in range(2)], left["groups"]], _names(_DOCUMENT))


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) a row.

    ``groups`` are the aligned groups as text, ``a1,a2|b1;a3|b2,b3``, or with
    ``digest`` the SHA-256 of it ('' without tokens).  A null or empty text, and
    one that B's tokens don't give back, has no tokens: zeros.  Every row counts
    as a document of its own: repeated rows and ids give repeated rows, a null id
    stays null.  A text is held whole by a task.  An empty table gives an empty
    result; columns but the two named aren't read.
    """
    spark = prepare(docs.sparkSession)
    check_cuts(path_a, path_b)
    steps = Scratch(spark)
    coded = steps.stored(only(docs, id_col, text_col).mapInArrow(_code, _CODED), "coded", compression="zstd")
    words = coded.filter("code IS NOT NULL").select("block", "code", "segment")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in blocks(batches, "segment"):
            yield pa.record_batch([rows.column(0), aligned(rows.column(0), path_a, path_b)], ["segment", "tokens"])

    aligning = Scratch(spark)
    once = aligning.stored(words.select("segment").distinct().mapInArrow(align, "segment binary, tokens binary"), "alignments", compression="zstd")
    joined = steps.stored(words.join(once, "segment").select("block", "code", "tokens"), "segments", compression="zstd")
    aligning.clear()

    def compose(left: pa.Table, right: pa.Table) -> pa.Table:
        return _compose(left, right, digest)

    numbered = coded.filter("code IS NULL").select("block", "doc_id", "size", "codes")
    composed = steps.stored(numbered.groupBy("block").cogroup(joined.groupBy("block")).applyInArrow(compose, _COMPOSED), "composed", compression="zstd")
    found = composed.filter("code IS NOT NULL").select(F.col("block").alias("home"), "code", "pair", "n")
    counts = found.groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 16)))  # over the B ids that one A id meets
    scores = counts.select("pair", "n", (F.col("n") == most).cast("long").alias("best"))
    back = found.select("home", "code", "pair").join(scores, "pair").select("home", "code", "n", "best")
    own = composed.filter("code IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "size", "vector")
    out = Scratch(spark).stored(own.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(_scored, _DOCUMENT), "aligned")
    steps.clear()
    return out
