"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

A first pass counts every piece of every text; the most frequent ones are
compiled, with their ids, into one transducer that workers memory-map.  The
encoding pass looks each distinct piece of a block up in it and merges the
pieces it doesn't hold exactly, so the lexicon changes speed, never results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.llm.arrowtext import blocks
from turnlake.llm.bpe import Encoder, vocabulary
from turnlake.llm.common import only, prepare
from turnlake.llm.transducer import Transducer, compile_words

#: A lexicon word takes at least this part of the corpus's bytes for its
#: occurrences times its length, and is no longer than LONGEST_WORD: so there are
#: at most 1 / LEAST_SHARE of them, whatever the size of the corpus.
LEAST_SHARE, LONGEST_WORD = 1e-5, 48


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """(piece binary, n long): how often each piece occurs in all texts.

    A task adds its counts up before the shuffle.  Special tokens aren't pieces.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, rows = Encoder(vocabulary(path)), [], 0
        for _, data, offsets in blocks(batches):
            pieces, _, special = encoder.pieces(data, offsets)
            coded = pieces.dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            if special:
                n[[i for i, x in enumerate(coded.dictionary.to_pylist()) if not x]] = 0
            held.append(pa.table({"piece": coded.dictionary, "n": pa.array(n, pa.int64())}))
            rows += len(n)
            if rows > 1_500_000:
                held = [_summed(held)]
                rows = held[0].num_rows
                if rows > 750_000:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, rows = [], 0
        if held:
            yield from _summed(held).to_batches(max_chunksize=50_000)

    return docs.select("text").mapInArrow(count, "piece binary, n long").filter("n > 0").groupBy("piece").agg(F.sum("n").alias("n"))


def _summed(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by("piece").aggregate([("n", "sum")])
    return out.rename_columns([{"n_sum": "n"}.get(c, c) for c in out.column_names]).select(["piece", "n"])


def build_lexicon(docs: DataFrame, path: str, share: float = LEAST_SHARE) -> bytes:
    """The transducer of the pieces that make up at least ``share`` of all bytes
    each: at most 1 / share reach the driver, however large the corpus is."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    own = F.col("n") * F.length("piece")
    often = piece_counts(docs, path).filter((F.length("piece") <= LONGEST_WORD) & (own >= total * share))
    chosen = sorted(bytes(r["piece"]) for r in often.select("piece").collect())
    ids, counts = vocabulary(path).merge(chosen)
    return compile_words(chosen, ids, counts)


_encoders: dict[tuple[str, bytes], Encoder] = {}


def _encoder(path: str, lexicon: bytes) -> Encoder:
    key = (path, hashlib.sha256(lexicon).digest())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary(path), Transducer.mapped(lexicon))
    return _encoders[key]


class Codec:
    """Encode and decode text columns; results equal the tokenizers library's.

    Nulls count as empty texts, which have no ids; repeated rows give repeated
    results; an empty table gives an empty result.  Only the two columns named
    are read.
    """

    def __init__(self, docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", share: float = LEAST_SHARE):
        prepare(docs.sparkSession)
        self.path = path
        lexicon = build_lexicon(only(docs, id_col, text_col), path, share)
        self.lexicon = docs.sparkSession.sparkContext.broadcast(lexicon)

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id long, ids array<int>)."""
        path, lexicon = self.path, self.lexicon

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder = _encoder(path, lexicon.value)
            for block, data, offsets in blocks(batches):
                ids, before = encoder.encode(data, offsets)
                yield pa.record_batch({"doc_id": block.column(0), "ids": pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(ids.astype(np.int32)))})

        return only(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")

    def decode(self, coded: DataFrame) -> DataFrame:
        """(doc_id long, text string) of (doc_id, ids); a null list: empty text.

        Byte sequences that aren't UTF-8 become replacement characters.
        """
        path = self.path

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = token_array(path)
            for batch in batches:
                texts = [b"".join(tokens.take(pa.array(x, pa.int32())).to_pylist()).decode("utf-8", "replace") if x else "" for x in batch.column(1).to_pylist()]
                yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

        return coded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")

    def digests(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, n_tokens, ids_sha256, decoded_sha256) in one pass: encode,
        digest the decimal ids, decode those ids, digest the decoded bytes."""
        path, lexicon = self.path, self.lexicon

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encoder, tokens = _encoder(path, lexicon.value), token_array(path)
            shown = pa.array([b"%d," % i for i in range(len(tokens))], pa.binary())
            for block, data, offsets in blocks(batches):
                ids, before = encoder.encode(data, offsets)
                take = pa.array(ids.astype(np.int32))
                decimal = _digests(shown.take(take), before, trim=1)
                decoded = _digests(tokens.take(take), before, utf8=True)
                yield pa.record_batch({"doc_id": block.column(0), "n_tokens": pa.array(np.diff(before), pa.int64()), "ids_sha256": decimal, "decoded_sha256": decoded})

        return only(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_array(path: str) -> pa.Array:
    return pa.array(vocabulary(path).token_bytes, pa.binary())


def _digests(parts: pa.Array, before: np.ndarray, trim: int = 0, utf8: bool = False) -> pa.Array:
    """SHA-256 of the joined parts of each document, less ``trim`` last bytes."""
    edges = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset :][before]
    raw = memoryview(parts.buffers()[2] or b"")
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        piece = raw[a : max(a, b - trim)]
        if utf8:
            piece = str(piece, "utf-8", "replace").encode()
        out.append(hashlib.sha256(piece).hexdigest())
    return pa.array(out, pa.string())
