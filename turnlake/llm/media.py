"""Media payloads in a content-addressed chunk store.

A text becomes the samples of an 8-bit mono WAV.  A rolling gear hash cuts the
samples where their content says so, so equal passages cut alike wherever they
stand.  Chunks are keyed by SHA-256; a Spark aggregation keeps one copy of each
in a table bucketed by digest, and a media row holds its header and the ordered
list of its chunks.  Reading joins the lists with the store, checks every chunk
against its digest and puts the media together again.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.arrowtext import blocks
from turnlake.llm.common import only, prepare, stored

#: Bytes: no cut before, on average about (2 to the bits) after that, and at the
#: latest so far from the last cut.  The window of the gear hash is 64 bytes.
LEAST, AVERAGE_BITS, MOST, WINDOW = 1_024, 12, 32_768, 64

#: A bounded sample trains the dictionary that short chunks are packed with:
#: so many texts, so many characters of each.  It changes sizes only.
DICTIONARY_TEXTS, DICTIONARY_CHARS, DICTIONARY_BYTES, LEVEL = 2_000, 4_096, 112_000, 6

SAMPLE_RATE, UNIT = 8_000, 64


def header(n: int) -> bytes:
    """RIFF header of n 8-bit mono samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", (36 + n) & 0xFFFFFFFF, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", n & 0xFFFFFFFF)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[byte i - j] << j over the last 64 bytes, by doubling."""
    gear = np.random.default_rng(64).integers(0, 1 << 64, 256, dtype=np.uint64)
    h, done = gear[data], 1
    while done < WINDOW:
        wider = h.copy()
        wider[done:] += h[:-done] << np.uint64(done)
        h, done = wider, 2 * done
    return h


def cuts(data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each document, the document's end included.

    A cut is judged by the 64 bytes before it, all of the same chunk.
    """
    marks = np.flatnonzero(gear_hashes(data) >> np.uint64(64 - AVERAGE_BITS) == 0) + 1
    out = []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own, at = [], start
        while end - at > LEAST:
            i = int(np.searchsorted(marks, at + LEAST))
            cut = min(int(marks[i]) if i < len(marks) else end, at + MOST)
            if cut >= end:
                break
            own.append(cut)
            at = cut
        out.append([*own, end])
    return out


def _chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[list[bytes]]:
    """The chunks of each payload: the text's bytes, then zeros to a multiple of
    UNIT, in the last chunk."""
    raw = data.tobytes()
    for start, ends in zip(offsets[:-1].tolist(), cuts(data, offsets), strict=True):
        n = ends[-1] - start
        pad = max(-(-n // UNIT), 1) * UNIT - n
        parts = [raw[a:b] for a, b in zip([start, *ends[:-1]], ends, strict=True)]
        parts[-1] += bytes(pad)
        yield parts


_RECIPE = "media_id long, doc_id long, n_bytes long, payload_bytes long, header binary, chunks array<binary>"


def recipes(docs: DataFrame) -> DataFrame:
    """One media row for each document: header and ordered chunk digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in blocks(batches):
            lists = list(_chunks(data, offsets))
            size = [sum(map(len, x)) for x in lists]
            yield pa.record_batch([
                block.column(2), block.column(0), pa.array(np.diff(offsets)), pa.array(size, pa.int64()), pa.array([header(n) for n in size], pa.binary()),
                pa.array([[hashlib.sha256(c).digest() for c in x] for x in lists], pa.list_(pa.binary())),
            ], names=["media_id", "doc_id", "n_bytes", "payload_bytes", "header", "chunks"])

    return docs.withColumn("media_id", F.monotonically_increasing_id()).mapInArrow(run, _RECIPE)


def _dictionary(docs: DataFrame) -> bytes:
    import zstandard

    # Rows below a threshold of a hash of id and place: some more than are wanted, however many tasks scan.
    rows = docs.count()
    draw = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(1 << 31))
    few = docs.withColumn("draw", draw).filter(F.col("draw") * max(rows, 1) < 2 * DICTIONARY_TEXTS * (1 << 31)).filter("length(text) > 64")
    sample = few.select("draw", "doc_id", F.substring("text", 1, DICTIONARY_CHARS).alias("text")).orderBy("draw", "doc_id").limit(DICTIONARY_TEXTS)
    texts = [r["text"].encode() for r in sample.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, texts).as_bytes() if len(texts) >= 64 else b""
    except zstandard.ZstdError:  # too little or too uniform text for a dictionary
        return b""


def distinct_chunks(docs: DataFrame, dictionary: bytes) -> DataFrame:
    """(digest, packed): one copy of each chunk; a task sends a chunk once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
        sent: set[bytes] = set()
        for _, data, offsets in blocks(batches):
            fresh = {}
            for parts in _chunks(data, offsets):
                for c in parts:
                    key = hashlib.sha256(c).digest()
                    if key not in sent:
                        sent.add(key)
                        fresh[key] = pack.compress(c)
            yield pa.record_batch([pa.array(list(fresh), pa.binary()), pa.array(list(fresh.values()), pa.binary())], names=["digest", "packed"])
            if len(sent) > 500_000:
                sent.clear()  # the aggregation below removes what is sent again

    return docs.select("doc_id", "text").mapInArrow(run, "digest binary, packed binary").groupBy("digest").agg(F.first("packed").alias("packed"))


class MediaStore:
    """A chunk store and the media rows that refer to it."""

    def __init__(self, spark: SparkSession, media: DataFrame, chunk_table: str, dictionary: bytes):
        self.spark, self.media, self.chunk_table, self.dictionary = spark, media, chunk_table, dictionary

    @classmethod
    def write(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> MediaStore:
        """Store every text; null texts count as empty, repeated rows share all
        their chunks, an empty table makes an empty store."""
        spark = prepare(docs.sparkSession)
        docs = only(docs, id_col, text_col)
        dictionary = _dictionary(docs)
        media = stored(recipes(docs), "media")
        name = f"media_chunks_{uuid.uuid4().hex}"
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # Files of the shuffle are of no use once the table stands.
        setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = spark.conf.get(setting, None)
        spark.conf.set(setting, "true")
        try:
            distinct_chunks(docs, dictionary).write.bucketBy(buckets, "digest").option("compression", "none").saveAsTable(name)
        finally:
            spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
        return cls(spark, media, name, dictionary)

    def parts(self) -> DataFrame:
        """(media_id, header, payload_bytes, at, n, digest, packed) of every chunk of
        every media row."""
        listed = self.media.select("media_id", "header", "payload_bytes", F.size("chunks").alias("n"), F.posexplode("chunks").alias("at", "digest"))
        return listed.join(self.spark.table(self.chunk_table), "digest")

    def read(self) -> DataFrame:
        """(media_id, media binary): each medium, put together and verified."""
        return self._with(lambda media, payload: {"media": pa.array(media, pa.binary())}, "media binary")

    def features(self) -> DataFrame:
        """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
        media_bytes, media_sha256, feature), from the stored bytes."""

        def compute(media: list[bytes], payload: list[bytes]) -> dict[str, pa.Array]:
            shape = []
            for p in payload:
                x = np.frombuffer(p, np.uint8).astype(np.int64)
                step = np.abs(np.diff(x))
                shape.append(f"sum={x.sum()};energy={(x * x).sum()};peak={x.max()};zero={int((x == 0).sum())};variation={step.sum()}")
            return {
                "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in payload]), "tail_crc32": pa.array([zlib.crc32(p[-UNIT:]) for p in payload], pa.int64()),
                "media_bytes": pa.array([len(m) for m in media], pa.int64()), "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in media]), "feature": pa.array(shape, pa.string()),
            }

        made = self._with(compute, "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
        return self.media.select("media_id", "doc_id", "n_bytes", "payload_bytes").join(made, "media_id").drop("media_id")

    def _with(self, compute, schema: str) -> DataFrame:
        dictionary, columns = self.dictionary, [c.split()[0] for c in schema.split(", ")]

        def opened(packed: list[bytes], digests: list[bytes]) -> list[bytes]:
            import zstandard

            unpack = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
            out = [unpack.decompress(x) for x in packed]
            if any(hashlib.sha256(c).digest() != d for c, d in zip(out, digests, strict=True)):
                raise ValueError("a stored chunk doesn't match its digest")
            return out

        def rows(ids: list[int], heads: list[bytes], sizes: list[int], payload: list[bytes]) -> pa.RecordBatch:
            if any(len(p) != n or h != header(n) for p, n, h in zip(payload, sizes, heads, strict=True)):
                raise ValueError("the chunks of a medium don't add up to what its header says")
            made = compute([h + p for h, p in zip(heads, payload, strict=True)], payload)
            return pa.record_batch([pa.array(ids, pa.int64()), *(made[c] for c in columns)], names=["media_id", *columns])

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    ids, heads, sizes, packed, digests = (c.to_pylist() for c in batch.slice(at, 500).columns)
                    yield rows(ids, heads, sizes, opened(packed, digests))

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 50):
                    ids, heads, sizes, parts = (c.to_pylist() for c in batch.slice(at, 50).columns)
                    yield rows(ids, heads, sizes, [b"".join(opened([p["packed"] for p in x], [p["digest"] for p in x])) for x in parts])

        # A medium of one chunk is whole where the join finds it; only the chunks
        # of longer ones travel on to their medium.
        parts = self.parts()
        alone = parts.filter("n = 1").select("media_id", "header", "payload_bytes", "packed", "digest").mapInArrow(single, f"media_id long, {schema}")
        many = parts.filter("n > 1").groupBy("media_id").agg(F.first("header").alias("header"), F.first("payload_bytes").alias("payload_bytes"), F.array_sort(F.collect_list(F.struct("at", "digest", "packed"))).alias("parts")).mapInArrow(joined, f"media_id long, {schema}")
        return alone.unionByName(many)
