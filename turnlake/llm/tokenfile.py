"""Token streams in Arrow IPC files with fixed-size-list batches.

A file holds ``tokens: fixed_size_list<uint16 or uint32>[L]`` and ``mask:
fixed_size_list<bool>[L]``; every batch but the last has the same number of
rows, so sequence i stands at a computed place of a computed batch and is read
from a memory map without a copy.  A second IPC file beside it says which run
of ids belongs to which document.  Files are written in ascending document
order: the file's number, then its rows, then the place in a row give it.

A task writes under a fresh name and reports it; the manifest of the job that
ended lists the only files that count, so a retried or lost task leaves at
most a file that nothing refers to.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnlake.llm.arrowtext import blocks
from turnlake.llm.bpe import encoder, vocabulary
from turnlake.llm.common import only, prepare

#: Rows of a batch, and ids after which a task begins its next file.
BATCH_ROWS, FILE_IDS = 256, 16 << 20

_MANIFEST = "part int, file int, path string, n_docs long, n_ids long, n_sequences long"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a URI or plain path, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


class Writer:
    """Appends the ids of documents; cuts the stream into rows of ``length``."""

    def __init__(self, path: str, length: int, kind: pa.DataType):
        self.path, self.length, self.kind = path, length, kind
        self.filesystem, inner = place(path)
        self.filesystem.create_dir(inner.rpartition("/")[0], recursive=True)
        schema = pa.schema({"tokens": pa.list_(kind, length), "mask": pa.list_(pa.bool_(), length)})
        index = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64()})
        self.sinks = [self.filesystem.open_output_stream(inner), self.filesystem.open_output_stream(inner + ".docs")]
        self.data, self.index = pa.ipc.new_file(self.sinks[0], schema), pa.ipc.new_file(self.sinks[1], index)
        self.open = np.zeros(0, kind.to_pandas_dtype())
        self.n_docs = self.n_ids = self.n_rows = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, before: np.ndarray) -> None:
        count = np.diff(before)
        self.index.write_batch(pa.record_batch([doc_ids, pa.array(self.n_ids + before[:-1], pa.int64()), pa.array(count, pa.int64())], schema=pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64()})))
        self.n_docs, self.n_ids = self.n_docs + len(count), self.n_ids + int(before[-1])
        self.open = np.concatenate([self.open, ids.astype(self.open.dtype)])
        step = self.length * BATCH_ROWS
        whole = len(self.open) // step * step
        for at in range(0, whole, step):
            self._write(self.open[at : at + step], step)
        self.open = self.open[whole:]

    def _write(self, ids: np.ndarray, used: int) -> None:
        rows = len(ids) // self.length
        mask = np.arange(len(ids)) < used
        self.data.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], names=["tokens", "mask"]))
        self.n_rows += rows

    def close(self) -> dict:
        if len(self.open):
            padded = np.zeros(-(-len(self.open) // self.length) * self.length, self.open.dtype)
            padded[: len(self.open)] = self.open
            self._write(padded, len(self.open))
        for x in (self.data, self.index, *self.sinks):
            x.close()
        return {"path": self.path, "n_docs": self.n_docs, "n_ids": self.n_ids, "n_sequences": self.n_rows}


class TokenFile:
    """Random access to one file; sequences and masks are views of the map."""

    def __init__(self, path: str):
        filesystem, inner = place(path)
        local = isinstance(filesystem, fs.LocalFileSystem)
        self.source = pa.memory_map(inner) if local else filesystem.open_input_file(inner)
        self.reader = pa.ipc.open_file(self.source)
        with filesystem.open_input_file(inner + ".docs") as file:
            self.docs = pa.ipc.open_file(file).read_all()
        self.length = self.reader.schema.field("tokens").type.list_size

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return 0 if not n else (n - 1) * BATCH_ROWS + self.reader.get_batch(n - 1).num_rows

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of row i."""
        batch, row = self.reader.get_batch(i // BATCH_ROWS), i % BATCH_ROWS
        ids = batch.column(0).flatten().slice(row * self.length, self.length)
        return ids.to_numpy(), batch.column(1).flatten().slice(row * self.length, self.length)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids [start, start + n) of the stream: a view within one batch, joined
        where the run crosses batches."""
        step, parts = self.length * BATCH_ROWS, []
        while n > 0:
            tokens = self.reader.get_batch(start // step).column(0).flatten().to_numpy()
            part = tokens[start % step : start % step + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_tokens(docs: DataFrame, path: str, target: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, append ``end_id`` to each document, write; returns the manifest.

    Ascending ``doc_id`` (nulls first, equal ids in the order of their texts);
    null texts count as empty and have the end id alone; an empty table writes
    no file.  Only the two columns named are read.
    """
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, writer = TaskContext.get().partitionId(), 0, None
        coder = encoder(path)
        kind = pa.uint16() if vocabulary(path).size <= 1 << 16 else pa.uint32()

        def done(w: Writer) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"part": part, "file": number, **w.close()}], schema=pa.schema({"part": pa.int32(), "file": pa.int32(), "path": pa.string(), "n_docs": pa.int64(), "n_ids": pa.int64(), "n_sequences": pa.int64()}))

        for block, data, offsets in blocks(batches):
            ids, before = coder.encode(data, offsets)
            ids = np.insert(ids, before[1:], end_id)
            before = before + np.arange(len(before))
            writer = writer or Writer(f"{target}/part-{part:06d}-{number:04d}-{uuid.uuid4().hex}.arrow", length, kind)
            writer.add(block.column(0), ids, before)
            if writer.n_ids >= FILE_IDS:
                yield done(writer)
                number, writer = number + 1, None
        if writer:
            yield done(writer)

    placed = only(docs, id_col, text_col).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    placed.mapInArrow(run, _MANIFEST).write.parquet(f"{target}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{target}/manifest")


def read_tokens(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, path) of every document, from files.

    ``start`` counts the ids of all documents before it over all files; the
    running sum is over the manifest, one row a file.
    """
    manifest = prepare(spark).read.schema(_MANIFEST).parquet(f"{target}/manifest")
    ahead = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(path)
                start, count = (file.docs.column(c).to_numpy() for c in ("start", "n_tokens"))
                crc = [zlib.crc32(file.ids(a, n).astype("<u4").tobytes()) for a, n in zip(start.tolist(), count.tolist(), strict=True)]
                yield from pa.table({"doc_id": file.docs.column("doc_id"), "start": pa.array(start + base), "n_tokens": pa.array(count), "ids_crc32": pa.array(crc, pa.int64()), "path": pa.array([path] * len(crc), pa.string())}).combine_chunks().to_batches(max_chunksize=10_000)

    each = manifest.select("path", ahead.alias("base")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return each.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, path string")
