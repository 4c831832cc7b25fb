"""Arrow text columns as flat byte buffers, shared by the byte and word operators.

A batch of texts is handled as one ``uint8`` buffer plus document offsets, so
the per-byte work is numpy over contiguous memory, never a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once: large enough to amortise numpy calls, small
#: enough that the temporary arrays of a pass stay below some 100 MB.
BLOCK_BYTES = 2 << 20


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32) if len(column) else np.zeros(1, np.int32)
    offsets = raw[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into row ranges of about ``limit`` text bytes each.

    A single longer text makes a block of its own: texts are never cut.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, offsets = flat(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every document.

    Returns (starts, ends) of all words in the buffer and, per document, the
    number of words before it (one more entry than documents).
    """
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    first = ~blank
    if len(data):
        begins = first.copy()
        begins[1:] &= blank[:-1]
        lead = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[lead] = first[lead]
        finish = first.copy()
        finish[:-1] &= blank[1:]
        finish[lead[1:] - 1] = first[lead[1:] - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, offsets)


_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, eight bytes of all words at a time; words of
    up to eight bytes and one length never collide."""
    size = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place
    h = eight[starts] & _LOW_BYTES[np.minimum(size, 8)]
    h ^= size.astype(np.uint64) * _MIX[1]
    h *= _MIX[0]
    h ^= h >> np.uint64(32)
    h *= _MIX[1]
    h ^= h >> np.uint64(29)
    for at in range(8, 64, 8):
        more = np.flatnonzero(size > at)
        if not len(more):
            break
        g = h[more] * _MIX[0] + (eight[starts[more] + at] & _LOW_BYTES[np.minimum(size[more] - at, 8)])
        g *= _MIX[1]
        h[more] = g ^ (g >> np.uint64(32))
    for i in np.flatnonzero(size > 64).tolist():
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return h


def binary_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices [start, end) of a buffer as an Arrow binary array (a copy)."""
    lengths = ends - starts
    out = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    where = np.repeat(starts - out[:-1], lengths) + np.arange(out[-1])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(out.astype(np.int32)), pa.py_buffer(data[where])])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = np.cumsum(lengths)
    n = int(total[-1]) if len(total) else 0
    return np.repeat(starts - (total - lengths), lengths) + np.arange(n)
