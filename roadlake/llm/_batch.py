"""Helpers for Arrow batches of texts inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that a task holds in expanded form at once; one longer text is its own chunk.
CHUNK_BYTES = 1 << 18

#: Byte classes of the word patterns: 0x20 and 0x09-0x0D separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, n + 1 offsets); null texts are empty."""
    flat = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"").cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = flat.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Runs of consecutive texts of at most ``limit`` bytes together, at least one text each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets = text_bytes(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield texts.slice(at, to - at)
        at = to


def each(batches: Iterator[pa.Array], limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """The chunks of all batches; a function of columns may answer them one by one."""
    for batch in batches:
        yield from chunks(batch, limit)


def with_breaks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a line feed after each text, and the shifted offsets."""
    return np.insert(data, offsets[1:], 0x0A), offsets + np.arange(len(offsets))


def word_bounds(separator: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of non-separators, and how many words each text has.

    ``separator`` covers bytes from ``with_breaks``, so no run crosses texts.
    """
    edge = np.diff(separator.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends if len(ends) == len(starts) else ends[ends > (starts[0] if len(starts) else 0)]
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of data[start:end] for consecutive, non-overlapping slices."""
    lengths = ends - starts
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, starts[lengths > 0], 1)
    np.add.at(inside, ends[lengths > 0], -1)
    packed = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(packed))])


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive runs of ``counts`` entries (0 for empty runs)."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def identity(*values: Column) -> Column:
    """128 bits that tell rows apart by some values; nulls differ from any value."""
    return F.unhex(F.md5(F.to_json(F.struct(*[v.alias(f"v{k}") for k, v in enumerate(values)]))))
