"""Words of whole texts as flat numpy arrays, in blocks of bounded size.

A word is a longest run of bytes other than space and 0x09-0x0D, which never lie inside a UTF-8
character. Hashes fold A-Z to a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Block(NamedTuple):
    """Documents `first` to `first + len(offsets) - 2` of a batch and their words."""

    first: int
    data: np.ndarray  # bytes of the documents, one after the other
    offsets: np.ndarray  # where each document begins, and the end
    begins: np.ndarray  # of each word
    ends: np.ndarray
    doc: np.ndarray  # of each word, from 0 in the block
    hashes: np.ndarray  # uint64


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches count rows, not bytes; long texts need short batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; NULL for a NULL key."""
    return F.crc32(key.cast("string").cast("binary")) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finaliser of the splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values(fold: bool = True) -> np.ndarray:
    values = np.arange(256, dtype=np.uint64)
    if fold:
        values[65:91] = values[97:123]
    return mix64(values + np.uint64(0x51ED270B))


def separators() -> np.ndarray:
    found = np.zeros(256, dtype=bool)
    found[[9, 10, 11, 12, 13, 32]] = True
    return found


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base):
        out = np.full(n + 1, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(_BASE), of(_INVERSE)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a NULL counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64, count=len(column) + column.offset + 1)[column.offset :]
    size = int(offsets[-1])
    return np.frombuffer(data, dtype=np.uint8, count=size) if size else np.zeros(0, np.uint8), offsets


def blocks(column: pa.Array, fold: bool = True, limit: int = _BLOCK_BYTES) -> Iterator[Block]:
    """Words of all texts of the column, in blocks of about `limit` bytes (at least one text each)."""
    data, offsets = text_bytes(column)
    values, gap = byte_values(fold), separators()
    up, down = powers(limit)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield _block(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], values, gap, up, down)
        first = last


def _block(first, data, offsets, values, gap, up, down) -> Block:
    size = len(data)
    if size >= len(up):
        up, down = powers(size)
    inside = ~gap[data]
    edges = np.zeros(size + 1, dtype=bool)
    edges[offsets] = True  # a word ends with its document
    opened = inside.copy()
    opened[1:] &= ~inside[:-1] | edges[1:size]
    closed = inside.copy()
    closed[:-1] &= ~inside[1:] | edges[1:size]
    begins, ends = np.flatnonzero(opened), np.flatnonzero(closed) + 1
    sums = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(values[data] * up[:size], out=sums[1:])
    hashes = mix64((sums[ends] - sums[begins]) * down[begins])
    doc = np.searchsorted(offsets, begins, "right") - 1
    return Block(first, data, offsets, begins, ends, doc, hashes)


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of n words; a document of 1 to n - 1 words is one run."""
    if not len(hashes):
        return hashes, doc
    counts = np.bincount(doc)
    starts = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(len(hashes)) - starts[doc]
    runs = np.maximum(counts - n + 1, (counts > 0).astype(counts.dtype))
    kept = np.flatnonzero(place < runs[doc])
    out = np.zeros(len(kept), dtype=np.uint64)
    ends = starts[doc[kept] + 1]
    for k in range(n):
        at = kept + k
        there = at < ends
        out = out * np.uint64(_BASE) + np.where(there, hashes[np.minimum(at, len(hashes) - 1)], np.uint64(7))
    return mix64(out), doc[kept]


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns; a missing one is an error that names it."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    return df.select(*[F.col(f"`{n}`") for n in names])
