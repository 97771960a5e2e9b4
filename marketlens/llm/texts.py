"""Text columns as byte buffers, and what several operators share."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.shipping import ship

#: Rows and bytes of one Arrow batch, so that very long texts do not pile up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: Bytes that are worked on at once; a single text may be longer.
CHUNK_BYTES = 1 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches that Python workers get in this session, and let them find this package."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def give_back() -> None:
    """At the end of a task: return freed memory to the system, since Spark keeps the worker for later tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c") or None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def chunked(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of rows of about `most` bytes."""
    data, offsets = buffers(column)
    first, n = 0, len(column)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def held_out(doc_id: Column) -> Column:
    """Rows no model learns from; a row without an id is never learned from."""
    return F.coalesce(fold(doc_id) == 0, F.lit(True))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads the bits of sums and products."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n at least."""
    if len(_powers["up"]) < n:
        n = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = BASE**i * (hash of data[i:j]), modulo 2**64."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    body = (prefix[ends] - prefix[starts]) * down[starts]
    return mixed(body + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no space, and for each text the first of its words (n + 1 numbers)."""
    inside = ~_SPACE[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        cut = offsets[(offsets > 0) & (offsets < len(data))]
        before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
        after[cut - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)
