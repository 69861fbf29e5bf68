"""Numpy views of text columns inside tasks: UTF-8 buffers, words, polynomial hashes, packed blobs.

Everything here works on one Arrow batch (or a slice of it) at a time; Spark decides which rows meet.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import SparkSession

#: Odd multipliers of the two polynomial hashes and of the mixers (arbitrary fixed odd numbers).
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xC2B2AE3D27D4EB4F
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)

#: Bytes of one Arrow batch; bounds a task's memory when documents are long.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python workers in batches that fit next to the arrays made from them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def buckets(spark: SparkSession) -> int:
    """Number of groups for packed rows: it follows the shuffle partitions that the session sets for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_SYSTEM = ctypes.CDLL(None)


def release() -> None:
    """Give freed memory back to the system: workers live on between stages, beside the heap of their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_SYSTEM, "malloc_trim", None)
    if trim is not None:
        trim(0)


def each(work: Callable) -> Callable:
    """Work on single Arrow batches as a function of all of them; nothing is kept in between."""

    def run(batches):
        for batch in batches:
            yield work(batch)
            release()

    return run


def group(work: Callable) -> Callable:
    """Work on the table of a group, with its memory given back."""

    def run(table):
        out = work(table)
        release()
        return out

    return run


def cogroup(work: Callable) -> Callable:
    """Work on two tables of a group, with its memory given back."""

    def run(left, right):
        out = work(left, right)
        release()
        return out

    return run


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; row i is ``bytes[offsets[i]:offsets[i + 1]]``, null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows ``[a, b)`` with at most ``most`` bytes each; one longer row is a run of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base ** i`` and its inverse modulo 2**64, for i up to ``n``."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[base] = have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return have


_TABLES: dict[int, np.ndarray] = {}


def byte_codes(base: int) -> np.ndarray:
    """A 64-bit code for each byte value."""
    if base not in _TABLES:
        _TABLES[base] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
    return _TABLES[base]


class PrefixHash:
    """Prefix polynomial hashes of a buffer: the hash of any range in constant time.

    Range hashes are comparable within and across buffers: the leading position is divided out.
    """

    def __init__(self, data: np.ndarray, base: int):
        self.up, self.down = powers(base, len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_codes(base)[data] * self.up[: len(data)], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all substrings of ``k`` bytes."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (self.sums[k:] - self.sums[:n]) * self.down[:n]


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, row)`` of every word: a longest run of bytes outside ``gap`` within one row."""
    inside = ~gap[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    joined = cuts[inside[cuts] & inside[cuts - 1]]  # a word that would run on into the next row
    marks = np.flatnonzero(edge)
    if len(joined):
        joined = np.unique(joined)
        marks = np.sort(np.concatenate([marks, joined, joined]))
    start, end = marks[0::2], marks[1::2]
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE_A) -> np.ndarray:
    """A 64-bit hash of each word; its length takes part."""
    if not len(data):
        return np.zeros(0, np.uint64)
    return mix(PrefixHash(data, base).ranges(start, end) + (end - start).astype(np.uint64))


_SHRINK = zstandard.ZstdCompressor(level=1)
_GROW = zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    return _SHRINK.compress(np.ascontiguousarray(values).tobytes())


def unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(_GROW.decompress(blob), kind)


def pack_rising(values: np.ndarray) -> bytes:
    """Pack integers as differences: long rising runs take little room."""
    return pack(np.diff(values.astype(np.int64), prepend=np.int64(0)))


def unpack_rising(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob, np.int64))


def six_bytes(values: np.ndarray) -> bytes:
    """The low 48 bits of 64-bit hashes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six_bytes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def ranges_of(counts: np.ndarray) -> np.ndarray:
    """0, 1, … within each of consecutive runs of the given lengths."""
    total = int(counts.sum())
    starts = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(starts, counts)
