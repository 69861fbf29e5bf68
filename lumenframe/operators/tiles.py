"""Every row of one table meets every row of another: packed blocks, and no copies of rows in a shuffle.

Rows are packed into blocks once. Spark's product of the two tables of blocks reads each side again wherever it is met, so the disk holds
both sides once, whatever the number of meetings. A task keeps one state per block of the left side, adds the blocks of the right side to it
one after the other, and returns what is left of it: nothing of the size of all pairs is sent or kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, bytes of the right side that a task's product holds, and blocks of the left side whose states a task keeps.
ROWS = 5_000
HELD = 64 << 20
STATES = 8

_BLOCK = "keys binary, x binary, extra binary"


@dataclass(frozen=True)
class Block:
    """Rows of a block: their keys, features and one more number each."""

    keys: np.ndarray
    x: np.ndarray
    extra: np.ndarray


def packed(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """Blocks of ``rows(key long, x array<double>, extra long or double)``, dealt evenly to ``parts`` tasks."""
    kind = _kind(rows)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, extra = (np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False), t) for i, t in ((0, np.int64), (2, kind)))
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            cuts = [slice(a, a + size) for a in range(0, n, size)]
            yield pa.RecordBatch.from_arrays([pa.array([c[s].tobytes() for s in cuts], pa.binary()) for c in (keys, x, extra)], names=["keys", "x", "extra"])

    blocks = rows.select("key", "x", "extra").mapInArrow(run, _BLOCK).withColumn("block", F.monotonically_increasing_id())
    return blocks.repartition(parts)


def _kind(rows: DataFrame) -> type:
    return np.int64 if dict(rows.dtypes)["extra"] == "bigint" else np.float64


def _block(batch: pa.RecordBatch, i: int, first: int, kind: type) -> Block:
    keys, x, extra = (np.frombuffer(batch.column(first + c)[i].as_buffer(), t) for c, t in enumerate((np.int64, float, kind)))
    return Block(keys, x.reshape(len(keys), -1), extra)


def meet(left: DataFrame, right: DataFrame, n: int, m: int, width: int, size: int | None, begin: Callable, add: Callable, end: Callable, schema: str) -> DataFrame:
    """``end(state)`` as a record batch for ``state = begin(block)`` and ``add(state, other)`` over all blocks of ``right``.

    ``left`` has ``n`` and ``right`` has ``m`` rows of ``key, x, extra``. A block of the left side may come out in several parts.
    """
    size = size or ROWS
    cores = left.sparkSession.sparkContext.defaultParallelism
    mine = max(1, min(size, max(256, n // (4 * cores))))
    parts = max(1, -(-n // mine))
    a = packed(left, mine, parts).select(*[F.col(c).alias(f"_{c}") for c in ("block", "keys", "x", "extra")])
    b = packed(right, size, max(1, -(-m * 8 * (width + 2) // HELD)))

    kinds = _kind(left), _kind(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, object] = {}
        for batch in batches:
            for i, block in enumerate(batch.column(0).to_pylist()):
                if block not in states:
                    if len(states) == STATES:
                        for state in states.values():
                            yield end(state)
                        states.clear()
                    states[block] = begin(_block(batch, i, 1, kinds[0]))
                add(states[block], _block(batch, i, 4, kinds[1]))
        for state in states.values():
            yield end(state)

    crossed = a.join(b.select("keys", "x", "extra").hint("shuffle_replicate_nl"))
    return crossed.coalesce(parts).mapInArrow(run, schema)


def squares(a: np.ndarray, b: np.ndarray, kind: type = np.float64, tile: int = 1 << 18):
    """``(rows of a, squared distances to all of b, by how much rounding may have moved them)`` by matrix products, some rows at a time."""
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    left = np.concatenate([-2 * a, aa[:, None], np.ones((len(a), 1))], axis=1).astype(kind)
    right = np.ascontiguousarray(np.concatenate([b, np.ones((len(b), 1)), bb[:, None]], axis=1).astype(kind).T)
    slack = rounding(kind, a.shape[1]) * (aa + bb.max(initial=0.0))
    for start in range(0, len(a), step := max(1, tile // max(1, len(b)))):
        part = slice(start, start + step)
        yield part, left[part] @ right, slack[part]


def rounding(kind: type, width: int) -> float:
    """Share of the squares of two rows by which rounding may move their squared distance."""
    return (1e-15 if kind is np.float64 else 6e-7) * (width + 8)
