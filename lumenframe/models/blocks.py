"""Rows as blocks of numbers for tree learners, and sums that tasks add up for the nodes of trees.

A block holds some thousand rows: their features as one-byte bins (a matrix, feature by feature), the labels, and what a
learner keeps per row. Every task adds up its blocks into one array per wanted node; Spark merges those arrays by node, so what
reaches the driver is ``features x bins`` numbers per node, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bin of a missing value; real bins are below it.
MISSING = 255
BINS = 256
#: Cells of one block, and bytes of sums that one pass may ask of a task.
CELLS = 1 << 20
ROOM = 64 << 20
#: Columns whose quantiles are sketched in one pass.
COLUMNS = 200


@dataclass(frozen=True)
class Tree:
    """Nodes as arrays; ``feature`` is -1 in a leaf. A value up to the threshold (bins: up to ``bin``) goes left."""

    feature: np.ndarray
    bin: np.ndarray
    threshold: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def _walk(self, n: int, goes_left: Callable) -> np.ndarray:
        node = np.zeros(n, np.int64)
        rows = np.arange(n)
        while True:
            rows = rows[self.feature[node[rows]] >= 0]
            if not len(rows):
                return node
            at = node[rows]
            node[rows] = np.where(goes_left(rows, at), self.left[at], self.right[at])

    def leaves_of_bins(self, bins: np.ndarray) -> np.ndarray:
        """The node where each row of a block (features x rows) ends."""

        def goes_left(rows, at):
            b = bins[self.feature[at], rows]
            return np.where(b == MISSING, self.missing_left[at], b <= self.bin[at])

        return self._walk(bins.shape[1], goes_left)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node where each row of ``x`` (rows x features, NaN is missing) ends."""

        def goes_left(rows, at):
            v = x[rows, self.feature[at]]
            return np.where(np.isnan(v), self.missing_left[at], v <= self.threshold[at])

        return self._walk(len(x), goes_left)


def rows_for_trees(df: DataFrame) -> DataFrame:
    """``x, y``: features as an array and the label; rows without either are left out."""
    x = F.col("features")
    if not isinstance(df.schema["features"].dataType, T.ArrayType):
        x = F.when(x.isNotNull(), vector_to_array(x))
    return df.select(x.alias("x"), F.col("label").cast("double").alias("y")).where("x is not null and y is not null and not isnan(y)")


def edges_of(rows: DataFrame, width: int, bins: int = MISSING) -> list[np.ndarray]:
    """Rising upper edges of the bins of each feature: approximate quantiles, at most ``bins - 1`` per feature."""
    grid = [k / bins for k in range(1, bins)] + [1.0]
    out = []
    for a in range(0, width, COLUMNS):
        names = [f"c{i}" for i in range(a, min(a + COLUMNS, width))]
        cells = rows.select(*[F.col("x")[int(c[1:])].alias(c) for c in names])
        for found in cells.approxQuantile(names, grid, 0.25 / bins):
            edges = np.unique(np.array(found, float))
            out.append(edges[~np.isnan(edges)][:-1])  # nothing lies above the largest value
    return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows x features of a column of arrays; null cells are NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(-1, width)


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Features x rows in bins."""
    out = np.empty((len(edges), len(x)), np.uint8)
    for f, e in enumerate(edges):
        out[f] = np.where(np.isnan(x[:, f]), MISSING, np.searchsorted(e, x[:, f], side="left"))
    return out


BLOCK = "n int, bins binary, y binary, state binary"


def blocks(rows: DataFrame, edges: Sequence[np.ndarray]) -> DataFrame:
    """``n, bins, y, state`` per block of ``rows(x, y)``; the state is empty until a learner writes it."""
    width = len(edges)
    most = max(256, CELLS // max(1, width))

    def run(batches):
        for batch in batches:
            x, y = matrix(batch.column(0), width), batch.column(1).to_numpy(zero_copy_only=False)
            out = {"n": [], "bins": [], "y": [], "state": []}
            for a in range(0, len(y), most):
                b = min(a + most, len(y))
                out["n"].append(b - a)
                out["bins"].append(binned(x[a:b], edges).tobytes())
                out["y"].append(y[a:b].astype(float).tobytes())
                out["state"].append(b"")
            kinds = {"n": pa.int32(), "bins": pa.binary(), "y": pa.binary(), "state": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))

    return rows.mapInArrow(run, BLOCK)


def block_rows(batches: Iterable[pa.RecordBatch], width: int):
    """``(bins, y, state)`` of every block; state as plain bytes."""
    for batch in batches:
        for n, bins, y, state in zip(*(batch.column(i) for i in range(4))):  # one block at a time: a batch may hold all of a task's
            yield np.frombuffer(bins.as_buffer(), np.uint8).reshape(width, n.as_py()), np.frombuffer(y.as_buffer()), state.as_py()


def _sum(kind, largest: tuple[int, int] = (0, 1)):
    def run(table: pa.Table) -> pa.Table:
        total = None
        for blob in table.column("sums"):
            part = np.frombuffer(blob.as_buffer(), float)
            if total is None:
                total = part.copy()
                most = len(part) - len(part) * largest[0] // largest[1]
            else:
                np.add(total[:most], part[:most], out=total[:most])
                np.maximum(total[most:], part[most:], out=total[most:])
        keys = [table.column(k).slice(0, 1) for k in kind]
        return pa.table([*keys, pa.array([total.tobytes()], pa.binary())], names=[*kind, "sums"])

    return run


def add_up(table: DataFrame, work: Callable[[Iterable[pa.RecordBatch]], dict[int, np.ndarray]], largest: tuple[int, int] = (0, 1)) -> dict[int, np.ndarray]:
    """Sums of the arrays that ``work`` returns for the blocks of each task, by slot; of the last ``largest[0]`` parts in ``largest[1]`` the largest numbers.

    The arrays of many tasks are merged in two steps, about the square root of their number at a time.
    """

    def run(batches):
        for slot, sums in work(batches).items():
            row = [pa.array([slot], pa.int32()), pa.array([np.ascontiguousarray(sums, float).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, names=["slot", "sums"])

    parts = ceil(sqrt(max(1, table.rdd.getNumPartitions())))
    sent = table.mapInArrow(run, "slot int, sums binary")
    if parts > 4:
        sent = sent.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(parts)))
        sent = sent.groupBy("slot", "part").applyInArrow(_sum(["slot", "part"], largest), "slot int, part int, sums binary").drop("part")
    found = sent.groupBy("slot").applyInArrow(_sum(["slot"], largest), "slot int, sums binary").collect()
    return {r["slot"]: np.frombuffer(r["sums"], float) for r in found}


def node_sums(bins: np.ndarray, place: np.ndarray, slots: int, weights: Sequence[np.ndarray], into: np.ndarray) -> None:
    """Add a block to ``into`` (slots x features x bins x weights); ``place`` is the slot of each row, -1 for none."""
    rows = np.flatnonzero(place >= 0)
    if not len(rows):
        return
    base = place[rows] * BINS
    picked = [None if w is None else w[rows] for w in weights]
    for f in range(len(bins)):
        index = base + bins[f, rows]
        for k, w in enumerate(picked):
            into[:, f, :, k] += np.bincount(index, weights=w, minlength=slots * BINS).reshape(slots, BINS)


def class_sums(bins: np.ndarray, place: np.ndarray, slots: int, y: np.ndarray, classes: int, weight: np.ndarray, into: np.ndarray) -> None:
    """As :func:`node_sums` for the weights of classes: each row counts once, for its own class. ``into`` says how many bins there are."""
    rows = np.flatnonzero((place >= 0) & (weight > 0))
    if not len(rows):
        return
    size = into.shape[2]
    base, w = place[rows] * size, weight[rows]
    label = y[rows].astype(np.int64)
    for f in range(len(bins)):
        index = (base + bins[f, rows]) * classes + label
        into[:, f] += np.bincount(index, weights=w, minlength=slots * size * classes).reshape(slots, size, classes)
