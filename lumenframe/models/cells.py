"""Importances of features in shallow forests, for tables of any size.

The trees are those of Spark's forests by default: 32 bins per feature, five levels, the Gini index, a subset of features per node,
and a split between two leaves of one class is taken back. They can't tell rows apart that share all bins and the class, so
such rows are counted once by one shuffle, and trees grow on the counts. A row is in the sample of a tree a Poisson number of times
with mean 1, so ``n`` equal rows are in it a Poisson number of times with mean ``n``: the sample is that of the rows.

There are never more cells than rows, and a cell is a byte per feature beside its class and its count.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from math import ceil, exp, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.models import blocks as B
from lumenframe.models import forest as T
from lumenframe.models.blocks import Tree
from lumenframe.session import cut_lineage

BITS = 5
BINS = 1 << BITS
LEVELS = 5
#: Features whose bins share one number of 64 bits.
PACKED = 12
#: Quantiles per bin that are looked up, so that rare values of a column with few values are seen.
FINE = 8
#: Chances that a single row is in a sample at most 0, 1, 2 ... times.
ONCE = np.cumsum([exp(-1.0) / factorial(k) for k in range(18)])


def edges_of(rows: DataFrame, cols: Sequence[str]) -> list[np.ndarray]:
    """Rising upper edges of the bins of each column: all its values where they are few, else approximate quantiles."""
    steps = BINS * FINE
    grid = [k / steps for k in range(1, steps + 1)]
    out = []
    for a in range(0, len(cols), B.COLUMNS):
        for found in rows.approxQuantile(list(cols[a : a + B.COLUMNS]), grid, 0.25 / steps):
            edges = np.unique(found)
            if len(edges) > BINS:
                edges = np.unique(found[FINE - 1 :: FINE])
            out.append(edges[:-1])  # nothing lies above the largest value
    return out


def _bin(x: Column, edges: Sequence[float], first: int = 0) -> Column:
    """The number of edges below ``x``, by halving."""
    if not len(edges):
        return F.lit(first)
    m = len(edges) // 2
    return F.when(x <= F.lit(float(edges[m])), _bin(x, edges[:m], first)).otherwise(_bin(x, edges[m + 1 :], first + m + 1))


BLOCK = "n int, bins binary, y binary, rows binary"


def counted(rows: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Blocks of different cells: bins (features x cells), classes and numbers of rows. Values and classes must not be null."""
    width = len(cols)
    bins = [_bin(F.col(c), e).cast("long") for c, e in zip(cols, edges_of(rows, cols))]
    keys = []
    for a in range(0, width, PACKED):
        key = F.lit(0).cast("long")
        for i, b in enumerate(bins[a : a + PACKED]):
            key = key + F.shiftleft(b, BITS * i)
        keys.append(key.alias(f"k{a // PACKED}"))
    names = [f"k{a // PACKED}" for a in range(0, width, PACKED)]
    cells = rows.select(*keys, F.col(label).cast("int").alias("y")).groupBy(*names, "y").agg(F.count("*").alias("rows"))

    def run(batches):
        for batch in batches:
            packed = [batch.column(i).to_numpy() for i in range(len(names))]
            bins = np.stack([packed[f // PACKED] >> (BITS * (f % PACKED)) & (BINS - 1) for f in range(width)]).astype(np.uint8)
            y, n = (batch.column(len(names) + i).to_numpy().astype(float) for i in range(2))
            columns = [pa.array([len(y)], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in (bins, y, n))]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "bins", "y", "rows"])

    # Samples are drawn block by block: sorted cells give the same blocks again.
    blocks = cells.sortWithinPartitions(*names, "y").mapInArrow(run, BLOCK)
    return cut_lineage(blocks.withColumn("block", F.monotonically_increasing_id()))


def _unpacked(batches, width: int):
    for batch in batches:
        for n, bins, y, rows, block in zip(*(batch.column(i) for i in range(5))):
            bins = np.frombuffer(bins.as_buffer(), np.uint8).reshape(width, n.as_py())
            yield bins, np.frombuffer(y.as_buffer()), np.frombuffer(rows.as_buffer()), block.as_py()


def drawn(seed: int, tree: int, block: int, rows: np.ndarray) -> np.ndarray:
    """How often the rows of each cell of a block are in the sample of a tree; cells of one row are looked up, which is quicker."""
    rng = np.random.default_rng([seed, tree, block])
    u = rng.random(len(rows))
    out = np.zeros(len(rows))
    for chance in ONCE:
        out += u >= chance
    many = np.flatnonzero(rows > 1)
    if len(many):
        out[many] = rng.poisson(rows[many])
    return out


def _grown(tree: T.Growing) -> Tree:
    out, _ = tree.arrays()
    return replace(out, bin=out.threshold.astype(np.int64))


def _ask(table: DataFrame, width: int, features: Sequence[int], classes: int, seed: int, grown: dict[int, T.Growing], nodes: list[T.Open]):
    """Sums (features x bins x classes) of each of ``nodes``."""
    trees = {t: _grown(grown[t]) for t in {o.tree for o in nodes}}
    asked = {t: [i for i, o in enumerate(nodes) if o.tree == t] for t in trees}
    slots = {t: T._slots([nodes[i] for i in mine], trees)[t] for t, mine in asked.items()}
    shape = (len(features), BINS, classes)

    def work(batches):
        into = {t: np.zeros((len(mine), *shape)) for t, mine in asked.items()}
        for bins, y, rows, block in _unpacked(batches, width):
            bins = bins[features]
            for t, slot in slots.items():
                weight = drawn(seed, t, block, rows)
                there = np.flatnonzero(weight)
                mine = bins[:, there]
                B.class_sums(mine, slot[trees[t].leaves_of_bins(mine)], len(into[t]), y[there], classes, weight[there], into[t])
        return {i: sums for t, mine in asked.items() for i, sums in zip(mine, into[t]) if sums.any()}

    found = B.add_up(table, work)
    return [found.get(i, np.zeros(shape)).reshape(shape) for i in range(len(nodes))]


def _split(sums: np.ndarray, features: np.ndarray):
    """``(gain, feature, bin, left sums)`` of the best split on one of ``features``; nothing where none gains."""
    left = np.cumsum(sums[features], axis=1)
    total, left = left[:, -1:], left[:, :-1]
    right = total - left
    gain = T._score(left, 1) + T._score(right, 1) - T._score(total, 1)
    gain = np.where((left.sum(axis=-1) > 0) & (right.sum(axis=-1) > 0), gain, 0.0)
    k, b = divmod(T._first_best(gain.reshape(-1)), gain.shape[1])
    if gain[k, b] <= 1e-9 * total[k, 0].sum():
        return None
    return float(gain[k, b]), int(features[k]), b, left[k, b]


def _gains(tree: T.Growing, width: int) -> np.ndarray:
    """Share of each feature in the gains of a tree; splits between leaves of one class are taken back, the lowest first."""
    rows, best = [list(r) for r in tree.rows], [int(v.argmax()) for v in tree.values]
    out = np.zeros(width)
    for node in reversed(range(len(rows))):  # children come after their parent
        f, _, a, b, gain = rows[node]
        if f >= 0 and rows[a][0] < 0 and rows[b][0] < 0 and best[a] == best[b]:
            rows[node][0], best[node] = -1, best[a]
        elif f >= 0:
            out[f] += gain
    return out / out.sum() if out.sum() else out


def importances(table: DataFrame, width: int, features: Sequence[int], classes: int, trees: int, seed: int = 42) -> np.ndarray:
    """Importance of each of ``features`` (places among the ``width`` columns of the counted ``table``) in a forest on them."""
    features = list(features)
    s = T.Settings(seed=seed, features=len(features) if trees == 1 else ceil(sqrt(len(features))))
    grown = {t: T.Growing(classes) for t in range(trees)}
    level = [T.Open(t, grown[t].add(np.zeros(classes)), 1, 0) for t in range(trees)]
    most = max(1, B.ROOM // (len(features) * BINS * classes * 8))
    while level:
        ahead: list[T.Open] = []
        for a in range(0, len(level), most):
            part = level[a : a + most]
            for o, sums in zip(part, _ask(table, width, features, classes, seed, grown, part)):
                tree = grown[o.tree]
                total = sums[0].sum(axis=0)
                tree.values[o.node] = tree.share(total)
                found = _split(sums, T._order(s, o.tree, o.path, len(features))[: s.features])
                if found is None:
                    continue
                gain, f, b, left = found
                children = [tree.add(side) for side in (left, total - left)]
                tree.split(o.node, f, b, *children, gain)
                if o.depth + 1 < LEVELS:
                    sides = zip(children, (left, total - left))
                    ahead += [T.Open(o.tree, c, 2 * o.path + i, o.depth + 1) for i, (c, side) in enumerate(sides) if not T._pure(side, classes)]
        level = ahead
    total = sum(_gains(t, len(features)) for t in grown.values())
    return total / total.sum() if total.sum() else total
