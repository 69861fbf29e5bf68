"""Decision trees and random forests without a limit of depth.

The upper levels of all trees grow over the cluster: tasks add up class weights (or sums of the label) per node, feature and bin,
and the driver picks the splits: bins that may hold a better split than their edges are cut further, until the best of all values is
known. A node of at most ``limit`` rows is dealt, with its rows, to one task that finishes its subtree with
exact splits. A node above that limit whose rows its bins can't tell apart gets bins of its own. So no task gathers more than
``limit`` rows, and a table below the limit gives the exact tree.

The subtrees are a table. Where they are small (``SHIP`` bytes) they are joined to the upper trees and scoring is one pass;
otherwise rows to score are routed by the upper trees and meet their subtree in a co-group, dealt over salts.

Trees split on the Gini index (classes) or the variance (numbers), also where the best split gains nothing yet; a threshold lies
halfway between two values of the node, whether it is dealt or not. Each row of a forest's tree has a Poisson weight of mean 1 drawn from seed, tree and block.
Ties go to the first feature in the order of the node (its own order for every feature subset) and then to the smallest threshold.

Defined cases: missing values (NaN) go right; a row without features has no prediction; rows without a label take no part; one class, one
value or constant features give a single leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.models import blocks as B
from lumenframe.models.blocks import BINS, MISSING, Tree
from lumenframe.session import cut_lineage

#: Rows of a dealt node, and its cells where there are many features.
LIMIT = 50_000
LIMIT_CELLS = 1 << 24
#: Bytes of subtrees that are sent along with every task.
SHIP = 64 << 20
#: Numbers that the search for one split holds at a time.
CHUNK = 1 << 22
#: Cells that one pass asks for inside bins, and classes up to which all corners of a bin are looked at.
SPANS = 1 << 18
CORNERS = 6
#: Rows to score that meet one copy of a subtree.
SCORED = 50_000


@dataclass(frozen=True)
class Settings:
    trees: int = 1
    bootstrap: bool = False
    features: int | None = None
    max_depth: int | None = None
    min_leaf: int = 1
    min_split: int = 2
    seed: int = 42
    limit: int = LIMIT


def settings(name: str, params: dict, width: int) -> Settings:
    """Settings by the parameter names that users of tree models write."""
    p = {k: v for k, v in params.items() if v is not None}
    common = {
        "max_depth": int(p["max_depth"]) if p.get("max_depth") else None, "min_leaf": int(p.get("min_samples_leaf", 1)),
        "min_split": int(p.get("min_samples_split", 2)), "seed": int(p.get("random_state", 42)),
    }
    if name.startswith("Decision Tree"):
        return Settings(**common)
    subset = max(1, isqrt(width)) if name == "Random Forest Classifier" else None
    return Settings(trees=int(p.get("n_estimators", 100)), bootstrap=True, features=subset, **common)


def _score(sums: np.ndarray, classes: int) -> np.ndarray:
    """What a node adds to the quality of a split; sums are class weights, or weight and weighted label."""
    weight = sums.sum(axis=-1) if classes else sums[..., 0]
    power = (sums * sums).sum(axis=-1) if classes else sums[..., 1] ** 2
    return np.divide(power, weight, out=np.zeros_like(power), where=weight > 0)


def _weight(sums: np.ndarray, classes: int) -> np.ndarray:
    return sums.sum(axis=-1) if classes else sums[..., 0]


def _pure(total: np.ndarray, classes: int) -> bool:
    """Whether nothing is left to separate; numbers also carry the weighted square."""
    if classes:
        return total.max() >= total.sum() - 1e-9
    mean = total[1] / max(total[0], 1e-300)
    return total[2] / max(total[0], 1e-300) - mean * mean <= 1e-12 * max(1.0, mean * mean)


def _order(s: Settings, tree: int, path: int, width: int) -> np.ndarray:
    """The order in which a node looks at features."""
    if s.features is None:
        return np.arange(width)
    return np.random.default_rng([s.seed, tree, path % (1 << 61)]).permutation(width)


def _first_best(gain: np.ndarray) -> int:
    """Sums of floats in any order: gains within a hair of the best count as equal."""
    best = gain.max()
    return int(np.flatnonzero(gain >= best - 1e-9 * abs(best))[0])


def _pick(order: np.ndarray, s: Settings, search):
    """Best ``(gain, feature, ...)`` of the node's features; where they allow no split, of the first further one that does."""
    first = s.features or len(order)
    found = search(order[:first])
    for f in order[first:]:
        if found is not None:
            break
        found = search(np.array([f]))
    return found


def _histogram_split(sums: np.ndarray, order: np.ndarray, s: Settings, classes: int):
    """``(gain, feature, bin, left sums)`` from features x bins x sums."""
    left = np.cumsum(sums[:, :MISSING], axis=1)
    total = left[:, -1:] + sums[:, MISSING:]
    right = total - left
    gain = _score(left, classes) + _score(right, classes) - _score(total, classes)
    least = max(s.min_leaf, 1) - 1e-6
    gain = np.where((_weight(left, classes) >= least) & (_weight(right, classes) >= least), gain, -np.inf)

    def search(features):
        mine = gain[features]
        if not np.isfinite(mine.max(initial=-np.inf)):
            return None
        k, b = divmod(_first_best(mine.reshape(-1)), mine.shape[1])
        f = int(features[k])
        return float(mine[k, b]), f, b, left[f, b]

    return _pick(order, s, search)


def _exact_split(x: np.ndarray, stats: np.ndarray, order: np.ndarray, s: Settings, classes: int):
    """``(gain, feature, threshold)`` over all values of a dealt node."""
    total = stats.sum(axis=0)
    whole = _score(total, classes)
    least = max(s.min_leaf, 1) - 1e-6

    def search(features):
        best = None
        step = max(1, CHUNK // (len(x) * stats.shape[1]))
        for a in range(0, len(features), step):
            cols = features[a : a + step]
            values = x[:, cols]
            at = np.argsort(values, axis=0, kind="stable")
            values = np.take_along_axis(values, at, axis=0)
            left = np.cumsum(stats[at], axis=0)[:-1]
            right = total - left
            fine = (values[:-1] < values[1:]) | (~np.isnan(values[:-1]) & np.isnan(values[1:]))
            fine &= (_weight(left, classes) >= least) & (_weight(right, classes) >= least)
            gain = np.where(fine, _score(left, classes) + _score(right, classes) - whole, -np.inf).T
            if not np.isfinite(gain.max(initial=-np.inf)):
                continue
            k, i = divmod(_first_best(gain.reshape(-1)), gain.shape[1])
            if best is None or gain[k, i] > best[0] + 1e-9 * abs(best[0]):
                lo, hi = values[i, k], values[i + 1, k]
                cut = lo if np.isnan(hi) or not lo <= (lo + hi) / 2 < hi else (lo + hi) / 2
                best = (float(gain[k, i]), int(cols[k]), float(cut))
        return best

    return _pick(order, s, search)


class Growing:
    """Nodes of a tree as they come; a leaf keeps its sums."""

    def __init__(self, classes: int):
        self.classes = classes
        self.rows: list[list] = []
        self.values: list[np.ndarray] = []

    def add(self, total: np.ndarray) -> int:
        self.rows.append([-1, 0.0, 0, 0, 0.0])
        self.values.append(self.share(total))
        return len(self.rows) - 1

    def share(self, total: np.ndarray) -> np.ndarray:
        """What a leaf of these sums predicts: the shares of classes, or the mean."""
        return total / max(total.sum(), 1e-300) if self.classes else np.array([total[1] / max(total[0], 1e-300)])

    def split(self, node: int, feature: int, threshold: float, left: int, right: int, gain: float) -> None:
        self.rows[node] = [feature, threshold, left, right, gain]

    def arrays(self) -> tuple[Tree, np.ndarray]:
        n = len(self.rows)
        f, cut, a, b, gain = (np.array(c, k) for c, k in zip(zip(*self.rows), (np.int64, float, np.int64, np.int64, float)))
        zeros = np.zeros(n, np.int64)
        return Tree(f, zeros, cut, np.zeros(n, bool), a, b, np.zeros(n), gain), np.array(self.values)


def finish(x: np.ndarray, y: np.ndarray, w: np.ndarray, s: Settings, classes: int, tree: int, path: int, depth: int) -> tuple[Tree, np.ndarray]:
    """The exact subtree of a node's rows."""
    grown = Growing(classes)

    def totals(rows):
        if classes:
            return np.bincount(y[rows].astype(np.int64), weights=w[rows], minlength=classes)
        return np.array([w[rows].sum(), (w[rows] * y[rows]).sum(), (w[rows] * y[rows] ** 2).sum()])

    def statistics(rows):
        if classes:
            out = np.zeros((len(rows), classes))
            out[np.arange(len(rows)), y[rows].astype(np.int64)] = w[rows]
            return out
        middle = (w[rows] * y[rows]).sum() / max(w[rows].sum(), 1e-300)
        return np.stack([w[rows], w[rows] * (y[rows] - middle)], axis=1)

    everything = np.flatnonzero(w > 0)
    stack = [(grown.add(totals(everything)), everything, path, depth)]
    while stack:
        node, rows, at, level = stack.pop()
        total = totals(rows)
        if (s.max_depth is not None and level >= s.max_depth) or _weight(total, classes) < s.min_split or _pure(total, classes):
            continue
        found = _exact_split(x[rows], statistics(rows), _order(s, tree, at, x.shape[1]), s, classes)
        if found is None:
            continue
        gain, f, cut = found
        side = x[rows, f] <= cut
        parts = rows[side], rows[~side]
        a, b = (grown.add(totals(p)) for p in parts)
        grown.split(node, f, cut, a, b, gain)
        stack += [(a, parts[0], 2 * at, level + 1), (b, parts[1], 2 * at + 1, level + 1)]
    return grown.arrays()


BLOCK = "n int, bins binary, x binary, y binary"


def _row_blocks(rows: DataFrame, edges, shift: float) -> DataFrame:
    """Blocks with the values beside the bins, numbered; labels are shifted by ``shift``."""
    width = len(edges)
    most = max(256, B.CELLS // max(1, width))

    def run(batches):
        for batch in batches:
            x, y = B.matrix(batch.column(0), width), batch.column(1).to_numpy(zero_copy_only=False) - shift
            cuts = [(a, min(a + most, len(y))) for a in range(0, len(y), most)]
            columns = [
                pa.array([b - a for a, b in cuts], pa.int32()), pa.array([B.binned(x[a:b], edges).tobytes() for a, b in cuts], pa.binary()),
                pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([y[a:b].tobytes() for a, b in cuts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "bins", "x", "y"])

    return rows.mapInArrow(run, BLOCK).withColumn("block", F.monotonically_increasing_id())


def _unpacked(batches, width: int):
    for batch in batches:
        for n, bins, x, y, block in zip(*(batch.column(i) for i in range(5))):  # one block at a time: a batch may hold all of a task's
            n = n.as_py()
            bins, x, y = np.frombuffer(bins.as_buffer(), np.uint8), np.frombuffer(x.as_buffer()), np.frombuffer(y.as_buffer())
            yield bins.reshape(width, n), x.reshape(n, width), y, block.as_py()


def row_weights(s: Settings, tree: int, block: int, n: int) -> np.ndarray:
    """How often each row of a block is in the sample of a tree."""
    if not s.bootstrap:
        return np.ones(n)
    return np.random.default_rng([s.seed, tree, block]).poisson(1.0, n).astype(float)


def _statistics(y: np.ndarray, w: np.ndarray, classes: int) -> list[np.ndarray]:
    return [w * (y == c) for c in range(classes)] if classes else [w, w * y, w * y * y]


@dataclass(eq=False)
class Open:
    """A node that is still to be split: where it stands, what it sums to, and bins of its own if it needs them."""

    tree: int
    node: int
    path: int
    depth: int
    total: np.ndarray | None = None
    edges: list[np.ndarray] | None = None
    own: bool = False


def _slots(nodes: list[Open], trees: dict[int, Tree]) -> dict[int, np.ndarray]:
    """Per tree, the number in ``nodes`` of each of its nodes, -1 for the others."""
    out = {}
    for i, o in enumerate(nodes):
        out.setdefault(o.tree, np.full(len(trees[o.tree].feature), -1))[o.node] = i
    return out


def _ask(table: DataFrame, width: int, classes: int, s: Settings, grown: dict[int, Growing], nodes: list[Open]) -> dict[int, np.ndarray]:
    """Sums (features x bins x sums) of each of ``nodes``."""
    trees = {t: grown[t].arrays()[0] for t in {o.tree for o in nodes}}
    # A block is added up tree by tree, into the nodes of that tree only.
    asked = {t: [i for i, o in enumerate(nodes) if o.tree == t] for t in trees}
    slots = {t: _slots([nodes[i] for i in mine], trees)[t] for t, mine in asked.items()}
    own = {t: {k: nodes[i].edges for k, i in enumerate(mine) if nodes[i].edges is not None} for t, mine in asked.items()}
    shape = (width, BINS, classes or 3)

    def add(bins, place, y, w, into):
        if classes:
            B.class_sums(bins, place, len(into), y, classes, w, into)
        else:
            B.node_sums(bins, place, len(into), _statistics(y, w, classes), into)

    def work(batches):
        into = {t: np.zeros((len(mine), *shape)) for t, mine in asked.items()}
        for bins, x, y, block in _unpacked(batches, width):
            for t, slot in slots.items():
                place = slot[trees[t].leaves(x)]
                w = row_weights(s, t, block, len(y))
                for k, edges in own[t].items():
                    rows = np.flatnonzero(place == k)
                    if len(rows):
                        add(B.binned(x[rows], edges), place[rows], y[rows], w[rows], into[t])
                        place[rows] = -1
                add(bins, place, y, w, into[t])
        return {i: sums for t, mine in asked.items() for i, sums in zip(mine, into[t]) if sums.any()}

    found = B.add_up(table, work)
    return {i: found.get(i, np.zeros(shape)).reshape(shape) for i in range(len(nodes))}


def _rows_of(table: DataFrame, width: int, tree: Tree, node: int) -> DataFrame:
    """``x`` of the rows that reach a node."""

    def run(batches):
        for _, x, _, _ in _unpacked(batches, width):
            mine = x[tree.leaves(x) == node]
            yield pa.RecordBatch.from_arrays([pa.array(list(mine), pa.list_(pa.float64()))], names=["x"])

    return table.mapInArrow(run, "x array<double>")


DEALT = "slot int, x binary, y binary, w binary"
SUBTREE = "tree int, node int, feature binary, threshold binary, left binary, right binary, gain binary, shares binary"


def _deal(table: DataFrame, width: int, classes: int, s: Settings, grown: dict[int, Growing], nodes: list[Open]) -> DataFrame:
    """Finish ``nodes``, each in the task that its rows are dealt to: one row per subtree."""
    trees = {t: grown[t].arrays()[0] for t in {o.tree for o in nodes}}
    slots = _slots(nodes, trees)
    heads = [(o.tree, o.node, o.path, o.depth) for o in nodes]

    def cut(batches):
        for _, x, y, block in _unpacked(batches, width):
            out = ([], [], [], [])
            for t, slot in slots.items():
                w = row_weights(s, t, block, len(y))
                place = np.where(w > 0, slot[trees[t].leaves(x)], -1)
                for i in np.unique(place[place >= 0]).tolist():
                    rows = np.flatnonzero(place == i)
                    for column, value in zip(out, (i, x[rows].tobytes(), y[rows].tobytes(), w[rows].tobytes())):
                        column.append(value)
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["slot", "x", "y", "w"])

    def grow(table: pa.Table) -> pa.Table:
        x, y, w = (np.concatenate([np.frombuffer(b.as_buffer()) for b in table.column(c)]) for c in ("x", "y", "w"))
        t, node, path, depth = heads[table.column("slot")[0].as_py()]
        tree, values = finish(x.reshape(-1, width), y, w, s, classes, t, path, depth)
        cells = (tree.feature, tree.threshold, tree.left, tree.right, tree.gain, values)
        row = [pa.array([t], pa.int32()), pa.array([node], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)]
        return pa.table(row, names=["tree", "node", "feature", "threshold", "left", "right", "gain", "shares"])

    return table.mapInArrow(cut, DEALT).groupBy("slot").applyInArrow(grow, SUBTREE)


def _unpack_subtree(row, k: int) -> tuple[Tree, np.ndarray]:
    f, a, b = (np.frombuffer(row[c], np.int64) for c in ("feature", "left", "right"))
    n = len(f)
    gain = np.frombuffer(row["gain"])
    tree = Tree(f, np.zeros(n, np.int64), np.frombuffer(row["threshold"]), np.zeros(n, bool), a, b, np.zeros(n), gain)
    return tree, np.frombuffer(row["shares"]).reshape(n, k)


def _joined(tree: Tree, values: np.ndarray, subtrees: list[tuple[int, Tree, np.ndarray]]) -> tuple[Tree, np.ndarray]:
    """An upper tree with subtrees in the place of its leaves."""
    if not subtrees:
        return tree, values
    parts, shares, n = [tree], [values], len(tree.feature)
    heads = []
    for node, sub, own in subtrees:
        moved = Tree(sub.feature, sub.bin, sub.threshold, sub.missing_left, sub.left + n, sub.right + n, sub.value, sub.gain)
        heads.append((node, n))
        parts.append(moved)
        shares.append(own)
        n += len(sub.feature)
    out = Tree(*(np.concatenate([getattr(p, name) for p in parts]) for name in Tree.__dataclass_fields__))
    merged = np.concatenate(shares)
    for node, at in heads:
        for column in (out.feature, out.threshold, out.left, out.right, out.gain, merged):
            column[node] = column[at]
    return out, merged


@dataclass(frozen=True)
class Forest:
    """Trees with the share of each class (or the mean) per node; ``subtrees`` is a table of finished nodes that are not joined."""

    trees: tuple[tuple[Tree, np.ndarray], ...]
    classes: int
    width: int
    subtrees: DataFrame | None = None
    gains: tuple[float, ...] = ()
    base: float = 0.0
    kind: str = field(default="forest", init=False)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 (the name that Spark's trees use)
        """Share of each feature in the gains of all splits."""
        total = np.array(self.gains)
        return DenseVector(total / total.sum() if total.sum() else total)

    @property
    def _k(self) -> int:
        return self.classes or 1

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, and ``probability`` where the label is a class."""
        out = self._shipped(df) if self.subtrees is None else self._routed(df)
        if not self.classes:
            return out.withColumn("prediction", F.col("_shares")[0]).drop("_shares")
        best = (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double")
        named = F.when(F.col("_shares").isNotNull(), array_to_vector("_shares"))
        return out.withColumn("probability", named).withColumn("prediction", best).drop("_shares")

    def _shipped(self, df: DataFrame) -> DataFrame:
        """Every tree goes along with the tasks; no shuffle."""

        @F.arrow_udf("array<double>")
        def scored(column: pa.Array) -> pa.Array:
            there = column.is_valid().to_numpy(zero_copy_only=False)
            x = B.matrix(column.drop_null(), self.width)
            found = sum(values[tree.leaves(x)] for tree, values in self.trees) / len(self.trees) + self.base
            rows = iter(found.tolist())
            return pa.array([next(rows) if t else None for t in there], pa.list_(pa.float64()))

        return df.withColumn("_shares", scored(F.when(F.col("features").isNotNull(), vector_to_array("features"))))

    def _routed(self, df: DataFrame) -> DataFrame:
        """Rows go to the subtrees that they reach: a group is a subtree and at most about ``SCORED`` rows."""
        trees, k, width = [t for t, _ in self.trees], self._k, self.width
        values = [v for _, v in self.trees]
        rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
        open_ = {}
        for t, node in self.subtrees.select("tree", "node").collect():  # one short row per subtree: the upper trees have as many leaves
            open_.setdefault(t, set()).add(node)
        held = {t: np.array(sorted(nodes)) for t, nodes in open_.items()}

        def route(batches):
            for batch in batches:
                x, ids = B.matrix(batch.column(1), width), batch.column(0).to_numpy()
                for t, tree in enumerate(trees):
                    leaf = tree.leaves(x)
                    goes = np.isin(leaf, held.get(t, np.zeros(0, int)))
                    shares = [None if g else v for g, v in zip(goes, values[t][leaf].tolist())]
                    cells = [x[i].tobytes() if g else None for i, g in enumerate(goes)]
                    n = len(ids)
                    columns = [
                        pa.array(ids), pa.array(np.full(n, t, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(cells, pa.binary()),
                        pa.array(shares, pa.list_(pa.float64())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["_row", "tree", "node", "x", "shares"])

        asked = rows.where("features is not null").select("_row", vector_to_array("features").alias("x"))
        routed = cut_lineage(asked.mapInArrow(route, "_row long, tree int, node int, x binary, shares array<double>"))
        waiting = routed.where("x is not null")
        crowds = waiting.groupBy("tree", "node").agg(F.count("*").alias("n"))
        crowds = crowds.select("tree", "node", F.ceil(F.col("n") / SCORED).cast("int").alias("salts"))
        salted = waiting.join(crowds, ["tree", "node"]).withColumn("salt", F.pmod("_row", "salts").cast("int"))
        copies = self.subtrees.join(crowds, ["tree", "node"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return pa.table({"_row": pa.array([], pa.int64()), "shares": pa.array([], pa.list_(pa.float64()))})
            tree, own = _unpack_subtree({c: right.column(c)[0].as_py() for c in right.column_names}, k)
            x = np.concatenate([np.frombuffer(b.as_buffer()) for b in left.column("x")]).reshape(-1, width)
            return pa.table({"_row": left.column("_row"), "shares": pa.array(own[tree.leaves(x)].tolist(), pa.list_(pa.float64()))})

        keys = ["tree", "node", "salt"]
        met = salted.groupBy(*keys).cogroup(copies.drop("salts").groupBy(*keys)).applyInArrow(meet, "_row long, shares array<double>")
        every = met.unionByName(routed.where("x is null").select("_row", "shares"))
        means = [(F.avg(F.col("shares")[i]) + self.base).alias(f"_s{i}") for i in range(k)]
        shares = every.groupBy("_row").agg(*means).select("_row", F.array(*[f"_s{i}" for i in range(k)]).alias("_shares"))
        return rows.join(shares, "_row", "left").drop("_row")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [
            (t, -1, tree.feature.tobytes(), tree.threshold.tobytes(), tree.left.tobytes(), tree.right.tobytes(), tree.gain.tobytes(), values.tobytes())
            for t, (tree, values) in enumerate(self.trees)
        ]
        # One row per tree, bounded by what the driver holds anyway; finished nodes are written from their table.
        spark.createDataFrame([tuple(bytearray(c) if isinstance(c, bytes) else c for c in r) for r in rows], SUBTREE).write.mode("overwrite").parquet(f"{path}/trees")
        if self.subtrees is not None:
            self.subtrees.write.mode("overwrite").parquet(f"{path}/subtrees")
        head = [(self.classes, self.width, [float(g) for g in self.gains], self.base, self.subtrees is not None)]
        spark.createDataFrame(head, HEAD).coalesce(1).write.mode("overwrite").parquet(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        head = spark.read.schema(HEAD).parquet(f"{path}/head").first()
        rows = spark.read.schema(SUBTREE).parquet(f"{path}/trees").orderBy("tree").collect()
        trees = tuple(_unpack_subtree(r, head["classes"] or 1) for r in rows)
        subtrees = spark.read.schema(SUBTREE).parquet(f"{path}/subtrees") if head["apart"] else None
        return cls(trees, head["classes"], head["width"], subtrees, tuple(head["gains"]), head["base"])


HEAD = "classes int, width int, gains array<double>, base double, apart boolean"


def _most(left: np.ndarray, upto: np.ndarray, total: np.ndarray, classes: int) -> np.ndarray:
    """What a split between two cuts may reach at most; ``left`` and ``upto`` are the sums below these cuts.

    The quality is convex in the sums, so corners of where they can lie bound it; so do the rows between the cuts, parted from each other.
    """
    inside, rest = upto - left, total - upto
    bound = _score(left, classes) + _score(rest, classes) + (inside.sum(axis=-1) if classes else inside[..., 2])
    if classes and classes <= CORNERS:
        corner = np.full(bound.shape, -np.inf)
        for picks in range(1 << classes):
            at = np.where([picks >> c & 1 for c in range(classes)], upto, left)
            corner = np.maximum(corner, _score(at, classes) + _score(total - at, classes))
        bound = np.minimum(bound, corner)
    elif not classes:
        w = np.maximum(inside[..., 0], 1e-300)
        spread = np.sqrt(np.maximum(w * inside[..., 2] - inside[..., 1] ** 2, 0.0)) / 2
        corner = np.full(bound.shape, -np.inf)
        for at in (left, upto):
            for side in (-spread, spread):
                moved = at.copy()
                moved[..., 1] += side
                corner = np.maximum(corner, _score(moved, 0) + _score(total - moved, 0))
        bound = np.where((left[..., 0] > 0) & (rest[..., 0] > 0), np.minimum(bound, corner), bound)
    return bound - _score(total, classes)


def _ordered(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of ``v``, and back."""
    i = v.view(np.int64)
    return np.where(i < 0, np.int64(-(2**63)) - i, i)


def _inner_cuts(lo: float, hi: float, n: int) -> np.ndarray:
    """About ``n`` rising cuts between ``lo`` and ``hi``: even steps, and even steps of the digits; one just above ``lo``."""
    steps = np.arange(1, max(2, n // 2)) / max(2, n // 2)
    a, b = (int(v) for v in _ordered(np.array([lo, hi])))
    digits = np.array([a + int((b - a) * s) for s in steps], np.int64)
    digits = np.where(digits < 0, np.int64(-(2**63)) - digits, digits).view(float)
    with np.errstate(all="ignore"):
        cuts = np.concatenate([[np.nextafter(lo, np.inf)], lo * (1 - steps) + hi * steps, digits])
    return np.unique(cuts[(cuts > lo) & (cuts < hi)])  # no NaN, which is neither


def _look(table: DataFrame, edges, classes: int, s: Settings, grown: dict[int, Growing], nodes: list[Open], spans: list[tuple]) -> list[tuple]:
    """``(sums, least, largest)`` per cell of each span ``(node, feature, lo, hi, cuts)``: values above ``lo`` up to ``hi``, in cells up to each cut."""
    width, k = len(edges), classes or 3
    trees = {t: grown[t].arrays()[0] for t in {nodes[sp[0]].tree for sp in spans}}
    slots = _slots(nodes, {o.tree: grown[o.tree].arrays()[0] for o in nodes})
    plan: dict[int, dict[int, tuple]] = {t: {} for t in trees}
    first, cells = [], dict.fromkeys(range(len(nodes)), 0)
    by_place: dict[tuple, list[int]] = {}
    for j, (i, f, _, _, cuts) in enumerate(spans):
        first.append(cells[i])
        cells[i] += len(cuts) + 1
        by_place.setdefault((i, f), []).append(j)
    for (i, f), mine in by_place.items():
        mask, at = plan[nodes[i].tree].setdefault(f, (np.zeros(BINS, bool), {}))
        bounds, codes = [], []
        for j in sorted(mine, key=lambda j: spans[j][2]):
            _, _, lo, hi, cuts = spans[j]
            mask[np.searchsorted(edges[f], lo, side="right") : np.searchsorted(edges[f], hi, side="left") + 1] = True
            if lo > -np.inf and not (bounds and bounds[-1][-1] >= lo):
                bounds.append([lo])
                codes.append([-1])
            bounds.append([*cuts, hi])
            codes.append(range(first[j], first[j] + len(cuts) + 1))
        at[i] = np.concatenate(bounds), np.concatenate([*codes, [-1]]).astype(np.int64)

    def work(batches):
        into: dict[int, tuple] = {}
        for bins, x, y, block in _unpacked(batches, width):
            for t, features in plan.items():
                w = None
                for f, (mask, at) in features.items():
                    rows = np.flatnonzero(mask[bins[f]])
                    if not len(rows):
                        continue
                    w = row_weights(s, t, block, len(y)) if w is None else w
                    rows = rows[w[rows] > 0]
                    place = slots[t][trees[t].leaves(x[rows])]
                    order = np.argsort(place, kind="stable")
                    rows, place = rows[order], place[order]
                    for i, (bounds, codes) in at.items():
                        mine = rows[slice(*np.searchsorted(place, [i, i + 1]))]
                        v = x[mine, f]
                        cell = codes[np.searchsorted(bounds, v, side="left")]
                        there = (cell >= 0) & ~np.isnan(v)
                        mine, v, cell = mine[there], v[there], cell[there]
                        if not len(mine):
                            continue
                        if i not in into:
                            into[i] = np.zeros((cells[i], k)), np.full(cells[i], -np.inf), np.full(cells[i], -np.inf)
                        sums, least, largest = into[i]
                        if classes:
                            sums += np.bincount(cell * k + y[mine].astype(np.int64), weights=w[mine], minlength=sums.size).reshape(sums.shape)
                        else:
                            for c, part in enumerate(_statistics(y[mine], w[mine], 0)):
                                sums[:, c] += np.bincount(cell, weights=part, minlength=len(sums))
                        np.maximum.at(least, cell, -v)
                        np.maximum.at(largest, cell, v)
        return {i: np.concatenate([c.reshape(-1) for c in arrays]) for i, arrays in into.items()}

    found = B.add_up(table, work, (2, k + 2))
    out = []
    for j, sp in enumerate(spans):
        n, part = cells[sp[0]], slice(first[j], first[j] + len(sp[4]) + 1)
        if sp[0] in found:
            row = found[sp[0]]
            out.append((row[: n * k].reshape(n, k)[part], -row[n * k : n * (k + 1)][part], row[n * (k + 1) :][part]))
        else:
            m = len(sp[4]) + 1
            out.append((np.zeros((m, k)), np.full(m, np.inf), np.full(m, -np.inf)))
    return out


class _Choice:
    """The best splits of a node so far, and the spans of values where a better one may be."""

    def __init__(self, o: Open, sums: np.ndarray, edges, s: Settings, classes: int):
        self.classes, self.least = classes, max(s.min_leaf, 1) - 1e-6
        self.total = sums[0].sum(axis=0)
        order = _order(s, o.tree, o.path, len(edges))
        self.turn = np.empty(len(edges), np.int64)
        self.turn[order] = np.arange(len(edges))
        # The features of the node's subset compete; each further one counts only where none before it allows a split.
        self.group = np.maximum(0, self.turn - (s.features or len(edges)) + 1)
        self.found: list[tuple] = []
        self.spans: list[tuple] = []
        self.full: list[np.ndarray] = []
        for f, e in enumerate(edges):
            mine = sums[f, : len(e) + 1]
            held = np.flatnonzero(_weight(mine, classes) > 0)
            ends = np.concatenate([[-np.inf], e, [np.inf]])
            self.full.append(ends[held + 1])
            self.add(f, np.zeros_like(self.total), mine[held], ends[held], ends[held + 1], ends[held + 1])

    def add(self, f: int, below: np.ndarray, sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, cuts: np.ndarray, wide: np.ndarray | None = None) -> None:
        """Cells of a feature in rising order: splits at ``cuts`` behind them, and what may lie inside those that are ``wide``."""
        if not len(sums):
            return
        upto = below + np.cumsum(sums, axis=0)
        left, rest = upto - sums, self.total - upto
        a, b = _weight(upto, self.classes) >= self.least, _weight(rest, self.classes) >= self.least
        gain = _score(upto, self.classes) + _score(rest, self.classes) - _score(self.total, self.classes)
        for j in np.flatnonzero(a & b):
            self.found.append((self.group[f], float(gain[j]), self.turn[f], float(cuts[j]), f, upto[j]))
        may = a & (_weight(self.total - left, self.classes) >= self.least)
        may &= True if wide is None else wide
        if self.classes:
            may &= (sums > 0).sum(axis=1) > 1  # between rows of one class no cut is better than the ends
        bound = _most(left, upto, np.broadcast_to(self.total, upto.shape), self.classes)
        for j in np.flatnonzero(may):
            self.spans.append((float(bound[j]), self.group[f], f, float(lo[j]), float(hi[j]), left[j]))

    def settle(self) -> None:
        """Forget what can't be the best any more."""
        group = min((c[0] for c in self.found), default=np.inf)
        best = max((c[1] for c in self.found if c[0] == group), default=-np.inf)
        hair = 1e-9 * abs(best) if self.found else 0.0
        dust = 1e-12 * abs(float(_score(self.total, self.classes)))
        self.found = [c for c in self.found if c[0] == group and c[1] >= best - hair]
        self.spans = [p for p in self.spans if p[1] < group or (p[1] == group and p[0] >= best - hair - dust)]

    def best(self):
        """``(gain, feature, cut, left sums)``: of equal gains the first feature, then the smallest cut."""
        if not self.found:
            return None
        _, gain, _, cut, f, left = min(self.found, key=lambda c: (c[2], c[3]))
        return gain, f, cut, left


def _splits(table: DataFrame, edges, classes: int, s: Settings, grown: dict[int, Growing], nodes: list[Open], sums: list[np.ndarray]) -> list:
    """``(gain, feature, threshold, left sums)`` of the best split of each node over all its values, as a dealt node has it; nothing where there is none.

    Sums per bin tell which bins may hold a better split than their edges; only these are cut further, until none is left.
    """
    choices = [_Choice(o, sums[i], o.edges or edges, s, classes) for i, o in enumerate(nodes)]
    while True:
        for c in choices:
            c.settle()
        waiting = sorted(((p, i) for i, c in enumerate(choices) for p in c.spans), key=lambda w: -w[0][0])[: SPANS // 4]
        if not waiting:
            break
        each = min(256, SPANS // len(waiting))
        spans = [(i, p[2], p[3], p[4], _inner_cuts(p[3], p[4], each)) for p, i in waiting]
        taken = {id(p) for p, _ in waiting}
        for c in choices:
            c.spans = [p for p in c.spans if id(p) not in taken]
        for (p, i), (cells, least, largest) in zip(waiting, _look(table, edges, classes, s, grown, nodes, spans)):
            held = np.flatnonzero(least <= largest)
            lo, hi = least[held], largest[held]
            choices[i].add(p[2], p[5], cells[held], np.nextafter(lo, -np.inf), hi, hi, lo < hi)
    best = [c.best() for c in choices]
    # A threshold lies halfway between the values beside the cut.
    spans = []
    for i, found in enumerate(best):
        if found is not None:
            ends, own = choices[i].full[found[1]], (nodes[i].edges or edges)[found[1]]
            lo = np.searchsorted(own, found[2], side="left") - 1
            hi = ends[np.searchsorted(ends, found[2], side="right") :]
            last = float(hi[:2][-1]) if len(hi) else float(max(ends[-1], found[2]))  # a bin's own values may end at the cut
            spans.append((i, found[1], float(own[lo]) if lo >= 0 else -np.inf, last, np.array([found[2]]) if found[2] < last else np.zeros(0)))
    if spans:
        for (i, *_), (_, least, largest) in zip(spans, _look(table, edges, classes, s, grown, nodes, spans)):
            gain, f, cut, left = best[i]
            lo = float(largest[0]) if np.isfinite(largest[0]) else cut
            hi = float(least[1]) if len(least) > 1 and least[1] <= largest[1] else np.nan
            middle = lo + (hi - lo) / 2 if np.isinf(lo + hi) and np.isfinite(lo) and np.isfinite(hi) else (lo + hi) / 2
            best[i] = gain, f, lo if np.isnan(hi) or not lo <= middle < hi else middle, left
    return best


def _grow_upper(table: DataFrame, edges, classes: int, s: Settings, limit: int, n: int) -> tuple[dict[int, Growing], list[Open]]:
    """Upper trees, and the nodes of at most ``limit`` rows that are still to be finished; both kinds of nodes split alike."""
    width = len(edges)
    grown = {t: Growing(classes) for t in range(s.trees)}
    nothing = np.zeros(classes or 3)
    large = [Open(t, grown[t].add(nothing), 1, 0) for t in range(s.trees)]
    small: list[Open] = []
    # Sampled rows vary around their number: a root is below the limit with room to spare, or it is counted first.
    if n * (1.5 if s.bootstrap else 1) <= limit:
        large, small = [], large
    most = max(1, B.ROOM // (width * BINS * len(nothing) * 8))
    while large:
        ahead: list[Open] = []
        for a in range(0, len(large), most):
            part = large[a : a + most]
            sums = _ask(table, width, classes, s, grown, part)
            wanted = []
            for i, o in enumerate(part):
                total = sums[i][0].sum(axis=0)
                if o.total is None:
                    grown[o.tree].values[o.node] = grown[o.tree].share(total)
                    o.total = total
                weight = _weight(total, classes)
                if (s.max_depth is not None and o.depth >= s.max_depth) or weight < s.min_split or _pure(total, classes):
                    continue
                if weight <= limit:
                    small.append(o)
                    continue
                if not o.own and _histogram_split(sums[i], _order(s, o.tree, o.path, width), s, classes) is None:
                    # The bins that it shares see one value: bins from the rows of this node.
                    o.own = True
                    o.edges = B.edges_of(_rows_of(table, width, grown[o.tree].arrays()[0], o.node), width)
                    ahead.append(o)
                    continue
                wanted.append(i)
            for i, found in zip(wanted, _splits(table, edges, classes, s, grown, [part[i] for i in wanted], [sums[i] for i in wanted])):
                if found is None:
                    continue
                o, total = part[i], sums[i][0].sum(axis=0)
                gain, f, cut, left = found
                children = []
                for side, part_total in enumerate((left, total - left)):
                    child = grown[o.tree].add(part_total)
                    children.append(child)
                    c = Open(o.tree, child, 2 * o.path + side, o.depth + 1, part_total, o.edges)
                    weight = _weight(part_total, classes)
                    if (s.max_depth is not None and c.depth >= s.max_depth) or weight < s.min_split:
                        continue
                    # Rows that shared a bin are dealt as soon as they are few, pure or not.
                    if _pure(part_total, classes) and not (o.own and weight <= limit):
                        continue
                    (small if weight <= limit else ahead).append(c)
                grown[o.tree].split(o.node, f, cut, *children, gain)
        large = ahead
    return grown, small


def fit(df: DataFrame, classes: int, s: Settings, ship: int = SHIP) -> Forest:
    """Trees on ``features`` and ``label``; ``classes`` 0 means that the label is a number."""
    rows = B.rows_for_trees(df)
    first = rows.first()
    if first is None:
        share = np.full(classes, 1 / classes) if classes else np.zeros(1)
        return Forest((_leaf(share, classes),) * s.trees, classes, 0, None, ())
    width = len(first["x"])
    n, mean = rows.agg(F.count("*"), F.avg("y")).first()
    base = 0.0 if classes else float(mean)
    limit = max(2, min(s.limit, LIMIT_CELLS // max(1, width)))
    # A table that is dealt as a whole needs no bins.
    dealt = n * (1.5 if s.bootstrap else 1) <= limit
    edges = [np.zeros(0)] * width if dealt else B.edges_of(rows, width)
    table = cut_lineage(_row_blocks(rows, edges, base))
    grown, small = _grow_upper(table, edges, classes, s, limit, n)
    upper = {t: g.arrays() for t, g in grown.items()}
    gains = np.zeros(width)
    for tree, _ in upper.values():
        inner = tree.feature >= 0
        np.add.at(gains, tree.feature[inner], tree.gain[inner])
    subtrees = None
    if small:
        subtrees = cut_lineage(_deal(table, width, classes, s, grown, small))
        size = reduce(lambda a, b: a + b, [F.octet_length(c) for c in ("feature", "threshold", "left", "right", "gain", "shares")])
        gains += _gains_of(subtrees, width)
        if subtrees.agg(F.sum(size)).first()[0] <= ship:
            found: dict[int, list] = {}
            for r in subtrees.collect():  # at most ``ship`` bytes
                found.setdefault(r["tree"], []).append((r["node"], *_unpack_subtree(r, classes or 1)))
            upper = {t: _joined(*upper[t], sorted(found.get(t, []), key=lambda p: p[0])) for t in upper}
            subtrees = None
            if len(found) < len({o.tree for o in small}):
                # No row of a tiny table came into the sample of these trees: they know the table's shares.
                counts = dict(rows.groupBy("y").count().collect()) if classes else {}
                share = np.array([counts.get(float(c), 0) / n for c in range(classes)]) if classes else np.zeros(1)
                upper.update({t: _leaf(share, classes) for t in {o.tree for o in small} - found.keys()})
    return Forest(tuple(upper[t] for t in range(s.trees)), classes, width, subtrees, tuple(gains), base)


def _leaf(share: np.ndarray, classes: int) -> tuple[Tree, np.ndarray]:
    grown = Growing(classes)
    grown.add(np.zeros(classes or 3))
    tree, _ = grown.arrays()
    return tree, share[None]


def _gains_of(subtrees: DataFrame, width: int) -> np.ndarray:
    """Gains of the splits of all finished nodes, by feature: one short array per task."""

    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            for feature, gain in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f, g = np.frombuffer(feature, np.int64), np.frombuffer(gain)
                np.add.at(total, f[f >= 0], g[f >= 0])
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(total)], names=["feature", "gain"])

    found = subtrees.select("feature", "gain").mapInArrow(run, "feature int, gain double").groupBy("feature").agg(F.sum("gain")).collect()
    out = np.zeros(width)
    for f, g in found:
        out[f] = g
    return out
