"""Gradient boosting on histograms, with second-order gains, leaf-wise growth and a learned side for missing values.

Features are cut into at most 255 bins once. A round grows one tree per class from the gradients of the loss: tasks add up
gradient, hessian and rows per node, feature and bin; the driver finds the splits in those sums. Trees grow best gain first.
One pass asks for the children of all open leaves at once (of two children only the smaller one, the other is the rest), so a
tree takes about as many passes as it has levels, and the trees of all classes share them. Every few rounds the margins are
written beside the bins, so that a pass evaluates only the trees since then.

Losses: squared error; logistic for two classes; softmax for more, one tree per class and round, so that the probabilities of
all classes sum to 1 (Friedman, "Greedy function approximation", 2001). A leaf's value is a Newton step with l1 and l2 penalties
(Chen and Guestrin, "XGBoost", 2016; leaf-wise growth as by Ke et al., "LightGBM", 2017).

Defined cases: a missing value (null or NaN) goes to the side with the higher gain, where training had none to the side with more
rows; a row without features has no prediction; with one class or one value only, no tree is grown.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.models import blocks as B
from lumenframe.models.blocks import BINS, MISSING, Tree
from lumenframe.session import cut_lineage

#: Rounds whose trees a pass evaluates before the margins are written.
ROUNDS_APART = 8


@dataclass(frozen=True)
class Settings:
    """``by_rows``: splits are judged by rows instead of hessians, as by least squares on the gradients."""

    rounds: int = 100
    rate: float = 0.1
    max_depth: int | None = None
    max_leaves: int | None = None
    l1: float = 0.0
    l2: float = 0.0
    min_gain: float = 0.0
    min_rows: int = 1
    min_hessian: float = 0.0
    bins: int = MISSING
    by_rows: bool = False


def settings(name: str, params: dict) -> Settings:
    """Settings of a model family, by the parameter names that its users write."""
    p = {k: v for k, v in params.items() if v is not None}
    depth = int(p["max_depth"]) if int(p.get("max_depth", 0)) > 0 else None
    common = {"rounds": int(p.get("n_estimators", 100)), "l1": float(p.get("reg_alpha", 0.0)), "bins": min(MISSING, int(p.get("max_bin", MISSING)))}
    if name == "XGBoost":
        return Settings(
            rate=float(p.get("learning_rate", 0.3)), max_depth=depth or 6, l2=float(p.get("reg_lambda", 1.0)), min_gain=float(p.get("gamma", 0.0)),
            min_hessian=float(p.get("min_child_weight", 1.0)), max_leaves=int(p.get("max_leaves", 0)) or None, **common,
        )
    if name == "LightGBM":
        return Settings(
            rate=float(p.get("learning_rate", 0.1)), max_depth=depth, max_leaves=int(p.get("num_leaves", 31)), l2=float(p.get("reg_lambda", 0.0)),
            min_gain=float(p.get("min_split_gain", 0.0)), min_rows=int(p.get("min_child_samples", 20)),
            min_hessian=float(p.get("min_child_weight", 1e-3)), **common,
        )
    return Settings(
        rate=float(p.get("learning_rate", 0.1)), max_depth=depth or 3, min_rows=int(p.get("min_samples_leaf", 1)), by_rows=True, **common,
    )


def gradients(loss: str, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, trees x rows."""
    if loss == "squared":
        return margin - y, np.ones_like(margin)
    p = probabilities(loss, margin)
    if loss == "logistic":
        p = p[1:]
        return p - y, p * (1 - p)
    k = len(margin)
    return p - (np.arange(k)[:, None] == y), k / (k - 1) * p * (1 - p)


def probabilities(loss: str, margin: np.ndarray) -> np.ndarray:
    """Classes x rows."""
    if loss == "logistic":
        p = 1 / (1 + np.exp(-np.clip(margin[0], -500, 500)))
        return np.stack([1 - p, p])
    e = np.exp(margin - margin.max(axis=0))
    return e / e.sum(axis=0)


def start_margins(loss: str, counts: np.ndarray, total: float) -> np.ndarray:
    """Margins before the first tree: the mean, or the logarithms of the shares of classes."""
    n = max(counts.sum(), 1e-300)
    if loss == "squared":
        return np.array([total / n])
    share = np.clip(counts / n, 1e-12, None)
    return np.array([np.log(share[1] / share[0])]) if loss == "logistic" else np.log(share)


def _score(g: np.ndarray, d: np.ndarray, s: Settings) -> np.ndarray:
    t = np.sign(g) * np.maximum(np.abs(g) - s.l1, 0.0)
    return np.divide(t * t, d + s.l2, out=np.zeros_like(t), where=d + s.l2 > 0)


def all_splits(sums: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """``(gain, left sums)`` of every split: 2 x features x bins, missing values right (0) or left (1); -inf where not allowed."""
    seen = np.cumsum(sums[:, :MISSING], axis=1)
    left = np.stack([seen, seen + sums[:, MISSING:]])
    total = left[1, :, -1:]
    right = total - left
    d = 2 if s.by_rows else 1
    gain = 0.5 * (_score(left[..., 0], left[..., d], s) + _score(right[..., 0], right[..., d], s) - _score(total[..., 0], total[..., d], s)) - s.min_gain
    least = max(s.min_rows, 1) - 0.5
    fine = (left[..., 2] > least) & (right[..., 2] > least) & (left[..., 1] >= s.min_hessian) & (right[..., 1] >= s.min_hessian)
    return np.where(fine, gain, -np.inf), left


@dataclass(eq=False)
class Node:
    """A node while its tree grows: sums (gradient, hessian, rows), its best split, its children if they were asked for."""

    depth: int
    total: np.ndarray
    sums: np.ndarray | None = None
    gain: float = -np.inf
    feature: int = -1
    bin: int = -1
    missing_left: bool = False
    parts: tuple[np.ndarray, np.ndarray] | None = None
    children: tuple[Node, Node] | None = None

    def find_split(self, s: Settings) -> None:
        gain, left = all_splits(self.sums, s)
        # Sums of floats in any order: gains within a hair of the best count as equal, the first of them wins.
        best = gain.max(initial=-np.inf)
        if not np.isfinite(best) or best <= 1e-12 * max(1.0, abs(self.total[0])):
            self.sums = None
            return
        side, f, b = (int(x[0]) for x in np.nonzero(gain >= best - 1e-9 * abs(best)))
        part = left[side, f, b]
        self.gain, self.feature, self.bin, self.parts = float(best), f, b, (part, self.total - part)
        gaps = self.sums[f, MISSING, 2] > 0.5
        self.missing_left = bool(side) if gaps else bool(part[2] >= self.total[2] - part[2])


def _open(node: Node, s: Settings) -> bool:
    """Whether a node may be split, so that its sums are wanted."""
    return (s.max_depth is None or node.depth < s.max_depth) and node.total[2] >= 2 * max(1, s.min_rows)


def _choose(root: Node, s: Settings) -> tuple[set[int], list[Node]]:
    """``(split nodes by id, leaves whose children must be known first)``: best gain first, up to the limit of leaves."""
    taken, heap, order = set(), [], 0
    if root.feature >= 0:
        heap.append((-root.gain, order, root))
    leaves = 1
    while heap and (s.max_leaves is None or leaves < s.max_leaves):
        _, _, node = heapq.heappop(heap)
        if node.children is None:
            # Whatever stands in the heap may be next: ask for all of it at once.
            return taken, [node, *[n for _, _, n in heap if n.children is None]]
        taken.add(id(node))
        leaves += 1
        for child in node.children:
            if child.feature >= 0:
                order += 1
                heapq.heappush(heap, (-child.gain, order, child))
    return taken, []


def _as_tree(root: Node, edges, s: Settings, split: set[int] | None) -> tuple[Tree, dict[int, int]]:
    """The tree of the nodes that are split (all that have children, if not given), and the place of each node."""
    rows, place = [], {}

    def add(node: Node) -> int:
        at = place[id(node)] = len(rows)
        rows.append(None)
        inner = node.children is not None and (split is None or id(node) in split)
        step = -float(np.sign(node.total[0]) * max(abs(node.total[0]) - s.l1, 0.0) / max(node.total[1] + s.l2, 1e-12)) * s.rate
        if inner:
            a, b = (add(c) for c in node.children)
            e = edges[node.feature]
            cut = float(e[node.bin]) if node.bin < len(e) else np.inf  # all but the missing ones go left
            rows[at] = (node.feature, node.bin, cut, node.missing_left, a, b, step, node.gain)
        else:
            rows[at] = (-1, 0, 0.0, False, 0, 0, step, 0.0)
        return at

    add(root)
    kinds = (np.int64, np.int64, float, bool, np.int64, np.int64, float, float)
    return Tree(*(np.array(c, k) for c, k in zip(zip(*rows), kinds))), place


def _margins(start: np.ndarray, rounds: Iterable[tuple[Tree, ...]], bins: np.ndarray, state: bytes) -> np.ndarray:
    """Margins of the rows of a block, trees x rows: what is written, and the rounds since."""
    n = bins.shape[1]
    out = np.frombuffer(state).reshape(len(start), n).copy() if state else np.repeat(start[:, None], n, axis=1)
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[k] += tree.value[tree.leaves_of_bins(bins)]
    return out


def _ask(table: DataFrame, width: int, loss: str, start, since, asked: list[tuple[int, Tree, list[int]]]) -> dict[int, np.ndarray]:
    """Sums (features x bins x 3) by number, counted through ``asked``: class, tree so far, wanted nodes of it."""
    numbered, first = [], 0
    for k, tree, nodes in asked:
        slot = np.full(len(tree.feature), -1)
        slot[nodes] = np.arange(len(nodes))
        numbered.append((k, tree, slot, len(nodes), first))
        first += len(nodes)

    def work(batches):
        into = [np.zeros((n, width, BINS, 3)) for _, _, _, n, _ in numbered]
        for bins, y, state in B.block_rows(batches, width):
            g, h = gradients(loss, _margins(start, since, bins, state), y)
            for (k, tree, slot, n, _), sums in zip(numbered, into):
                B.node_sums(bins, slot[tree.leaves_of_bins(bins)], n, (g[k], h[k], None), sums)
        return {f + i: sums[i] for (_, _, _, n, f), sums in zip(numbered, into) for i in range(n)}

    empty = np.zeros(width * BINS * 3)
    found = B.add_up(table, work)
    return {i: found.get(i, empty).reshape(width, BINS, 3) for i in range(first)}


def _ask_in_turns(table, width, loss, start, since, asked):
    """:func:`_ask`, in as many passes as the room for sums in a task needs; one list of sums per entry of ``asked``."""
    most = max(1, B.ROOM // (width * BINS * 3 * 8))
    pieces = [(i, tree_at, nodes[a : a + most]) for i, (_, tree_at, nodes) in enumerate(asked) for a in range(0, len(nodes), most)]
    out: list[list[np.ndarray]] = [[] for _ in asked]
    while pieces:
        taken, room = [], most
        while pieces and (not taken or len(pieces[0][2]) <= room):
            taken.append(pieces.pop(0))
            room -= len(taken[-1][2])
        found = _ask(table, width, loss, start, since, [(asked[i][0], tree, nodes) for i, tree, nodes in taken])
        at = 0
        for i, _, nodes in taken:
            out[i] += [found[at + j] for j in range(len(nodes))]
            at += len(nodes)
    return out


def grow_round(table: DataFrame, edges, loss: str, start: np.ndarray, since: list, s: Settings) -> tuple[Tree, ...]:
    """One tree per class from the gradients at the margins so far."""
    width = len(edges)
    stump = _as_tree(Node(0, np.zeros(3)), edges, s, None)[0]
    first = _ask_in_turns(table, width, loss, start, since, [(k, stump, [0]) for k in range(len(start))])
    roots = []
    for (sums,) in first:
        root = Node(0, sums[0].sum(axis=0), sums)
        root.find_split(s)
        roots.append(root)
    while True:
        asked, pairs = [], []
        for k, root in enumerate(roots):
            wanted = _choose(root, s)[1]
            if not wanted:
                continue
            for node in wanted:
                node.children = tuple(Node(node.depth + 1, part) for part in node.parts)
            tree, place = _as_tree(root, edges, s, None)
            # Of two children the one with fewer rows is asked for, where either may be split.
            small = [min(n.children, key=lambda c: c.total[2]) for n in wanted if any(_open(c, s) for c in n.children)]
            parents = [n for n in wanted if any(_open(c, s) for c in n.children)]
            if small:
                asked.append((k, tree, [place[id(c)] for c in small]))
                pairs.append(list(zip(parents, small)))
            for n in wanted:
                if n not in parents:
                    n.sums = None
        if not asked:
            if any(_choose(root, s)[1] for root in roots):
                continue
            break
        for found, mine in zip(_ask_in_turns(table, width, loss, start, since, asked), pairs):
            for sums, (parent, child) in zip(found, mine):
                for c in parent.children:
                    c.sums = sums if c is child else parent.sums - sums
                    if _open(c, s):
                        c.find_split(s)
                    else:
                        c.sums = None
                parent.sums = None
    return tuple(_as_tree(root, edges, s, _choose(root, s)[0])[0] for root in roots)


@dataclass(frozen=True)
class BoostedTrees:
    """Rounds of trees, one per class (one in all for two classes and for numbers)."""

    loss: str
    start: tuple[float, ...]
    rounds: tuple[tuple[Tree, ...], ...]
    width: int
    kind: str = field(default="histogram trees", init=False)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 (the name that Spark's trees use)
        """Share of each feature in the gains of all splits."""
        total = np.zeros(self.width)
        for tree in (t for trees in self.rounds for t in trees):
            inner = tree.feature >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
        return DenseVector(total / total.sum() if total.sum() else total)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Trees x rows."""
        out = np.repeat(np.array(self.start)[:, None], len(x), axis=1)
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[k] += tree.value[tree.leaves(x)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, and ``probability`` where the label is a class; Arrow batches, no shuffle."""

        @F.arrow_udf("array<double>")
        def scored(column: pa.Array) -> pa.Array:
            there = column.is_valid().to_numpy(zero_copy_only=False)
            x = B.matrix(column.drop_null(), self.width)
            found = np.zeros((0, 1)) if not len(x) else self.margins(x).T if self.loss == "squared" else probabilities(self.loss, self.margins(x)).T
            values = iter(found.tolist())
            return pa.array([next(values) if t else None for t in there], pa.list_(pa.float64()))

        held = F.col("features").isNotNull()
        out = df.withColumn("_scored", scored(F.when(held, vector_to_array("features"))))
        if self.loss == "squared":
            return out.withColumn("prediction", F.col("_scored")[0]).drop("_scored")
        best = (F.array_position("_scored", F.array_max("_scored")) - 1).cast("double")
        return out.withColumn("probability", F.when(held, array_to_vector("_scored"))).withColumn("prediction", best).drop("_scored")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [
            (r, k, i, int(t.feature[i]), float(t.threshold[i]), bool(t.missing_left[i]), int(t.left[i]), int(t.right[i]), float(t.value[i]), float(t.gain[i]))
            for r, trees in enumerate(self.rounds) for k, t in enumerate(trees) for i in range(len(t.feature))
        ]
        spark.createDataFrame(rows, NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        head = [(self.loss, [float(v) for v in self.start], len(self.rounds), self.width)]
        spark.createDataFrame(head, HEAD).coalesce(1).write.mode("overwrite").parquet(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedTrees:
        head = spark.read.schema(HEAD).parquet(f"{path}/head").first()
        grown: dict[tuple[int, int], list] = {}
        for row in spark.read.schema(NODES).parquet(f"{path}/nodes").orderBy("round", "class", "node").collect():
            grown.setdefault((row[0], row[1]), []).append(row[3:])
        kinds = (np.int64, float, bool, np.int64, np.int64, float, float)
        trees = {}
        for at, rows in grown.items():
            f, cut, side, a, b, value, gain = (np.array(c, k) for c, k in zip(zip(*rows), kinds))
            trees[at] = Tree(f, np.zeros(len(f), np.int64), cut, side, a, b, value, gain)
        rounds = tuple(tuple(trees[r, k] for k in range(len(head["start"]))) for r in range(head["rounds"]))
        return cls(head["loss"], tuple(head["start"]), rounds, head["width"])


NODES = (
    "round int, class int, node int, feature int, threshold double, missing_left boolean, left int, right int, value double, gain double"
)
HEAD = "loss string, start array<double>, rounds int, width int"


def _loss(classes: int) -> str:
    return "squared" if not classes else "logistic" if classes <= 2 else "softmax"


def _begin(df: DataFrame, classes: int, s: Settings):
    """Blocks, edges, loss and first margins of ``df(features, label)``."""
    loss = _loss(classes)
    rows = B.rows_for_trees(df)
    first = rows.first()
    width = len(first["x"]) if first else 0
    n, total = rows.agg(F.count("*"), F.sum("y")).first()
    counts = np.array([float(n)])
    if classes:
        found = dict(rows.groupBy(F.col("y").cast("int")).count().collect())  # one row per class
        counts = np.array([float(found.get(c, 0)) for c in range(max(2, classes))])
    edges = B.edges_of(rows, width, s.bins) if n else [np.zeros(0)] * width
    return rows, edges, loss, start_margins(loss, counts, total or 0.0)


def fit(df: DataFrame, classes: int, s: Settings) -> BoostedTrees:
    """Boosted trees on ``features`` and ``label``; ``classes`` 0 means that the label is a number."""
    rows, edges, loss, start = _begin(df, classes, s)
    table = cut_lineage(B.blocks(rows, edges))
    grown: list[tuple[Tree, ...]] = []
    written = 0
    for turn in range(s.rounds if edges else 0):
        if turn - written == ROUNDS_APART:
            table = cut_lineage(_with_margins(table, len(edges), start, grown[written:]), replaces=table)
            written = turn
        trees = grow_round(table, edges, loss, start, grown[written:], s)
        if all(len(t.feature) == 1 for t in trees):
            break  # no split is left that gains anything
        grown.append(trees)
    return BoostedTrees(loss, tuple(float(v) for v in start), tuple(grown), len(edges))


def _with_margins(table: DataFrame, width: int, start: np.ndarray, since: list) -> DataFrame:
    def run(batches):
        for batch in batches:
            states = [_margins(start, since, bins, state).tobytes() for bins, _, state in B.block_rows([batch], width)]
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(states, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["n", "bins", "y", "state"])

    return table.mapInArrow(run, B.BLOCK)


def first_gains(df: DataFrame, classes: int, s: Settings) -> DataFrame:
    """``class, feature, threshold, missing_left, gain`` of every allowed split of the first node of each class."""
    rows, edges, loss, start = _begin(df, classes, s)
    stump = _as_tree(Node(0, np.zeros(3)), edges, s, None)[0]
    found = _ask_in_turns(B.blocks(rows, edges), len(edges), loss, start, [], [(k, stump, [0]) for k in range(len(start))])
    out = []
    for k, (sums,) in enumerate(found):
        gain, _ = all_splits(sums, s)
        for side, f, b in zip(*np.nonzero(np.isfinite(gain))):
            if b < len(edges[f]):
                out.append((k, int(f), float(edges[f][b]), bool(side), float(gain[side, f, b])))
    return df.sparkSession.createDataFrame(out, "class int, feature int, threshold double, missing_left boolean, gain double")
