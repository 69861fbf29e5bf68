"""Support vector machines with a Gaussian kernel, for classes and for numbers, at linear cost in the rows.

The kernel is replaced by Nystroem features (Williams and Seeger, 2001): the kernel values to a bounded set of landmark rows, whitened by
their own kernel matrix. With as many landmarks as different rows this is the exact kernel. The machine minimises
``|w|^2 / 2 + C * sum(loss)`` with the hinge loss, or the epsilon-insensitive loss for numbers. The kinks of both are rounded over
a width that shrinks in steps; at each width Newton's method runs on sums of loss, gradient and curvature that tasks add up, so a pass
sends one matrix of landmarks x landmarks per class and task. More than two classes are separated one against the rest.
Large tables walk the widths on drawn rows: the loss is convex, so this only chooses where the steps over all rows begin.

Probabilities come from a logistic curve over the decision values of the training rows (Platt, 1999, with his corrected targets), scaled to
sum to 1 over the classes.

Defined cases: rows with a missing feature or without a label take no part; a row without features or with a missing one has no
prediction; with one class the other has probability 0 up to the correction; the mean label is predicted where all features are constant.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.models import blocks as B
from lumenframe.session import cut_lineage

LANDMARKS = 200
#: Widths of the rounded kinks, as parts of the scale of the labels, and Newton steps at each.
WIDTHS = (1.0, 0.3, 0.1, 0.03, 0.01, 0.003)
STEPS = 30
#: Lengths that are tried for a step.
REACHES = 2.0 ** np.array([3, 2, 1, 0, -1, -2, -3, -4, -5, -6, -8, -10, -12, -14, -16, -20])
#: Rows whose features are held at a time.
ROWS = 4096
#: Rows on which the widths are walked down first, where there are many more; all rows go on from there at the last width.
START_ROWS = 20_000


@dataclass(frozen=True)
class Settings:
    c: float = 1.0
    epsilon: float = 0.1
    kernel: str = "rbf"
    gamma: float | str = "scale"
    landmarks: int = LANDMARKS
    steps: int = STEPS


def settings(params: dict) -> Settings:
    """Settings by the parameter names that users of support vector machines write."""
    p = {k: v for k, v in params.items() if v is not None}
    kernel = p.get("kernel", "rbf")
    if kernel not in ("rbf", "linear"):
        raise ValueError(f"kernel {kernel}: rbf or linear")
    gamma = p.get("gamma", "scale")
    return Settings(
        float(p.get("C", 1.0)), float(p.get("epsilon", 0.1)), kernel, gamma if gamma in ("scale", "auto") else float(gamma),
        int(p.get("landmarks", LANDMARKS)), int(p.get("max_iter", STEPS)) if int(p.get("max_iter", STEPS)) > 0 else STEPS,
    )


@dataclass(frozen=True)
class FeatureMap:
    """Rows to features whose inner products are (about) the kernel; without landmarks, the rows themselves. The last feature is 1."""

    landmarks: np.ndarray | None
    whiten: np.ndarray | None
    gamma: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.whole(self.raw(x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Kernel values to the landmarks, before they are whitened."""
        return x if self.landmarks is None else gaussian(x, self.landmarks, self.gamma)

    def whole(self, raw: np.ndarray) -> np.ndarray:
        z = raw if self.whiten is None else raw @ self.whiten
        return np.concatenate([z, np.ones((len(raw), 1))], axis=1)

    def decide(self, raw: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Rows x machines; a product with the whitened weights spares whitening the rows."""
        mixed = weights[:, :-1].T if self.whiten is None else self.whiten @ weights[:, :-1].T
        return raw @ mixed + weights[:, -1]

    def total(self, slope: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """``slope @ features``."""
        mixed = slope @ raw
        return np.append(mixed if self.whiten is None else mixed @ self.whiten, slope.sum())


def gaussian(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    power = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
    np.maximum(power, 0.0, out=power)
    power *= -gamma
    return np.exp(power, out=power)


def feature_map(sample: np.ndarray, gamma: float) -> FeatureMap:
    """Nystroem features from landmark rows; directions that the landmarks hardly span are left out."""
    marks = np.unique(sample, axis=0)
    values, vectors = np.linalg.eigh(gaussian(marks, marks, gamma))
    fine = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
    return FeatureMap(marks, vectors[:, fine] / np.sqrt(values[fine]), gamma)


def rounded_loss(t: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``max(0, t)`` with its kink rounded over ``width``: value, slope, curvature."""
    inside = (t > 0) & (t < width)
    value = np.where(t >= width, t - width / 2, np.where(inside, t * t / (2 * width), 0.0))
    return value, np.clip(t / width, 0.0, 1.0), np.where(inside, 1 / width, 0.0)


def losses(f: np.ndarray, y: np.ndarray, classes: int, k: int, epsilon: float, width: float):
    """Loss of decision values ``f`` of machine ``k``, with its first and second derivative by ``f``."""
    if classes:
        side = np.where(y == (1 if classes <= 2 else k), 1.0, -1.0)
        value, slope, bend = rounded_loss(1 - side * f, width)
        return value, -side * slope, bend
    miss = f - y
    value, slope, bend = rounded_loss(np.abs(miss) - epsilon, width)
    return value, np.sign(miss) * slope, bend


def _batches(batches, width: int):
    for batch in batches:
        x, y = B.matrix(batch.column(0), width), batch.column(1).to_numpy(zero_copy_only=False)
        for a in range(0, len(y), ROWS):
            yield x[a : a + ROWS], y[a : a + ROWS]


def _newton(table: DataFrame, width: int, map_: FeatureMap, weights: np.ndarray, classes: int, s: Settings, kink: float, least: float,
            rows: float) -> np.ndarray:
    """Weights (machines x features) after Newton steps at one width of the kinks."""
    machines, size = weights.shape
    penalty = np.ones(size)
    penalty[-1] = 0.0  # the constant is free

    def look(w: np.ndarray):
        def work(batches):
            out = {k: np.zeros(1 + size + size * size) for k in range(machines)}
            for x, y in _batches(batches, width):
                raw = map_.raw(x)
                f = map_.decide(raw, w)
                for k in range(machines):
                    value, slope, bend = losses(f[:, k], y, classes, k, s.epsilon, kink)
                    out[k][0] += value.sum()
                    out[k][1 : size + 1] += map_.total(slope, raw)
                    near = bend > 0
                    if near.any():
                        # The curvature is the same wherever there is one.
                        z = map_.whole(raw[near])
                        out[k][size + 1 :] += (z.T @ z).reshape(-1) / kink
            return out

        found = B.add_up(table, work)
        total = np.array([0.5 * (penalty * w[k] ** 2).sum() + s.c * found[k][0] for k in range(machines)])
        return total, found

    def probe(w: np.ndarray, way: np.ndarray) -> np.ndarray:
        """The loss of each machine after each of ``REACHES`` times its way."""

        def work(batches):
            out = {k: np.zeros(len(REACHES)) for k in range(machines)}
            for x, y in _batches(batches, width):
                raw = map_.raw(x)
                f, off = map_.decide(raw, w), map_.decide(raw, way)
                for k in range(machines):
                    out[k] += [losses(f[:, k] + t * off[:, k], y, classes, k, s.epsilon, kink)[0].sum() for t in REACHES]
            return out

        found = B.add_up(table, work)
        return np.array([[0.5 * (penalty * (w[k] + t * way[k]) ** 2).sum() + s.c * found[k][i] for i, t in enumerate(REACHES)] for k in range(machines)])

    best = weights.copy()
    total, found = look(best)
    way = np.zeros_like(weights)
    for _ in range(s.steps):
        live = np.zeros(machines, bool)
        for k in range(machines):
            slope = penalty * best[k] + s.c * found[k][1 : size + 1]
            bend = np.diag(penalty) + s.c * found[k][size + 1 :].reshape(size, size)
            # Where few rows are near a kink nothing holds the constant: some of the curvature it could have keeps its step short.
            bend[-1, -1] += 1e-3 * s.c * rows / kink
            way[k] = -np.linalg.solve(bend + 1e-9 * max(1.0, bend.diagonal().max()) * np.eye(size), slope)
            live[k] = -(slope @ way[k]) > 1e-5 * max(abs(total[k]), least)
        if not live.any():
            break
        # One pass tries many lengths of the step; machines that have ended stay where they are.
        tried = probe(best, way)
        step = np.where(live & (tried.min(axis=1) < total), REACHES[tried.argmin(axis=1)], 0.0)
        if not step.any():
            break
        best = best + step[:, None] * way
        total, found = look(best)
    return best


def _calibrate(table: DataFrame, width: int, map_: FeatureMap, weights: np.ndarray, classes: int) -> np.ndarray:
    """Slope and offset of a logistic curve over each machine's decision values, by Newton's method on task sums."""
    machines = len(weights)
    curve = np.tile([1.0, 0.0], (machines, 1))
    counts = {}
    for turn in range(12):
        def work(batches, curve=curve.copy(), counts=dict(counts)):
            out = {k: np.zeros(8) for k in range(machines)}
            for x, y in _batches(batches, width):
                f = map_.decide(map_.raw(x), weights)
                for k in range(machines):
                    yes = y == (1 if classes <= 2 else k)
                    pos, neg = counts.get(k, (1.0, 1.0))
                    aim = np.where(yes, (pos + 1) / (pos + 2), 1 / (neg + 2))
                    p = 1 / (1 + np.exp(-np.clip(curve[k, 0] * f[:, k] + curve[k, 1], -500, 500)))
                    h, e = np.maximum(p * (1 - p), 1e-12), p - aim
                    v = f[:, k]
                    out[k] += [(e * v).sum(), e.sum(), (h * v * v).sum(), (h * v).sum(), h.sum(), yes.sum(), (~yes).sum(), 0.0]
            return out

        found = B.add_up(table, work)
        if not turn:
            counts = {k: (found[k][5], found[k][6]) for k in range(machines)}
            continue
        change = 0.0
        for k in range(machines):
            g, h = found[k][:2], np.array([[found[k][2], found[k][3]], [found[k][3], found[k][4]]])
            move = np.clip(np.linalg.solve(h + 1e-6 * max(1.0, h.trace()) * np.eye(2), g), -2, 2)
            curve[k] -= move
            change = max(change, abs(move).max())
        if change < 1e-4:
            break
    return curve


@dataclass(frozen=True)
class KernelMachine:
    """Weights per machine over mapped features; ``curve`` turns decision values of classes into probabilities."""

    map: FeatureMap
    weights: np.ndarray
    classes: int
    width: int
    curve: np.ndarray
    kind: str = field(default="kernel machine", init=False)

    def decide(self, x: np.ndarray) -> np.ndarray:
        """Rows x machines."""
        parts = [self.map.decide(self.map.raw(x[a : a + ROWS]), self.weights) for a in range(0, len(x), ROWS)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.weights)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Predicted numbers, or rows x (decision per machine, probability per class)."""
        f = self.decide(x)
        if not self.classes:
            return f
        p = 1 / (1 + np.exp(-np.clip(f * self.curve[:, 0] + self.curve[:, 1], -500, 500)))
        p = np.concatenate([1 - p, p], axis=1) if self.classes <= 2 else p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
        return np.concatenate([f, p], axis=1)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (by decision value), and ``probability`` where the label is a class."""

        @F.arrow_udf("array<double>")
        def scored(column: pa.Array) -> pa.Array:
            there = column.is_valid().to_numpy(zero_copy_only=False)
            x = B.matrix(column.drop_null(), self.width)
            whole = ~np.isnan(x).any(axis=1)
            rows = iter(self.scores(x[whole]).tolist())
            given = iter([next(rows) if w else None for w in whole])
            return pa.array([next(given) if t else None for t in there], pa.list_(pa.float64()))

        out = df.withColumn("_scored", scored(F.when(F.col("features").isNotNull(), vector_to_array("features"))))
        held = F.col("_scored").isNotNull()
        if not self.classes:
            return out.withColumn("prediction", F.col("_scored")[0]).drop("_scored")
        n = len(self.weights)
        f = F.slice("_scored", 1, n)
        chosen = F.when(F.col("_scored")[0] > 0, 1.0).otherwise(0.0) if n == 1 else (F.array_position(f, F.array_max(f)) - 1).cast("double")
        named = F.when(held, array_to_vector(F.slice("_scored", n + 1, max(2, self.classes))))
        return out.withColumn("probability", named).withColumn("prediction", F.when(held, chosen)).drop("_scored")

    def save(self, spark: SparkSession, path: str) -> None:
        arrays = {"weights": self.weights, "curve": self.curve, "landmarks": self.map.landmarks, "whiten": self.map.whiten}
        rows = [(name, list(a.shape), bytearray(np.ascontiguousarray(a, float).tobytes())) for name, a in arrays.items() if a is not None]
        spark.createDataFrame(rows, ARRAYS).coalesce(1).write.mode("overwrite").parquet(f"{path}/arrays")
        spark.createDataFrame([(self.classes, self.width, float(self.map.gamma))], HEAD).coalesce(1).write.mode("overwrite").parquet(f"{path}/head")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KernelMachine:
        head = spark.read.schema(HEAD).parquet(f"{path}/head").first()
        found = {r["name"]: np.frombuffer(r["cells"]).reshape(r["shape"]) for r in spark.read.schema(ARRAYS).parquet(f"{path}/arrays").collect()}
        return cls(FeatureMap(found.get("landmarks"), found.get("whiten"), head["gamma"]), found["weights"], head["classes"], head["width"], found["curve"])


ARRAYS = "name string, shape array<int>, cells binary"
HEAD = "classes int, width int, gamma double"


def _spread(table: DataFrame, width: int) -> tuple[float, float, float, float]:
    """Rows, variance of all cells, mean and variance of the label."""

    def work(batches):
        out = np.zeros(5)
        for x, y in _batches(batches, width):
            out += [len(y), x.sum(), (x * x).sum(), y.sum(), (y * y).sum()]
        return {0: out}

    n, a, b, c, d = B.add_up(table, work).get(0, np.zeros(5))
    cells = max(n * width, 1)
    return n, b / cells - (a / cells) ** 2, c / max(n, 1), d / max(n, 1) - (c / max(n, 1)) ** 2


def _drawn(table: DataFrame, share: float) -> DataFrame:
    """About this share of the rows, by a hash of their place, in few partitions."""
    turn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30))
    return cut_lineage(table.where(turn < int(share * (1 << 30))).coalesce(4))


def fit(df: DataFrame, classes: int, s: Settings) -> KernelMachine:
    """A machine on ``features`` and ``label``; ``classes`` 0 means that the label is a number."""
    rows = B.rows_for_trees(df).where(~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    table = cut_lineage(rows)
    first = table.first()
    width = len(first["x"]) if first else 0
    n, variance, mean, spread = _spread(table, width) if width else (0, 0.0, 0.0, 0.0)
    gamma = s.gamma if not isinstance(s.gamma, str) else 1 / max(1, width) if s.gamma == "auto" or variance <= 0 else 1 / (width * variance)
    if s.kernel == "linear" or not width:
        map_ = FeatureMap(None, None, 0.0)
        size = width + 1
    else:
        # A bounded number of rows: landmarks by a hash of their features, equal rows once.
        drawn = table.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(s.landmarks).collect()
        map_ = feature_map(np.array([r["x"] for r in drawn], float), gamma)
        size = map_.whiten.shape[1] + 1
    machines = classes if classes > 2 else 1
    weights = np.zeros((machines, size))
    curve = np.tile([1.0, 0.0], (machines, 1))
    if width:
        scale = 2.0 if classes else max(np.sqrt(max(spread, 0.0)), 1e-12)
        weights[:, -1] = 0.0 if classes else mean
        widths = WIDTHS
        if n > 2 * START_ROWS:
            drawn = _drawn(table, START_ROWS / n)
            held = drawn.count()
            start = replace(s, c=s.c * n / max(held, 1))
            for part in WIDTHS:
                weights = _newton(drawn, width, map_, weights, classes, start, part * scale, start.c * scale, held)
            widths = WIDTHS[-1:]
        for part in widths:
            weights = _newton(table, width, map_, weights, classes, s, part * scale, s.c * scale, n)
        if classes:
            curve = _calibrate(table, width, map_, weights, classes)
    return KernelMachine(map_, weights, classes, width, curve)


def kernel_error(df: DataFrame, machine: KernelMachine, rows: int = 500) -> float:
    """Mean absolute difference of the mapped inner products to the exact kernel, over pairs of ``rows`` drawn rows."""
    drawn = B.rows_for_trees(df).select("x").orderBy(F.xxhash64("x", F.lit(1))).limit(rows).collect()
    x = np.array([r["x"] for r in drawn], float)
    z = machine.map(x)[:, :-1]
    return float(np.abs(z @ z.T - gaussian(x, x, machine.map.gamma)).mean())
