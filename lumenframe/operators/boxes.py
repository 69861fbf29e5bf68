"""Boxes around rows: units of about equally many rows, cut from a sample, with bounds for every query of its own.

Rows with the same features present form a pattern. Each frequent pattern gets a tree of medians from a bounded sample; the other rows
share one. A leaf is a unit, and its box is measured on all its rows, not on the sample. For a query the nearest possible row of a unit
follows from the box on the features that both have, also where distances skip missing features and are scaled up for them.
Boxes are compared in two steps: first those around groups of units, then the units of the groups that are near enough.

A unit and the rows that ask for it meet in blocks of bounded size, so a crowded unit is many tasks on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.session import cut_lineage

#: Rows of a unit that is aimed at, and numbers in all boxes.
UNIT_ROWS = 1_000
NUMBERS = 1_000_000
#: Sampled rows per unit, and patterns that get a tree of their own.
DRAWN = 4
PATTERNS = 64
_TILE = 4_000_000
#: Units whose bounds one task merges.
MERGED = 2_000
#: Rows of a block where all pairs within reach come out.
PAIR_ROWS = 1_000
#: Share of rows with features of their own up to which equal rows are merged, and their keys in one row.
APART = 0.5
PLACE_KEYS = 500


def patterns_of(x: np.ndarray) -> np.ndarray:
    """One number per row: the same for rows with the same features present."""
    there = ~np.isnan(x)
    bits = np.packbits(there, axis=1)
    out = np.zeros(len(x), np.uint64)
    for column in bits.T:
        out = (out ^ column) * np.uint64(0x100000001B3) + np.uint64(1)
    return out


@dataclass(frozen=True)
class MedianTree:
    """Inner nodes as arrays; ``left`` and ``right`` are nodes, or units as ``-1 - unit``. Missing values go left."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    root: int

    def units(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root)
        while True:
            rows = np.flatnonzero(at >= 0)
            if not len(rows):
                return -1 - at
            node = at[rows]
            side = x[rows, self.feature[node]] > self.threshold[node]
            at[rows] = np.where(side, self.right[node], self.left[node])


def _median_tree(x: np.ndarray, rows_per_unit: int, first_unit: int) -> tuple[MedianTree, int]:
    """A tree over sampled rows, and the number of its units. Each node cuts its widest feature at the median."""
    nodes, units = [], [0]

    def grow(rows: np.ndarray) -> int:
        mine = x[rows]
        wide = np.zeros(x.shape[1])
        if len(rows) > rows_per_unit:
            there = ~np.isnan(mine)
            full = np.where(there.any(axis=0), there.sum(axis=0), 0) == len(rows)
            wide[full] = mine[:, full].max(axis=0) - mine[:, full].min(axis=0)
        f = int(wide.argmax()) if len(wide) else 0
        if not len(wide) or wide[f] <= 0:
            units[0] += 1
            return -1 - (first_unit + units[0] - 1)
        middle = float(np.median(mine[:, f]))
        if middle >= mine[:, f].max():  # more than half share the largest value
            middle = float(mine[mine[:, f] < middle, f].max())
        at = len(nodes)
        nodes.append(None)
        side = mine[:, f] > middle
        nodes[at] = (f, middle, grow(rows[~side]), grow(rows[side]))
        return at

    root = grow(np.arange(len(x)))
    kinds = (np.int64, float, np.int64, np.int64)
    columns = [np.array(c, k) for c, k in zip(zip(*nodes), kinds)] if nodes else [np.zeros(0, k) for k in kinds]
    return MedianTree(*columns, root), units[0]


@dataclass(frozen=True)
class Units:
    """Trees by pattern (the last one for all other rows), and the first unit of each."""

    patterns: np.ndarray
    trees: tuple[MedianTree, ...]
    count: int

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """The unit of each row."""
        out = np.zeros(len(x), np.int64)
        mine = patterns_of(x)
        place = np.searchsorted(self.patterns, mine)
        place[place >= len(self.patterns)] = len(self.patterns)
        known = place < len(self.patterns)
        known[known] = self.patterns[place[known]] == mine[known]
        place[~known] = len(self.patterns)
        for t in np.unique(place):
            rows = np.flatnonzero(place == t)
            out[rows] = self.trees[t].units(x[rows])
        return out


def plan_units(sample: np.ndarray, rows: int, unit_rows: int = UNIT_ROWS) -> Units:
    """Units for a table of ``rows`` rows, from a sample of it."""
    width = max(1, sample.shape[1])
    wanted = int(np.clip(-(-rows // unit_rows), 1, max(1, NUMBERS // width)))
    per_unit = max(1, -(-len(sample) // wanted))
    mine = patterns_of(sample)
    names, counts = np.unique(mine, return_counts=True)
    often = np.sort(names[np.argsort(-counts, kind="stable")[:PATTERNS]])
    often = often[counts[np.searchsorted(names, often)] >= per_unit]
    trees, count = [], 0
    for name in often:
        tree, n = _median_tree(sample[mine == name], per_unit, count)
        trees.append(tree)
        count += n
    # Rows of other patterns are few in the sample: a feature they all have cuts them, or they are one unit.
    tree, n = _median_tree(sample[~np.isin(mine, often)], per_unit, count)
    return Units(often, (*trees, tree), count + n)


@dataclass(frozen=True)
class Boxes:
    """Per unit: rows, smallest and largest value per feature, whether all rows and whether any row has the feature."""

    rows: np.ndarray
    low: np.ndarray
    high: np.ndarray
    always: np.ndarray
    ever: np.ndarray

    def around(self, groups: list[np.ndarray]) -> Boxes:
        """Boxes around groups of units."""
        return Boxes(
            np.array([self.rows[g].sum() for g in groups]), np.array([self.low[g].min(axis=0) for g in groups]), np.array([self.high[g].max(axis=0) for g in groups]),
            np.array([self.always[g].all(axis=0) for g in groups]), np.array([self.ever[g].any(axis=0) for g in groups]),
        )

    def nearest_possible(self, x: np.ndarray, units: np.ndarray, gaps: bool) -> np.ndarray:
        """A lower bound of the distance of row i of ``x`` to every row of unit ``units[i]``; infinite where there is none.

        With ``gaps``, distances are means over the common features, scaled to all of them. Features that all rows of the unit have are
        in every such mean; any of the others may be, so the bound is the least of their own and the mean of the sure ones.
        """
        width = x.shape[1]
        out = np.empty(len(x))
        step = max(1, _TILE // max(1, width))
        for a in range(0, len(x), step):
            mine, u = x[a : a + step], units[a : a + step]
            off = np.maximum(np.maximum(self.low[u] - mine, mine - self.high[u]), 0.0)
            power = off * off
            if not gaps:
                total = power.sum(axis=1)
                out[a : a + step] = np.where(np.isnan(total) | (self.rows[u] == 0), np.inf, np.sqrt(total))
                continue
            there = ~np.isnan(mine)
            sure, some = there & self.always[u], there & self.ever[u] & ~self.always[u]
            n = sure.sum(axis=1)
            mean = np.divide(np.where(sure, power, 0).sum(axis=1), n, out=np.full(len(mine), np.inf), where=n > 0)
            least = np.where(some, power, np.inf).min(axis=1, initial=np.inf)
            out[a : a + step] = np.sqrt(width * np.minimum(mean, least))
        return out


def measure(units: DataFrame, count: int, width: int) -> Boxes:
    """Boxes of ``units(unit, x)``: one row per task and unit is merged, one per unit comes to the driver."""

    def merge(rows: list[tuple]) -> tuple:
        low = np.min([np.frombuffer(r[1]) for r in rows], axis=0)
        high = np.max([np.frombuffer(r[2]) for r in rows], axis=0)
        return sum(r[0] for r in rows), low.tobytes(), high.tobytes(), np.sum([np.frombuffer(r[3], np.int64) for r in rows], axis=0).tobytes()

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}
        for b in batches:
            if not len(b):
                continue
            x = np.array(b["x"].tolist(), float).reshape(len(b), -1)
            unit = b["unit"].to_numpy()
            order = np.argsort(unit, kind="stable")
            first = np.flatnonzero(np.diff(unit[order], prepend=-1))
            x, there = x[order], ~np.isnan(x[order])
            low = np.minimum.reduceat(np.where(there, x, np.inf), first, axis=0)
            high = np.maximum.reduceat(np.where(there, x, -np.inf), first, axis=0)
            seen = np.add.reduceat(there.astype(np.int64), first, axis=0)
            for i, u in enumerate(unit[order][first]):
                n = int((first[i + 1] if i + 1 < len(first) else len(unit)) - first[i])
                row = (n, low[i].tobytes(), high[i].tobytes(), seen[i].tobytes())
                held[u] = merge([held[u], row]) if u in held else row
        if held:
            yield pd.DataFrame([(u, *r) for u, r in held.items()], columns=["unit", "n", "low", "high", "seen"])

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple] = {}
        for b in batches:
            for u, *row in b.itertuples(index=False, name=None):
                held[u] = merge([held[u], row]) if u in held else tuple(row)
        if held:
            yield pd.DataFrame([(u, *r) for u, r in held.items()], columns=["unit", "n", "low", "high", "seen"])

    schema = "unit long, n long, low binary, high binary, seen binary"
    # The rows of a unit meet in one task, and a task merges many units: their bytes are few, a group of its own for each would cost more.
    merged = units.select("unit", "x").mapInPandas(parts, schema).repartition(-(-count // MERGED), "unit")
    found = merged.mapInPandas(whole, schema).collect()
    rows, low, high = np.zeros(count, np.int64), np.full((count, width), np.inf), np.full((count, width), -np.inf)
    seen = np.zeros((count, width), np.int64)
    for r in found:
        rows[r["unit"]], low[r["unit"]], high[r["unit"]] = r["n"], np.frombuffer(r["low"]), np.frombuffer(r["high"])
        seen[r["unit"]] = np.frombuffer(r["seen"], np.int64)
    return Boxes(rows, low, high, (seen == rows[:, None]) & (rows[:, None] > 0), seen > 0)


class Search:
    """Units within a distance of each query, by groups of neighbouring units first."""

    def __init__(self, boxes: Boxes, gaps: bool):
        self.boxes, self.gaps = boxes, gaps
        # Units are numbered along their trees, so neighbours in number lie close together.
        step = max(1, int(np.sqrt(len(boxes.rows))))
        self.groups = [np.arange(a, min(a + step, len(boxes.rows))) for a in range(0, len(boxes.rows), step)]
        self.outer = boxes.around(self.groups)

    def within(self, x: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(rows of x, units)`` whose boxes may hold a row within ``reach``, a tile of queries at a time."""
        n = len(self.groups)
        step = max(1, _TILE // max(1, n * x.shape[1]))
        limit = reach * (1 + 1e-9) + 1e-9
        for a in range(0, len(x), step):
            rows = np.arange(a, min(a + step, len(x)))
            q, g = np.repeat(rows, n), np.tile(np.arange(n), len(rows))
            near = self.outer.nearest_possible(x[q], g, self.gaps) <= limit[q]
            q, g = q[near], g[near]
            sizes = np.array([len(self.groups[i]) for i in g], np.int64) if len(g) else np.zeros(0, np.int64)
            inner = max(1, _TILE // max(1, x.shape[1]))
            ends = np.cumsum(sizes)
            lo = 0
            while lo < len(g):  # pairs in tiles, whatever the number of near groups
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + inner, side="right")))
                rows_of, units = np.repeat(q[lo:hi], sizes[lo:hi]), np.concatenate([self.groups[i] for i in g[lo:hi]])
                near = (self.boxes.rows[units] > 0) & (self.boxes.nearest_possible(x[rows_of], units, self.gaps) <= limit[rows_of])
                yield rows_of[near], units[near]
                lo = hi


def sampled(rows: DataFrame, n: int, of: int = 0) -> np.ndarray:
    """``x`` of at most ``n`` rows, drawn by a digest of their key; bounded by the numbers that all boxes may have.

    With ``of``, the number of rows, only digests low enough for about twice ``n`` rows are sorted.
    """
    digest = F.md5(F.col("key").cast("string"))
    low = rows.where(digest < F.lit(f"{int(2 * n / of * 2**32):08x}")) if of > 4 * n else rows
    drawn = low.orderBy(digest).limit(n).select("x").toPandas()
    if low is not rows and len(drawn) < n:  # few keys have such digests, as where keys repeat
        return sampled(rows, n)
    return np.array(drawn["x"].tolist(), float).reshape(len(drawn), -1)


def parts(rows: DataFrame, size: int) -> dict[int, int]:
    """In how many blocks of about ``size`` rows each unit of ``rows`` is cut; one row per unit comes to the driver."""
    return {r[0]: -(-r[1] // size) for r in rows.groupBy("unit").count().collect()}


def _as_table(spark, cuts: dict[int, int], names: str) -> DataFrame:
    """A row per unit: their number is bounded where units are planned."""
    return F.broadcast(spark.createDataFrame([(int(u), int(n)) for u, n in cuts.items()], names))


def spread(q: DataFrame, d: DataFrame, q_parts: dict[int, int], d_parts: dict[int, int], first_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``unit, qb, db``: every block of rows that ask for a unit meets every block of its own rows (or the first one)."""
    spark = q.sparkSession
    hashed = F.xxhash64("key")
    many = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    met = d_parts if not first_only else dict.fromkeys(d_parts, 1)
    left = q.join(_as_table(spark, q_parts, "unit long, nq long"), "unit").withColumn("qb", F.pmod(hashed, F.col("nq")))
    left = left.join(_as_table(spark, met, "unit long, nd long"), "unit").withColumn("db", many("nd")).drop("nq", "nd")
    right = d.join(_as_table(spark, d_parts, "unit long, nd long"), "unit").withColumn("db", F.pmod(hashed, F.col("nd")))
    if first_only:
        right = right.where("db = 0")
    right = right.join(_as_table(spark, q_parts, "unit long, nq long"), "unit").withColumn("qb", many("nq")).drop("nq", "nd")
    return left, right


def as_matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), dtype=float).reshape(len(col), -1)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, feature by feature."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j : j + 1] - b[None, :, j]
        total += gap * gap
    return total


def places(points: DataFrame, most: int = PLACE_KEYS) -> DataFrame:
    """``key, x, keys``: rows of equal features stand together under a number of their own, at most about ``most`` keys in one row."""
    crowds = points.groupBy("x").agg((F.floor((F.count("*") - 1) / most) + 1).alias("parts")).where("parts > 1")
    salted = points.join(crowds, "x", "left").withColumn("part", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))))
    held = salted.groupBy("x", "part").agg(F.collect_list("key").alias("keys"))
    return cut_lineage(held.select(F.monotonically_increasing_id().alias("key"), "x", "keys"))


def repeated(points: DataFrame) -> bool:
    """Whether merging rows of equal features leaves at most ``APART`` of them."""
    n, places_ = points.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("x"))).first()
    return places_ <= APART * n


def range_pairs(points: DataFrame, width: int, reach: float, limit: float, power: Callable = squares, both: bool = False,
                block: int = PAIR_ROWS) -> DataFrame:
    """``left, right, square`` for rows of ``points(key, x)`` with ``power(x of left, x of right) <= limit``.

    Such rows are no farther apart than ``reach``, which boxes tell. Smaller keys stand left; with ``both``, every pair comes in both orders and
    every row with itself. Features have no gaps.
    """
    spark = points.sparkSession
    kind = points.schema["key"].dataType.simpleString()
    schema = f"left {kind}, right {kind}, square double"
    n = points.count()
    if not n or not width:
        return spark.createDataFrame([], schema)
    size = max(1, min(block // 4, UNIT_ROWS))
    wanted = int(np.clip(-(-n // size), 1, max(1, NUMBERS // width)))
    units = plan_units(sampled(points, DRAWN * wanted, n), n, size)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(unit=units.of_rows(as_matrix(b["x"])))

    placed = cut_lineage(points.select("key", "x").mapInPandas(place, f"key {kind}, x array<double>, unit long"))
    found = measure(placed, units.count, width)
    search = Search(found, False)

    def wants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                for rows, unit in search.within(as_matrix(b["x"]), np.full(len(b), reach)):
                    yield b.iloc[rows].assign(unit=unit)

    asked = placed.select("key", "x").mapInPandas(wants, f"key {kind}, x array<double>, unit long")
    left, right = spread(asked, placed, parts(asked, block), {u: int(-(-c // block)) for u, c in enumerate(found.rows) if c})

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"left": [], "right": [], "square": []})
        keys_a, keys_b = a["key"].to_numpy(), b["key"].to_numpy()
        square = power(as_matrix(a["x"]), as_matrix(b["x"]))
        i, j = np.nonzero((square <= limit) & (True if both else keys_a[:, None] < keys_b[None, :]))
        return pd.DataFrame({"left": keys_a[i], "right": keys_b[j], "square": square[i, j]})

    on: Sequence[str] = ["unit", "qb", "db"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(meet, schema)
