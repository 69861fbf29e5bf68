"""Exact nearest neighbours between two tables of any size.

When one side is small it is shipped to the tasks that hold the other. When both are large, donors are cut into units of about
equally many rows (:mod:`lumenframe.operators.boxes`). Each query first meets one unit near it, which bounds the distance of its
k-th neighbour; then it meets only the units whose boxes come nearer than that bound of its own. Units and the queries that want
them are cut into blocks of bounded size, so a crowded region becomes many tasks. Every block returns only its ``k`` best
donors per query. Wide rows of which boxes bound hardly any meet all donors block by block (:mod:`lumenframe.operators.tiles`): no row is copied,
and a query's best so far bound the rest. Distances that skip missing features are bounded the same way, by the features that a unit and a query share.

Donors with equal features are equally far from every query, so only those with the smallest keys are compared; queries with equal
features have the same neighbours, so they are searched once. Either is done where it at least halves the rows of its side.

Defined cases: a row whose array of features is null, or of another length than the longest donor's, has no neighbours and is
no neighbour; so is, without ``nan_aware``, a row with a missing feature; equal distances go to the smaller donor key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.stats import number
from lumenframe.operators import boxes as X
from lumenframe.operators import tiles as T
from lumenframe.session import cut_lineage

# Rows and numbers of a side that may be shipped whole, and rows of one block (of one bundle, where most units are wanted).
SHIP_ROWS = 20_000
SHIP_NUMBERS = 4_000_000
BLOCK_ROWS = 5_000
WHOLE = 20_000
_TILE = 4_000_000
#: Distances of rows with few features that are held at a time: they stay in the processor's cache.
_NARROW = 1 << 18
#: Features from which a matrix product finds the candidates, and share of all units from which queries meet all donors (rows of few features: whole bundles of units).
WIDE = 8
MOST_UNITS = 0.25
#: Drawn queries that tell whether boxes bound wide rows.
ASKED = 500

_PAIR = "qk long, dk long, dist double, val double"


def _distances(q: np.ndarray, d: np.ndarray, nan_aware: bool) -> np.ndarray:
    """Euclidean distances, tile by tile."""
    total = np.zeros((len(q), len(d)))
    held = np.zeros_like(total) if nan_aware else None
    for j in range(q.shape[1]):
        gap = q[:, j : j + 1] - d[None, :, j]
        if nan_aware:
            missing = np.isnan(gap)
            if missing.any():
                held += ~missing
                gap[missing] = 0.0
            else:
                held += 1
        gap *= gap
        total += gap
    if nan_aware:
        with np.errstate(divide="ignore", invalid="ignore"):
            total = np.where(held > 0, total * (q.shape[1] / held), np.nan)
    return np.sqrt(total)


def _plain(x: np.ndarray) -> bool:
    """Whether squares of all numbers are finite and far from overflow."""
    return bool(len(x) == 0 or np.abs(x).max() < 1e150)


def _near_squares(q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and per row of ``q`` by how much rounding may have moved them."""
    middle = d.mean(axis=0)
    q, d = q - middle, d - middle
    a, b = (q * q).sum(axis=1), (d * d).sum(axis=1)
    out = q @ d.T
    out *= -2
    out += a[:, None]
    out += b
    return out, 1e-15 * (q.shape[1] + 8) * (a + b.max(initial=0.0))


def _candidates(q: np.ndarray, d: np.ndarray, k: int, reach: np.ndarray | None = None, barred: np.ndarray | None = None):
    """``(rows of q, rows of d, distance)``, by row of ``q``: whatever may be among the ``k`` nearest within ``reach``; distances are exact."""
    square, slack = _near_squares(q, d)
    if barred is not None:
        square[barred] = np.inf
    most = np.full(len(q), np.inf) if reach is None else reach * reach * (1 + 1e-9) + slack
    wide = np.flatnonzero((square <= most[:, None]).sum(axis=1) > 4 * k)
    if len(wide) and k < len(d):
        most[wide] = np.minimum(most[wide], np.partition(square[wide], k - 1, axis=1)[:, k - 1] + 2 * slack[wide])
    i, j = np.nonzero((square <= most[:, None]) & np.isfinite(square))
    dist = np.empty(len(i))
    for a in range(0, len(i), _TILE // max(1, d.shape[1]) + 1):
        part = slice(a, a + _TILE // max(1, d.shape[1]) + 1)
        gap = q[i[part]] - d[j[part]]
        gap *= gap
        total = np.zeros(len(gap))
        for column in gap.T:  # in the order of the features, as tile by tile
            total += column
        dist[part] = np.sqrt(total)
    return i, j, dist


def _best_of_wide(qk, qx, dk, dx, dv, k: int, same: bool, reach: np.ndarray | None) -> pd.DataFrame:
    """As ``_best`` for rows of many features without gaps; donors stand by key."""
    parts = []
    step = max(1, _TILE // max(1, len(dk)))
    for start in range(0, len(qk), step):
        keys = qk[start : start + step]
        barred = keys[:, None] == dk[None, :] if same else None
        i, j, dist = _candidates(qx[start : start + step], dx, k, None if reach is None else reach[start : start + step], barred)
        order = np.lexsort((j, dist, i))
        i, j, dist = i[order], j[order], dist[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, dist = (c[place < k] for c in (i, j, dist))
        parts.append(pd.DataFrame({"qk": keys[i], "dk": dk[j], "dist": dist, "val": dv[j]}))
    return pd.concat(parts) if parts else pd.DataFrame({"qk": [], "dk": [], "dist": [], "val": []})


def _best(qk, qx, dk, dx, dv, k: int, nan_aware: bool, same: bool, reach: np.ndarray | None = None) -> pd.DataFrame:
    """The ``k`` nearest donors of each query (those beyond ``reach`` may be missing); equal distances go to the smaller donor key."""
    order = np.argsort(dk, kind="stable")
    dk, dx, dv = dk[order], dx[order], dv[order]
    if dx.shape[1] >= WIDE and len(dk) and _plain(qx) and _plain(dx):
        return _best_of_wide(qk, qx, dk, dx, dv, k, same, reach)
    parts = []
    step = max(1, _NARROW // max(1, len(dk)))
    for start in range(0, len(qk), step):
        keys = qk[start : start + step]
        dist = _distances(qx[start : start + step], dx, nan_aware)
        if same:
            dist[keys[:, None] == dk[None, :]] = np.inf
        dist[np.isnan(dist)] = np.inf
        most = np.partition(dist, k - 1, axis=1)[:, k - 1 : k] if k < len(dk) else np.inf
        i, j = np.nonzero((dist <= most) & np.isfinite(dist))
        near = dist[i, j]
        order = np.lexsort((j, near, i))
        i, j, near = i[order], j[order], near[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, near = (c[place < k] for c in (i, j, near))
        parts.append(pd.DataFrame({"qk": keys[i], "dk": dk[j], "dist": near, "val": dv[j]}))
    return pd.concat(parts) if parts else pd.DataFrame({"qk": [], "dk": [], "dist": [], "val": []})


def _slim(df: DataFrame, key: str, features: Sequence[str] | str, carry: str | None) -> DataFrame:
    if isinstance(features, str):
        cells = F.transform(F.col(features).cast("array<double>"), lambda v: F.coalesce(v, F.lit(float("nan"))))
    else:
        # NaN marks a missing feature on both sides.
        cells = F.array(*[F.coalesce(number(c), F.lit(float("nan"))) for c in features])
    value = number(carry) if carry else F.lit(0.0)
    return df.select(F.col(key).cast("long").alias("key"), cells.alias("x"), value.cast("double").alias("val"))


def nearest(
    queries: DataFrame,
    donors: DataFrame,
    query_key: str,
    donor_key: str,
    features: Sequence[str] | str,
    k: int,
    *,
    nan_aware: bool = False,
    exclude_same_key: bool = False,
    carry: str | None = None,
    ship_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """``(query_key, donor_key, distance, rank, carried)`` for the ``k`` nearest donors of each query.

    Keys are whole numbers. ``features`` is a list of numeric columns, or one array column.

    With ``nan_aware`` distances skip missing features and are scaled up for them.
    """
    q = _slim(queries, query_key, features, None)
    d = _slim(donors, donor_key, features, carry)
    width = (d.agg(F.max(F.size("x"))).first()[0] or 0) if isinstance(features, str) else len(features)
    if isinstance(features, str):
        q, d = (rows.where(F.size("x") == width) for rows in (q, d))
    limit = ship_rows
    if limit is None:
        limit = min(SHIP_ROWS, SHIP_NUMBERS // max(1, width))
    block = block_rows or BLOCK_ROWS
    # limit + 1 rows are enough to know whether a side is small.
    if q.limit(limit + 1).count() <= limit:
        found = _ship_queries(q, d, k, nan_aware, exclude_same_key)
    elif d.limit(limit + 1).count() <= limit:
        found = _ship_donors(q, d, k, nan_aware, exclude_same_key)
    else:
        if X.repeated(d):
            d = _first_of_place(d, k + 1 if exclude_same_key else k, exclude_same_key)
        # A query that may not meet itself has neighbours of its own.
        members = _places(q) if not exclude_same_key and X.repeated(q) else None
        if members is not None:
            q = members.groupBy("place").agg(F.first("x").alias("x")).select(F.col("place").alias("key"), "x", F.lit(0.0).alias("val"))
        found = _by_units(q, d, k, nan_aware, exclude_same_key, block, width)
        if members is not None:
            found = _first_ranks(found, k).withColumnRenamed("qk", "place").join(members.select("place", F.col("key").alias("qk")), "place").drop("place")
    best = Window.partitionBy("qk").orderBy("dist", "dk")
    return (
        found.withColumn("rank", F.row_number().over(best).cast("long"))
        .where(F.col("rank") <= k)
        .select(
            F.col("qk").alias("query_key"),
            F.col("dk").alias("donor_key"),
            F.col("dist").alias("distance"),
            "rank",
            F.col("val").alias("carried"),
        )
    )


def _first_of_place(d: DataFrame, need: int, same: bool) -> DataFrame:
    """Donors of equal features up to the ``need``-th (with ``same``, those of the first ``need`` keys), by key; tasks drop most before the shuffle."""
    place = Window.partitionBy("x")
    turn = F.dense_rank().over(place.orderBy("key")) if same else F.row_number().over(place.orderBy("key", "val"))
    return cut_lineage(d.withColumn("turn", turn).where(F.col("turn") <= need).drop("turn"))


def _places(q: DataFrame) -> DataFrame:
    """``key, x, place``: queries of equal features share a number."""
    places = cut_lineage(q.select("x").distinct().withColumn("place", F.monotonically_increasing_id()))
    return cut_lineage(q.select("key", "x").join(places, "x").select("key", "x", "place"))


def _first_ranks(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best pairs of each query."""
    best = Window.partitionBy("qk").orderBy("dist", "dk")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def _ship_queries(q: DataFrame, d: DataFrame, k: int, nan_aware: bool, same: bool) -> DataFrame:
    rows = q.toPandas()
    if rows.empty:
        return d.sparkSession.createDataFrame([], _PAIR)
    shipped = d.sparkSession.sparkContext.broadcast((rows["key"].to_numpy(), X.as_matrix(rows["x"])))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, x = shipped.value
        held = None
        for b in batches:
            if not len(b):
                continue
            new = _best(keys, x, b["key"].to_numpy(), X.as_matrix(b["x"]), b["val"].to_numpy(), k, nan_aware, same)
            held = new if held is None else pd.concat([held, new])
            held = held.sort_values(["qk", "dist", "dk"]).groupby("qk").head(k)
        if held is not None:
            yield held

    return d.mapInPandas(near, _PAIR)


def _ship_donors(q: DataFrame, d: DataFrame, k: int, nan_aware: bool, same: bool) -> DataFrame:
    rows = d.toPandas()
    shipped = d.sparkSession.sparkContext.broadcast(
        (rows["key"].to_numpy(), X.as_matrix(rows["x"]) if len(rows) else None, rows["val"].to_numpy())
    )

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, x, val = shipped.value
        for b in batches:
            if len(b) and len(keys):
                yield _best(b["key"].to_numpy(), X.as_matrix(b["x"]), keys, x, val, k, nan_aware, same)

    return q.mapInPandas(near, _PAIR)


def _meet(q: DataFrame, d: DataFrame, on: Sequence[str], k: int, nan_aware: bool, same: bool) -> DataFrame:
    """The best donors of each query in its group, as far as ``reach``; where they meet on nothing, among all donors."""
    if not on:
        return _meet_all(q, d, k, same)

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qk": [], "dk": [], "dist": [], "val": []})
        out = _best(
            left["key"].to_numpy(), X.as_matrix(left["x"]), right["key"].to_numpy(), X.as_matrix(right["x"]),
            right["val"].to_numpy(), k, nan_aware, same, left["reach"].to_numpy(),
        )
        reach = left.groupby("key")["reach"].max()
        return out[out["dist"].to_numpy() <= reach.reindex(out["qk"]).to_numpy()]

    return q.groupBy(*on).cogroup(d.groupBy(*on)).applyInPandas(near, _PAIR)


class _Top:
    """The ``k`` best donors so far of the queries of a block, and how far another one may be."""

    def __init__(self, block: T.Block, k: int, same: bool):
        self.keys, self.x, self.k, self.same = block.keys, block.x, k, same
        self.reach = block.extra.copy()
        self.row, self.dk = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.dist, self.val = np.zeros(0), np.zeros(0)

    def _candidates(self, keys: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(rows, donors)``, some rows at a time: whatever may be among the best."""
        if not (_plain(self.x) and _plain(x)):
            for a in range(0, len(self.x), step := max(1, _NARROW // len(x))):
                i, j = np.nonzero(_distances(self.x[a : a + step], x, False) <= self.reach[a : a + step, None])
                yield i + a, j
            return
        # Half the digits are enough where they are far finer than the reach.
        power = self.reach * self.reach
        rough = T.rounding(np.float32, x.shape[1]) * ((self.x - x.mean(axis=0)) ** 2).sum(axis=1)
        coarse = np.isfinite(power).all() and np.abs(self.x).max() + np.abs(x).max() < 1e15 and np.median(power) > 1e3 * np.median(rough)
        for part, square, slack in T.squares(self.x, x, np.float32 if coarse else np.float64, _NARROW):
            most = power[part] * (1 + 1e-9) + slack
            near = square <= most[:, None].astype(square.dtype)
            if self.k < len(x) and np.count_nonzero(near) > 4 * self.k * len(near):
                wide = np.flatnonzero(near.sum(axis=1) > 4 * self.k)
                mine = square[wide]
                if self.same:
                    mine[self.keys[part][wide, None] == keys[None, :]] = np.inf
                most[wide] = np.minimum(most[wide], np.partition(mine, self.k - 1, axis=1)[:, self.k - 1] + 2 * slack[wide])
                near = square <= most[:, None].astype(square.dtype)
            i, j = np.divmod(np.flatnonzero(near.reshape(-1)), len(x))
            yield i + part.start, j

    def _distance(self, i: np.ndarray, x: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i))
        for a in range(0, len(i), step := _TILE // x.shape[1] + 1):
            gap = self.x[i[a : a + step]] - x[j[a : a + step]]
            gap *= gap
            total = np.zeros(len(gap))
            for column in gap.T:  # in the order of the features, as tile by tile
                total += column
            out[a : a + step] = np.sqrt(total)
        return out

    def add(self, donors: T.Block) -> None:
        waiting, n = [], 0
        for i, j in self._candidates(donors.keys, donors.x):
            if self.same:
                other = self.keys[i] != donors.keys[j]
                i, j = i[other], j[other]
            waiting.append((i, j))
            n += len(i)
            if n > _NARROW:
                self._merge(donors, waiting)
                waiting, n = [], 0
        if n:
            self._merge(donors, waiting)

    def _merge(self, donors: T.Block, waiting: list[tuple[np.ndarray, np.ndarray]]) -> None:
        i, j = (np.concatenate(c) for c in zip(*waiting))
        dist = self._distance(i, donors.x, j)
        fine = (dist <= self.reach[i]) & np.isfinite(dist)
        i, j, dist = i[fine], j[fine], dist[fine]
        row, dk = np.concatenate([self.row, i]), np.concatenate([self.dk, donors.keys[j]])
        dist, val = np.concatenate([self.dist, dist]), np.concatenate([self.val, donors.extra[j]])
        order = np.lexsort((dk, dist, row))
        order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < self.k]
        self.row, self.dk, self.dist, self.val = row[order], dk[order], dist[order], val[order]
        held = np.flatnonzero(np.bincount(self.row, minlength=len(self.keys)) == self.k)
        last = np.searchsorted(self.row, held, side="right") - 1
        self.reach[held] = np.minimum(self.reach[held], self.dist[last])

    def end(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, from_pandas=True) for c in (self.keys[self.row], self.dk, self.dist, self.val)], names=["qk", "dk", "dist", "val"])


def _meet_all(q: DataFrame, d: DataFrame, k: int, same: bool) -> DataFrame:
    """The best donors of each query as far as ``reach``: blocks of queries keep their best while all donors pass by."""
    width = d.select(F.size("x")).first()[0]
    left = q.select("key", "x", F.col("reach").alias("extra"))
    return T.meet(left, d.select("key", "x", F.col("val").alias("extra")), q.count(), d.count(), width, None,
                  lambda block: _Top(block, k, same), _Top.add, _Top.end, _PAIR)


def _by_units(q: DataFrame, d: DataFrame, k: int, nan_aware: bool, same: bool, block: int, width: int) -> DataFrame:
    spark = q.sparkSession
    if not nan_aware:
        # Rows with a missing feature have no plain distance.
        whole = ~F.exists("x", lambda v: F.isnan(v))
        q, d = q.where(whole), d.where(whole)
    need = k + 1 if same else k
    size = max(1, min(block // 4, X.UNIT_ROWS))
    n = d.count()
    if not n or not width:
        return spark.createDataFrame([], _PAIR)
    wanted = int(np.clip(-(-n // size), 1, max(1, X.NUMBERS // width)))
    units = X.plan_units(X.sampled(d, X.DRAWN * wanted, n), n, size)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(unit=units.of_rows(X.as_matrix(b["x"])))

    schema = "key long, x array<double>, val double, unit long"
    donors = cut_lineage(d.mapInPandas(place, schema))
    found = X.measure(donors, units.count, width)
    home = _homes(found, nan_aware, need)
    search = X.Search(found, nan_aware)
    d_parts = {u: int(-(-c // block)) for u, c in enumerate(found.rows) if c}

    # One unit near each query bounds its reach.
    def near_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(unit=home(units, X.as_matrix(b["x"])))

    at_home = q.mapInPandas(near_home, schema)
    left, right = X.spread(at_home, donors, X.parts(at_home, block), d_parts, first_only=True)
    probed = cut_lineage(_reaches(left, right, need, nan_aware, same))

    def wants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                for rows, unit in search.within(X.as_matrix(b["x"]), b["reach"].to_numpy()):
                    yield b.iloc[rows].assign(unit=unit)

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                for _, unit in search.within(X.as_matrix(b["x"]), b["reach"].to_numpy()):
                    names, n = np.unique(unit, return_counts=True)
                    yield pd.DataFrame({"unit": names, "n": n})

    many = len(d_parts) > WHOLE // size
    if many and width >= WIDE and not nan_aware:
        # Boxes hardly bound such rows: where some drawn queries want most units, every query meets every donor, block by block.
        drawn = probed.orderBy(F.md5(F.col("key").cast("string"))).limit(ASKED).select("x", "reach").toPandas()
        hits = sum(len(unit) for _, unit in search.within(X.as_matrix(drawn["x"]), drawn["reach"].to_numpy())) if len(drawn) else 0
        if hits > MOST_UNITS * len(drawn) * len(d_parts):
            return _meet(probed, donors, [], k, nan_aware, same)

    asked = probed.mapInPandas(wants, "key long, x array<double>, reach double, unit long")
    wanted_by = probed.mapInPandas(counts, "unit long, n long").groupBy("unit").agg(F.sum("n")).collect()  # one row per unit
    if many and sum(r[1] for r in wanted_by) > MOST_UNITS * probed.count() * len(d_parts):
        # A query goes to bundles of neighbouring units once, not to nearly every unit.
        per = WHOLE // size

        def bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    hits = [rows * units.count + unit // per for rows, unit in search.within(X.as_matrix(b["x"]), b["reach"].to_numpy())]
                    rows, bundle = np.divmod(np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64), units.count)
                    yield b.iloc[rows].assign(unit=bundle)

        asked = cut_lineage(probed.mapInPandas(bundles, "key long, x array<double>, reach double, unit long"))
        donors = donors.withColumn("unit", F.floor(F.col("unit") / per))
        block = WHOLE
        q_parts, d_parts = X.parts(asked, block), X.parts(donors, block)
    else:
        q_parts = {r[0]: -(-r[1] // block) for r in wanted_by}
    left, right = X.spread(asked, donors, q_parts, d_parts)
    return _meet(left, right, ["unit", "qb", "db"], k, nan_aware, same)


def _homes(found: X.Boxes, nan_aware: bool, need: int):
    """Where a query looks first: its own unit, or the unit nearest to that which has enough rows in a block (the fullest, where features are
    missing: a query shares most features with rows that have all)."""
    rich = np.flatnonzero(found.rows >= need)
    if not len(rich):
        rich = np.array([int(found.rows.argmax())])
    if nan_aware:
        complete = rich[found.always[rich].sum(axis=1) == found.always[rich].sum(axis=1).max()]
        middle = (np.where(found.always[complete], found.low[complete], 0) + np.where(found.always[complete], found.high[complete], 0)) / 2

        # First the nearest group of neighbouring units, then the nearest unit of the group.
        per = max(1, int(np.sqrt(len(complete))))
        centres = np.array([middle[a : a + per].mean(axis=0) for a in range(0, len(complete), per)])

        def nearest_of(x: np.ndarray, points: np.ndarray) -> np.ndarray:
            out = np.empty(len(x), np.int64)
            step = max(1, _NARROW // len(points))
            for a in range(0, len(x), step):
                off = np.zeros((len(x[a : a + step]), len(points)))
                for j in range(x.shape[1]):
                    gap = x[a : a + step, j : j + 1] - points[None, :, j]
                    off += np.where(np.isnan(gap), 0, gap * gap)
                out[a : a + step] = off.argmin(axis=1)
            return out

        def home(units: X.Units, x: np.ndarray) -> np.ndarray:
            group = nearest_of(x, centres)
            out = np.empty(len(x), np.int64)
            for g in np.unique(group):
                rows = np.flatnonzero(group == g)
                out[rows] = complete[g * per + nearest_of(x[rows], middle[g * per : (g + 1) * per])]
            return out

        return home
    # Neighbours in number lie close together.
    near = rich[np.minimum(np.searchsorted(rich, np.arange(len(found.rows))), len(rich) - 1)]
    return lambda units, x: near[units.of_rows(x)]


def _reaches(q: DataFrame, d: DataFrame, need: int, nan_aware: bool, same: bool) -> DataFrame:
    """``key, x, reach``: the distance of the ``need``-th donor that a query met, infinite where it met fewer."""

    def bound(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"key": [], "x": [], "reach": []})
        reach = np.full(len(left), np.inf)
        if len(right) >= need:
            x, dx = X.as_matrix(left["x"]), X.as_matrix(right["x"])
            wide = dx.shape[1] >= WIDE and _plain(x) and _plain(dx)
            step = max(1, (_TILE if wide else _NARROW) // len(dx))
            for a in range(0, len(x), step):
                if wide:
                    # The bound may be a hair too far, never too near.
                    square, slack = _near_squares(x[a : a + step], dx)
                    least = np.partition(square, need - 1, axis=1)[:, need - 1]
                    reach[a : a + step] = np.sqrt(np.maximum(least + slack, 0.0))
                    continue
                dist = _distances(x[a : a + step], dx, nan_aware)
                dist[np.isnan(dist)] = np.inf
                reach[a : a + step] = np.partition(dist, need - 1, axis=1)[:, need - 1]
        return left[["key", "x"]].assign(reach=reach)

    on = ["unit", "qb", "db"]
    return q.groupBy(*on).cogroup(d.groupBy(*on)).applyInPandas(bound, "key long, x array<double>, reach double")
