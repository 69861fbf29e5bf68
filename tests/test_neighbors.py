"""Neighbours by box units: the same as brute force, few meetings on clustered rows, gaps, and rows without a distance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import boxes as X
from lumenframe.operators import joins as J
from lumenframe.operators import neighbors as N
from lumenframe.operators.density import dbscan


def brute(q, d, k, nan_aware, same=False):
    """{(query, rank): (donor, distance)}."""
    out = {}
    for i, row in enumerate(q):
        gap = d - row
        there = ~np.isnan(gap)
        power = np.where(there, gap, 0.0) ** 2
        n = there.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            dist = np.sqrt(power.sum(axis=1) * (d.shape[1] / n)) if nan_aware else np.sqrt(power.sum(axis=1))
        dist[(n == 0) if nan_aware else (n < d.shape[1])] = np.inf
        if same:
            dist[i] = np.inf
        for rank, j in enumerate(np.lexsort((np.arange(len(d)), dist))[:k]):
            if np.isfinite(dist[j]):
                out[i, rank + 1] = (int(j), float(dist[j]))
    return out


def table(spark, x):
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x.tolist())], "key long, x array<double>").repartition(4)


def same_rows(got, want):
    found = {(r.query_key, r["rank"]): (r.donor_key, r.distance) for r in got.collect()}
    assert found.keys() == want.keys()
    assert all(found[at][0] == want[at][0] and abs(found[at][1] - want[at][1]) < 1e-9 for at in want)


@pytest.fixture
def compared(monkeypatch):
    """Pairs of rows that meet after the probe."""
    total = [0]
    meet = N._meet

    def counted(q, d, on, *rest):
        a, b = q.groupBy(*on).agg(F.count("*").alias("n")), d.groupBy(*on).agg(F.count("*").alias("m"))
        total[0] += a.join(b, on).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
        return meet(q, d, on, *rest)

    monkeypatch.setattr(N, "_meet", counted)
    return total


def test_clustered_rows_meet_few_units(spark, compared):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(25, 16)) * 20
    d = centres[rng.integers(0, 25, 3000)] + rng.normal(size=(3000, 16))
    d[:300] = d[0]  # a crowd of equal rows: more than a block
    q = np.concatenate([centres[rng.integers(0, 25, 600)] + rng.normal(size=(600, 16)), rng.normal(size=(5, 16)) * 30])
    got = N.nearest(table(spark, q), table(spark, d), "key", "key", "x", 5, ship_rows=0, block_rows=100)
    same_rows(got, brute(q, d, 5, False))
    assert compared[0] < 0.12 * len(q) * len(d)


@pytest.mark.parametrize("block", [60, 5000])
def test_gaps_are_bounded_too(spark, compared, block):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(40, 5))[rng.integers(0, 40, 1200)] * 30 + rng.normal(size=(1200, 5)), 2)
    holes = rng.random(x.shape) < [0.0, 0.2, 0.0, 0.05, 0.0]
    x[holes] = np.nan
    x[5], x[6, :4] = np.nan, np.nan
    cols = [F.col("x")[i].alias(f"c{i}") for i in range(5)]
    df = table(spark, x).select("key", *cols)
    names = [f"c{i}" for i in range(5)]
    got = N.nearest(df, df, "key", "key", names, 3, nan_aware=True, exclude_same_key=True, ship_rows=0, block_rows=block)
    same_rows(got, brute(x, x, 3, True, same=True))
    if block == 60:
        assert compared[0] < 0.5 * len(x) ** 2


def test_fewer_donors_than_asked_for(spark):
    rng = np.random.default_rng(3)
    q, d = rng.normal(size=(50, 2)), rng.normal(size=(3, 2))
    same_rows(N.nearest(table(spark, q), table(spark, d), "key", "key", "x", 5, ship_rows=0, block_rows=10), brute(q, d, 5, False))


@pytest.mark.parametrize("ship", [0, 10_000])
def test_rows_without_a_distance(spark, ship):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [5.0]), (5, [None, 2.0]), (6, [float("nan"), 1.0]), (7, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "key long, x array<double>")
    got = N.nearest(df, df, "key", "key", "x", 2, exclude_same_key=True, ship_rows=ship, block_rows=2).orderBy("query_key", "rank").collect()
    assert [(r.query_key, r.donor_key) for r in got] == [(1, 7), (1, 2), (2, 7), (2, 1), (7, 1), (7, 2)]
    assert N.nearest(df, df.where("key = 3"), "key", "key", "x", 2, ship_rows=ship).count() == 0


def test_boxes_bound_every_row():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4))
    x[rng.random(x.shape) < 0.3] = np.nan
    units = X.plan_units(x[:100], 400, 20)
    place = units.of_rows(x)
    assert place.min() >= 0 and place.max() < units.count
    there = ~np.isnan(x)
    pick = [np.flatnonzero(place == u) for u in range(units.count)]
    fill = lambda f, empty: np.array([f(np.where(there[p], x[p], empty), axis=0) if len(p) else np.full(4, empty) for p in pick])
    boxes = X.Boxes(
        np.array([len(p) for p in pick]), fill(np.min, np.inf), fill(np.max, -np.inf),
        np.array([there[p].all(axis=0) if len(p) else np.zeros(4, bool) for p in pick]), np.array([there[p].any(axis=0) if len(p) else np.zeros(4, bool) for p in pick]),
    )
    q = x[rng.integers(0, 400, 50)] + 0.3
    dist = N._distances(q, x, True)
    for u, p in enumerate(pick):
        if len(p):
            low = boxes.nearest_possible(q, np.full(len(q), u), True)
            assert (low <= np.where(np.isnan(dist[:, p]), np.inf, dist[:, p]).min(axis=1) + 1e-9).all()
    found = {(i, u) for rows, us in X.Search(boxes, True).within(q, np.full(len(q), 1.0)) for i, u in zip(rows, us)}
    assert found >= {(i, place[j]) for i, j in zip(*np.nonzero(dist <= 1.0))}


def test_pairs_within_a_radius(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(300, 4)), np.full((60, 4), 9.0), rng.normal(size=(60, 4)) * 8])
    df = spark.createDataFrame([(f"k{i:04d}", *map(float, r)) for i, r in enumerate(x)] + [("gap", None, 1.0, 1.0, 1.0), (None, 9.0, 9.0, 9.0, 9.0)],
                               "id string, a double, b double, c double, d double").repartition(3)
    cols = ["a", "b", "c", "d"]
    square = N._distances(x, x, False) ** 2
    want = {(f"k{i:04d}", f"k{j:04d}") for i, j in zip(*np.nonzero(square <= 0.5)) if i < j}
    for got in (J.pairs_within(df, "id", cols, np.sqrt(0.5) + 1e-12), small_blocks(df, cols)):
        rows = got.collect()
        assert {(r.left_key, r.right_key) for r in rows} == want and len(rows) == len(want)
    assert J.pairs_within(df.limit(0), "id", cols, 1.0).count() == 0


def small_blocks(df, cols):
    points = df.where("a is not null and id is not null").select(F.col("id").alias("key"), F.array(*cols).alias("x"))
    found = X.range_pairs(points, 4, np.sqrt(0.5) + 1e-12, 0.5 + 1e-12, block=20)
    return found.select(F.col("left").alias("left_key"), F.col("right").alias("right_key"))


def test_a_crowded_unit_is_many_tasks(spark, monkeypatch):
    """A third of the rows at one place: no block of either side holds more than about its share."""
    seen = []
    spread = X.spread
    monkeypatch.setattr(X, "spread", lambda *a, **k: seen.append(spread(*a, **k)) or seen[-1])
    x = np.concatenate([np.random.default_rng(6).normal(size=(400, 2)) * 30, np.full((200, 2), 1.0)])
    points = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "key long, x array<double>")
    found = X.range_pairs(points, 2, 0.1, 0.01, block=20)
    assert found.where("left >= 400").count() == 200 * 199 // 2
    for side in seen[0]:
        most = side.groupBy("unit", "qb", "db").count().agg(F.max("count")).first()[0]
        assert most <= 60


def test_density_of_many_columns(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(80, 8)) * 0.4, rng.normal(size=(60, 8)) * 0.4 + 4, rng.uniform(-6, 10, size=(40, 8)), np.full((12, 8), 2.0)])
    cols = [f"c{i}" for i in range(8)]
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "key long, " + ", ".join(f"{c} double" for c in cols))
    near = N._distances(x, x, False) <= 1.2
    core = near.sum(axis=1) >= 5
    label = {}
    for i in np.flatnonzero(core):
        if i not in label:
            stack, label[i] = [i], int(i)
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core):
                    if j not in label:
                        label[j] = int(i)
                        stack.append(j)
    want = {i: label.get(i, min((label[j] for j in np.flatnonzero(near[i] & core)), default=-1)) for i in range(len(x))}
    got = dbscan(df, "key", cols, 1.2, 5).collect()
    assert {r.key: r.cluster for r in got} == want and {r.key for r in got if r.is_core} == set(np.flatnonzero(core))


@pytest.mark.parametrize("same", [False, True])
def test_wide_rows_by_matrix_product(monkeypatch, same):
    """Candidates come from one product, not feature by feature; near copies far from zero keep their exact distances and order."""

    def refused(*_):
        raise AssertionError("feature by feature")

    monkeypatch.setattr(N, "_distances", refused)
    rng = np.random.default_rng(4)
    d = np.concatenate([rng.normal(size=(150, 16)), 1e6 + rng.normal(size=(150, 16)) * 1e-3])
    d[200:220] = d[180:200]
    q = d if same else np.concatenate([d[::3], rng.normal(size=(40, 16))])
    keys = np.arange(len(d))
    got = N._best(np.arange(len(q)), q, keys[::-1], d[::-1], keys[::-1] * 2.0, 5, False, same)
    want = brute(q, d, 5, False, same)
    found = {}
    for row in got.itertuples():
        rank = 1 + sum(1 for key in found if key[0] == row.qk)
        found[row.qk, rank] = (row.dk, row.dist)
    assert found.keys() == want.keys() and (got["val"] == got["dk"] * 2).all()
    assert all(found[at][0] == want[at][0] and abs(found[at][1] - want[at][1]) < 1e-9 for at in want)


def test_rows_without_order_go_to_bundles(spark, monkeypatch):
    """Where boxes bound nothing, a query is sent to a few bundles instead of every unit."""
    monkeypatch.setattr(N, "WHOLE", 300, raising=False)
    sent, meet = [], N._meet

    def counted(q, d, *rest):
        sent.append(q.count())
        return meet(q, d, *rest)

    monkeypatch.setattr(N, "_meet", counted)
    x = np.random.default_rng(6).normal(size=(900, 24))
    got = N.nearest(table(spark, x), table(spark, x), "key", "key", "x", 4, exclude_same_key=True, ship_rows=10, block_rows=80)
    same_rows(got, brute(x, x, 4, False, True))
    assert sent[0] <= 900 * 6


def test_rows_of_equal_features_are_searched_once(spark, compared):
    rng = np.random.default_rng(7)
    x = rng.integers(0, 4, size=(1500, 2)).astype(float)
    x[rng.random(x.shape) < 0.1] = np.nan
    df = table(spark, x).select("key", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    got = N.nearest(df, df, "key", "key", ["a", "b"], 5, nan_aware=True, ship_rows=0, block_rows=200)
    same_rows(got, brute(x, x, 5, True))
    assert compared[0] <= 25 * 25 * 5
    compared[0] = 0
    alone = N.nearest(df, df, "key", "key", ["a", "b"], 5, nan_aware=True, exclude_same_key=True, ship_rows=0, block_rows=200)
    same_rows(alone, brute(x, x, 5, True, same=True))
    assert compared[0] <= len(x) * 25 * 6


def test_bounds_of_units_take_no_group_each(spark):
    rng = np.random.default_rng(8)
    x, unit = rng.normal(size=(900, 3)), rng.integers(0, 40, 900)
    x[rng.random(x.shape) < 0.3] = np.nan
    rows = spark.createDataFrame([(int(u), [float(v) for v in r]) for u, r in zip(unit, x.tolist())], "unit long, x array<double>").repartition(5)
    asked = []
    group = type(rows).groupBy
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(rows), "groupBy", lambda self, *on: (asked.append(on), group(self, *on))[1])
        found = X.measure(rows, 41, 3)
    assert not asked
    assert found.rows.tolist() == np.bincount(unit, minlength=41).tolist()
    for u in range(40):
        mine = x[unit == u]
        assert np.array_equal(found.low[u], np.where(np.isnan(mine), np.inf, mine).min(axis=0))
        assert np.array_equal(found.high[u], np.where(np.isnan(mine), -np.inf, mine).max(axis=0))
        assert np.array_equal(found.always[u], ~np.isnan(mine).any(axis=0)) and np.array_equal(found.ever[u], (~np.isnan(mine)).any(axis=0))


@pytest.mark.parametrize("most", [3, 500])
def test_rows_of_one_place_are_compared_once(spark, monkeypatch, most):
    """Many rows at few places: places meet, and all pairs of their rows come out, each once; keys may repeat."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 8, size=(400, 2)).astype(float)
    keys = [*range(390), *range(10)]
    rows = [(k, *map(float, r)) for k, r in zip(keys, x.tolist())] + [(1000, None, 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(3)
    met, range_pairs, places = [], J.range_pairs, J.places
    monkeypatch.setattr(J, "range_pairs", lambda points, *a: met.append(points.count()) or range_pairs(points, *a))
    monkeypatch.setattr(J, "places", lambda points: places(points, most))
    got = J.pairs_within(df, "id", ["a", "b"], 1.5, shown=lambda c: F.round(c, 3))
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = sorted((keys[i], keys[j], round(float(gap[i, j]), 3)) for i in range(400) for j in range(400) if gap[i, j] <= 1.5 and keys[i] < keys[j])
    assert sorted(tuple(r) for r in got.collect()) == want
    assert met[0] <= (64 if most == 500 else 260)
    assert places(df.where("a is not null and id is not null").select(F.col("id").alias("key"), F.array("a", "b").alias("x")), most).agg(F.sum(F.size("keys"))).first()[0] == 400


@pytest.mark.parametrize("same", [False, True])
@pytest.mark.parametrize("scale", [1.0, 1e160])
def test_wide_rows_without_order_meet_block_by_block(spark, monkeypatch, same, scale):
    """No row is copied for such queries, ties and repeated keys included; carried values may be missing."""
    monkeypatch.setattr(N, "WHOLE", 100)
    monkeypatch.setattr(N.T, "ROWS", 70)
    left = []
    spread = X.spread
    monkeypatch.setattr(X, "spread", lambda *a, **k: left.append(k.get("first_only")) or spread(*a, **k))
    rng = np.random.default_rng(11)
    x = rng.normal(size=(700, 12)) * (1 if scale == 1 else 1e3)
    x[300:340] = x[260:300]
    x[400:460] = x[400]
    if scale > 1:
        x[7] = scale
    df = table(spark, x).withColumn("label", F.expr("case when key % 3 > 0 then key end"))
    got = N.nearest(df, df, "key", "key", "x", 6, exclude_same_key=same, carry="label", ship_rows=10, block_rows=80).persist()
    same_rows(got, brute(x, x, 6, False, same))
    assert left == [True] and got.where("carried <=> case when donor_key % 3 > 0 then donor_key end").count() == got.count()
    twice = df.unionByName(df.where("key < 20"))
    found = N.nearest(twice, twice, "key", "key", "x", 2, exclude_same_key=True, ship_rows=10, block_rows=80)
    assert found.where("query_key = donor_key").count() == 0 and found.where("rank = 1").count() >= 699
