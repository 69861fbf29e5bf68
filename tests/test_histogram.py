"""Boosting on histograms against a plain leaf-wise version, its classes, gaps and saved form."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lumenframe.models import blocks, histogram as H
from lumenframe.models import training as M
from lumenframe.models.training import TrainingConfig


def table(spark, x, y):
    rows = [([None if math.isnan(v) else float(v) for v in r], None if t is None else float(t)) for r, t in zip(x.tolist(), y)]
    return spark.createDataFrame(rows, "features array<double>, label double").repartition(3)


def score(g, d, s):
    t = math.copysign(max(abs(g) - s.l1, 0), g)
    return t * t / (d + s.l2) if d + s.l2 > 0 else 0.0


def best_split(x, g, h, s):
    best = None
    d = np.ones(len(g)) if s.by_rows else h
    for f in range(x.shape[1]):
        gap = np.isnan(x[:, f])
        for side in (False, True):
            for cut in np.unique(x[~gap, f]):
                left = np.where(gap, side, x[:, f] <= cut)
                n = left.sum()
                if min(n, len(g) - n) < max(1, s.min_rows) or min(h[left].sum(), h[~left].sum()) < s.min_hessian:
                    continue
                gain = 0.5 * (score(g[left].sum(), d[left].sum(), s) + score(g[~left].sum(), d[~left].sum(), s) - score(g.sum(), d.sum(), s)) - s.min_gain
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9 * abs(gain)):
                    best = (gain, f, cut, left)
    return best


def plain_tree(x, g, h, s):
    """Values per row of one tree, and its number of leaves; best gain first."""
    leaves = [(np.arange(len(g)), 0)]
    while s.max_leaves is None or len(leaves) < s.max_leaves:
        found = [(best_split(x[r], g[r], h[r], s), i) for i, (r, depth) in enumerate(leaves) if s.max_depth is None or depth < s.max_depth]
        found = [(b, i) for b, i in found if b]
        if not found:
            break
        (_, _, _, left), i = max(found, key=lambda z: z[0][0])
        r, depth = leaves.pop(i)
        leaves += [(r[left], depth + 1), (r[~left], depth + 1)]
    out = np.zeros(len(g))
    for r, _ in leaves:
        out[r] = -math.copysign(max(abs(g[r].sum()) - s.l1, 0), g[r].sum()) / max(h[r].sum() + s.l2, 1e-12) * s.rate
    return out, len(leaves)


def plain_margins(x, y, classes, s):
    loss = H._loss(classes)
    counts = np.array([np.sum(y == c) for c in range(max(2, classes))], float) if classes else np.array([float(len(y))])
    m = np.repeat(H.start_margins(loss, counts, float(np.sum(y)))[:, None], len(y), axis=1)
    for _ in range(s.rounds):
        g, h = H.gradients(loss, m, y)
        m = m + np.stack([plain_tree(x, g[k], h[k], s)[0] for k in range(len(m))])
    return m


@pytest.mark.parametrize("classes", [0, 2, 3])
@pytest.mark.parametrize("s", [
    H.Settings(rounds=3, max_leaves=6, l2=1.0, min_rows=5),
    H.Settings(rounds=2, max_depth=3, l1=0.5, l2=0.3, rate=0.3, min_hessian=1.0, min_gain=0.01),
    H.Settings(rounds=2, max_depth=2, by_rows=True),
])
def test_equals_plain_boosting(spark, classes, s):
    rng = np.random.default_rng(classes)
    x = np.round(rng.normal(size=(240, 4)), 1)
    x[:, 3] = rng.integers(0, 3, 240)
    x[rng.random(x.shape) < 0.1] = np.nan
    signal = np.nan_to_num(x[:, 0], nan=2.0) + (np.nan_to_num(x[:, 3]) == 1)
    y = np.digitize(signal, [-0.3, 0.9][: max(0, classes - 1)]).astype(float) if classes else signal + rng.normal(size=240) / 5
    model = H.fit(table(spark, x, y), classes, s)
    assert np.allclose(model.margins(x), plain_margins(x, y, classes, s), atol=1e-8)


def test_margins_are_written_between_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(150, 2)), 1)
    y = x[:, 0] * 2 + x[:, 1]
    s = H.Settings(rounds=5, max_depth=2, l2=1.0)
    whole = H.fit(table(spark, x, y), 0, s)
    monkeypatch.setattr(H, "ROUNDS_APART", 2)
    assert np.allclose(H.fit(table(spark, x, y), 0, s).margins(x), whole.margins(x))
    monkeypatch.setattr(blocks, "ROOM", 1)  # one node a pass
    assert np.allclose(H.fit(table(spark, x, y), 0, s).margins(x), whole.margins(x))


def test_passes_follow_levels_not_leaves(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 3))
    asked = []
    ask = H._ask
    monkeypatch.setattr(H, "_ask", lambda *a: asked.append(1) or ask(*a))
    model = H.fit(table(spark, x, np.sin(3 * x[:, 0]) + x[:, 1]), 0, H.Settings(rounds=1, max_leaves=31, min_rows=20))
    assert (model.rounds[0][0].feature < 0).sum() == 31 and len(asked) <= 12


def test_side_of_missing_values_is_learned(spark):
    x = np.array([[1.0], [2.0], [3.0], [4.0], [np.nan], [np.nan]] * 20)
    y = [0.0, 0.0, 5.0, 5.0, 0.0, 0.0] * 20
    model = H.fit(table(spark, x, y), 0, H.Settings(rounds=1, max_depth=1, rate=1.0))
    got = model.transform(table(spark, x, y).select(F.expr("features"), "label").transform(to_vector)).groupBy("label").agg(
        F.min("prediction").alias("low"), F.max("prediction").alias("high")).collect()
    assert {(r.label, round(r.low, 6), round(r.high, 6)) for r in got} == {(0.0, 0.0, 0.0), (5.0, 5.0, 5.0)}


def to_vector(df):
    from pyspark.ml.functions import array_to_vector

    whole = array_to_vector(F.transform("features", lambda v: F.coalesce(v, F.lit(float("nan")))))
    return df.withColumn("features", F.when(F.col("features").isNotNull(), whole))


@pytest.mark.parametrize("algorithm", ["XGBoost", "LightGBM", "Gradient Boosting Classifier"])
@pytest.mark.parametrize("target", ["kind", "big", "effort"])
def test_trained_saved_and_loaded(spark, tmp_path, algorithm, target):
    if target == "effort" and algorithm.startswith("Gradient"):
        pytest.skip("a classifier")
    kind = F.expr("case when id % 7 < 2 then 'low' when id % 7 < 5 then 'mid' else 'high' end")
    df = spark.range(600).select(
        "id", F.when(F.col("id") % 11 > 0, F.col("id") % 7).cast("double").alias("a"), F.concat(F.lit("t"), F.col("id") % 3).alias("b"),
        F.lit(None).cast("double").alias("nothing"), kind.alias("kind"), (F.col("id") % 7 > 3).cast("int").alias("big"), (F.col("id") % 7 * 2.0).alias("effort"),
    )
    task = "regression" if target == "effort" else "classification"
    config = TrainingConfig(task, algorithm, "id", target, ("a", "b", "nothing"), {"n_estimators": 8, "min_child_samples": 5})
    result = M.train(df, config)
    if task == "regression":
        assert result.metrics["r2"] > 0.5
    else:
        assert result.metrics["f1"] > 0.85 and result.metrics["roc_auc"] > 0.9
        p = result.test.select(vector_to_array("probability").alias("p")).collect()
        assert all(len(r.p) == (3 if target == "kind" else 2) and abs(sum(r.p) - 1) < 1e-9 for r in p)
    M.save(result.prepare, result.model, f"{tmp_path}/m")
    back = M.predict_batch(df.drop(target), f"{tmp_path}/m", config)
    assert back.count() == 600
    direct = {r.id: r.prediction for r in result.test.select("id", "prediction").collect()}
    assert all(abs(direct[r.id] - r.prediction) < 1e-12 for r in back.select("id", "prediction").collect() if r.id in direct)
    rank = M.feature_importance(result).orderBy("rank").collect()
    assert rank[0].feature == "a" and abs(sum(r.importance for r in rank) - 1) < 1e-9


def test_degenerate_tables(spark):
    x = np.array([[1.0, 2.0]] * 10)
    for y, classes in (([3.0] * 10, 0), ([1.0] * 10, 2), ([0.0, 1.0] * 5, 2)):
        model = H.fit(table(spark, x, y), classes, H.Settings(rounds=3, max_depth=2))
        assert model.rounds == () and len(model.margins(x)[0]) == 10
    assert H.fit(table(spark, x[:0], []), 0, H.Settings()).rounds == ()
    gaps = to_vector(table(spark, x[:2], [1.0, None])).unionByName(spark.createDataFrame([(None, 1.0)], "features array<double>, label double").transform(to_vector))
    assert [r.prediction for r in H.fit(table(spark, x, [3.0] * 10), 0, H.Settings()).transform(gaps).orderBy("prediction").collect()] == [None, 3.0, 3.0]
