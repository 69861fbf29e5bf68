"""Trees of any depth against plain trees; dealt nodes, own bins, routed scoring, forests."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lumenframe.models import forest as T
from lumenframe.models import training as M
from lumenframe.models.training import TrainingConfig


def table(spark, x, y):
    rows = [(k, [float(v) for v in r], None if t is None else float(t)) for k, (r, t) in enumerate(zip(x.tolist(), y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double").repartition(3)
    return df.withColumn("features", array_to_vector("x"))


def quality(y, classes):
    if classes:
        n = np.bincount(y.astype(int), minlength=classes)
        return (n * n).sum() / len(y)
    return (y - y.mean()).sum() ** 2 / len(y) - ((y - y.mean()) ** 2).sum() * 0


def plain_tree(x, y, classes, s, depth=0):
    """Prediction per row of an unlimited tree."""
    value = np.bincount(y.astype(int), minlength=classes) / len(y) if classes else np.array([y.mean()])
    out = np.repeat(value[None], len(y), axis=0)
    pure = (y == y[0]).all()
    if pure or len(y) < s.min_split or (s.max_depth is not None and depth >= s.max_depth):
        return out
    best = None
    for f in range(x.shape[1]):
        for cut in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < s.min_leaf:
                continue
            if classes:
                gain = quality(y[left], classes) + quality(y[~left], classes) - quality(y, classes)
            else:
                c = y - y.mean()
                gain = c[left].sum() ** 2 / left.sum() + c[~left].sum() ** 2 / (~left).sum()
            if best is None or gain > best[0] + 1e-9 * abs(best[0]):
                best = (gain, left)
    if best is None:
        return out
    left = best[1]
    out[left], out[~left] = plain_tree(x[left], y[left], classes, s, depth + 1), plain_tree(x[~left], y[~left], classes, s, depth + 1)
    return out


def shares(model, df, k):
    col = vector_to_array("probability") if model.classes else F.array("prediction")
    rows = model.transform(df).select("id", col.alias("p")).orderBy("id").collect()
    return np.array([r.p for r in rows]).reshape(-1, k)


@pytest.mark.parametrize("classes", [0, 3])
@pytest.mark.parametrize("s", [T.Settings(), T.Settings(limit=40), T.Settings(min_leaf=4, max_depth=6, limit=60), T.Settings(min_split=10)])
def test_equals_plain_trees(spark, classes, s):
    rng = np.random.default_rng(3 + classes)
    x = rng.integers(0, 12, (300, 4)).astype(float)
    noise = rng.normal(size=300)
    y = np.clip(np.round(x[:, 0] / 5 + noise / 2), 0, 2) if classes else np.round(x[:, 0] + x[:, 1] * (x[:, 2] > 5) + noise, 1) + 1000
    df = table(spark, x, y)
    want = plain_tree(x, y, classes, s)
    model = T.fit(df, classes, s)
    assert np.allclose(shares(model, df, max(1, classes)), want, atol=1e-9)
    if s.limit < 300:  # the same trees, with their finished nodes kept as a table
        apart = T.fit(df, classes, s, ship=0)
        assert apart.subtrees is not None and np.allclose(shares(apart, df, max(1, classes)), want, atol=1e-9)
        assert np.allclose(apart.featureImportances, model.featureImportances)


def test_deeper_than_any_limit(spark):
    x = np.arange(400.0)[:, None]
    y = (np.arange(400) % 2).astype(float)
    tree = T.fit(table(spark, x, y), 2, T.Settings()).trees[0][0]
    depth = np.zeros(len(tree.feature), int)
    for i in range(len(depth)):
        for child in (tree.left[i], tree.right[i]) if tree.feature[i] >= 0 else ():
            depth[child] = depth[i] + 1
    assert depth.max() > 30 and (tree.feature < 0).sum() == 400


def test_no_node_gathers_more_than_the_limit(spark, monkeypatch):
    """A limit below the rows of a bin: nodes get bins of their own; equal rows can't be split and stay a leaf over the cluster."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(1500, 1)), np.full((200, 1), 7.0)])
    y = np.concatenate([(np.sin(40 * x[:1500, 0]) > 0), rng.random(200) < 0.3]).astype(float)
    df = table(spark, x, y)
    dealt, deal = [], T._deal
    monkeypatch.setattr(T, "_deal", lambda *a: dealt.extend(a[5]) or deal(*a))
    own, rows_of = [], T._rows_of
    monkeypatch.setattr(T, "_rows_of", lambda *a: own.append(1) or rows_of(*a))
    model = T.fit(df, 2, T.Settings(limit=3))
    assert own and max(o.total.sum() for o in dealt) <= 3
    p = shares(model, df, 2)
    assert (p[:1500].argmax(1) == y[:1500]).all() and np.allclose(p[1500:, 1], y[1500:].mean())


def test_forest_samples_rows_and_features(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 6))
    y = ((x[:, 0] + x[:, 1] > 0) ^ (rng.random(600) < 0.1)).astype(float)
    df = table(spark, x, y)
    s = T.settings("Random Forest Classifier", {"n_estimators": 15}, 6)
    assert s.features == 2 and s.bootstrap
    for settings in (s, T.Settings(trees=15, bootstrap=True, features=2, limit=100)):
        model = T.fit(df, 2, settings)
        again = T.fit(df, 2, settings)
        clean = (x[:, 0] + x[:, 1] > 0).astype(int)
        p = shares(model, df, 2)
        assert (p.argmax(1) == clean).mean() > 0.85 and len({t.feature[0] for t, _ in model.trees}) > 1
        assert model.featureImportances[0] + model.featureImportances[1] > 0.5 and np.allclose(shares(again, df, 2), p)
    tiny = T.fit(table(spark, x[:2], [0.0, 1.0]), 2, T.Settings(trees=30, bootstrap=True))
    assert np.allclose(shares(tiny, table(spark, x[:2], [0.0, 1.0]), 2).sum(axis=1), 1)


@pytest.mark.parametrize("algorithm", ["Decision Tree Classifier", "Random Forest Classifier", "Decision Tree Regressor", "Random Forest Regressor"])
def test_trained_saved_and_loaded(spark, tmp_path, algorithm):
    df = spark.range(500).select("id", (F.col("id") % 7).cast("double").alias("a"), F.concat(F.lit("t"), F.col("id") % 3).alias("b"),
                                 F.expr("case when id % 7 < 2 then 'low' when id % 7 < 5 then 'mid' else 'high' end").alias("kind"), (F.col("id") % 7 * 2.0).alias("effort"))
    cls = algorithm.endswith("Classifier")
    config = TrainingConfig("classification" if cls else "regression", algorithm, "id", "kind" if cls else "effort", ("a", "b"), {"n_estimators": 5})
    result = M.train(df, config)
    assert result.metrics["f1" if cls else "r2"] > 0.9
    M.save(result.prepare, result.model, f"{tmp_path}/m")
    back = {r.id: r.prediction for r in M.predict_batch(df, f"{tmp_path}/m", config).select("id", "prediction").collect()}
    assert len(back) == 500
    for r in result.test.select("id", "prediction").collect():
        assert math.isclose(back[r.id], r.prediction)
    assert M.feature_importance(result).orderBy("rank").first().feature == "a"
    ready = result.prepare.transform(M.shaped(df, config)).withColumn("label", (F.col("id") % (5 if cls else 50)).cast("double"))
    apart = T.fit(ready, 5 if cls else 0, T.Settings(limit=100), ship=0)
    apart.save(spark, f"{tmp_path}/apart")
    loaded = T.Forest.load(spark, f"{tmp_path}/apart")
    assert loaded.subtrees is not None
    want = apart.transform(ready).select("id", "prediction").orderBy("id").collect()
    assert loaded.transform(ready).select("id", "prediction").orderBy("id").collect() == want


def test_degenerate_tables(spark):
    x = np.array([[1.0, 2.0]] * 6)
    assert np.allclose(shares(T.fit(table(spark, x, [0.0, 1, 1, 0, 1, 1]), 2, T.Settings()), table(spark, x, [0.0] * 6), 2)[0], [1 / 3, 2 / 3])
    model = T.fit(table(spark, x, [5.0] * 6), 0, T.Settings())
    none = spark.createDataFrame([(1, None)], "id long, x array<double>").withColumn("features", F.when(F.col("x").isNotNull(), array_to_vector("x")))
    assert model.transform(none).first().prediction is None and model.transform(table(spark, x, [0.0] * 6)).first().prediction == 5.0
    assert T.fit(table(spark, x[:0], []), 2, T.Settings()).width == 0


def test_sums_of_classes_are_added_per_tree(monkeypatch):
    from lumenframe.models import blocks as B

    rng = np.random.default_rng(3)
    bins, place = rng.integers(0, 256, (2, 500)).astype(np.uint8), rng.integers(-1, 4, 500)
    y, w = rng.integers(0, 3, 500).astype(float), rng.poisson(1.0, 500).astype(float)
    want, got = np.zeros((4, 2, B.BINS, 3)), np.zeros((4, 2, B.BINS, 3))
    B.node_sums(bins, place, 4, [w * (y == c) for c in range(3)], want)
    B.class_sums(bins, place, 4, y, 3, w, got)
    assert np.array_equal(got, want)
    # Two trees with two open nodes each: no tree is added up into the nodes of the other.
    grown = {}
    for t in range(2):
        grown[t] = T.Growing(3)
        root = grown[t].add(np.zeros(3))
        grown[t].split(root, 0, 0.0, grown[t].add(np.zeros(3)), grown[t].add(np.zeros(3)), 1.0)
    nodes = [T.Open(t, n, 1 + n, 1) for t in range(2) for n in (1, 2)]
    x = rng.normal(size=(500, 2))
    blocks = [(bins, x, y, 0)]
    monkeypatch.setattr(T, "_unpacked", lambda batches, width: iter(blocks))
    monkeypatch.setattr(B, "add_up", lambda table, work: work(None))
    slots, class_sums = [], B.class_sums
    monkeypatch.setattr(B, "class_sums", lambda *a: (slots.append(a[2]), class_sums(*a)))
    found = T._ask(None, 2, 3, T.Settings(trees=2, bootstrap=True), grown, nodes)
    assert slots == [2, 2]
    for i, o in enumerate(nodes):
        w = T.row_weights(T.Settings(trees=2, bootstrap=True), o.tree, 0, 500)
        mine = (x[:, 0] <= 0) == (o.node == 1)
        assert found[i][0].sum(axis=0).tolist() == [w[mine & (y == c)].sum() for c in range(3)]


@pytest.mark.parametrize("classes", [0, 2, 8])
def test_every_size_gives_the_same_tree(spark, classes):
    """Above the limit, too, a split is the best of all values and lies halfway between two of them; bins alone would miss it."""
    rng = np.random.default_rng(13 + classes)
    x = np.stack([rng.lognormal(sigma=4, size=3000), rng.normal(size=3000), rng.integers(0, 4, 3000)], axis=1)
    x[rng.random(x.shape) < 0.02] = np.nan
    x[:2, 1] = -np.inf, np.inf
    y = np.where(x[:, 0] > 1.2345, 1, 0) + (rng.random(3000) < 0.1) if classes != 8 else rng.integers(0, 8, 3000)
    y = np.minimum(y, 1) if classes == 2 else y
    df = spark.createDataFrame([([float(v) for v in r], float(t)) for r, t in zip(x.tolist(), y)], "features array<double>, label double").repartition(3)
    for s in (T.Settings(max_depth=3), T.Settings(max_depth=2, min_leaf=40, features=1, seed=5)):
        want = T.fit(df, classes, s).trees[0]
        got = T.fit(df, classes, T.replace(s, limit=50)).trees[0]

        def shape(tree, values, node=0):
            f = int(tree.feature[node])
            if f < 0:
                return [np.round(values[node], 9).tolist()]
            return [f, float(tree.threshold[node]), shape(tree, values, tree.left[node]), shape(tree, values, tree.right[node])]

        assert shape(*got) == shape(*want)
