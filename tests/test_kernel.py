"""Support vector machines: a certificate that the optimum is reached, kernels, probabilities, saved form."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from lumenframe.models import kernel as K
from lumenframe.models import training as M
from lumenframe.models.training import TrainingConfig


def table(spark, x, y):
    rows = [(k, [float(v) for v in r], None if t is None else float(t)) for k, (r, t) in enumerate(zip(x.tolist(), y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double").repartition(3)
    return df.withColumn("features", F.when(F.col("x").isNotNull(), array_to_vector("x")))


def gap(machine, x, y, s, gram):
    """Primal value less dual value, over the primal one: at the optimum both are equal."""
    f = machine.decide(x)[:, 0]
    w = machine.weights[0][:-1]
    sign = np.where(y == 1, 1.0, -1.0)
    loss = np.maximum(0, 1 - sign * f).sum() if machine.classes else np.maximum(0, np.abs(f - y) - s.epsilon).sum()
    primal = 0.5 * w @ w + s.c * loss
    beta = -s.c * K.losses(f, y, machine.classes, 0, s.epsilon, K.WIDTHS[-1] * (2.0 if machine.classes else y.std()))[1]
    beta -= beta.mean() * (np.abs(beta.mean()) > 1e-3)  # the free constant asks for a sum of 0
    gain = (beta * sign).sum() if machine.classes else beta @ y - s.epsilon * np.abs(beta).sum()
    return (primal - (gain - 0.5 * beta @ gram @ beta)) / primal


@pytest.mark.parametrize("c, epsilon", [(1.0, 0.1), (20.0, 0.5)])
def test_regression_reaches_the_optimum(spark, c, epsilon):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(70, 2))
    y = np.sin(2 * x[:, 0]) * 3 + x[:, 1] + rng.normal(size=70) / 5
    s = K.Settings(c=c, epsilon=epsilon, gamma=0.7)
    machine = K.fit(table(spark, x, y), 0, s)
    assert len(machine.map.landmarks) == 70 and np.allclose(machine.map(x)[:, :-1] @ machine.map(x)[:, :-1].T, K.gaussian(x, x, 0.7), atol=1e-7)
    assert gap(machine, x, y, s, K.gaussian(x, x, 0.7)) < 0.02
    within = np.abs(machine.decide(x)[:, 0] - y) < epsilon + 0.05
    assert within.mean() > (0.5 if c > 1 else 0.1)
    line = K.fit(table(spark, x, y), 0, K.Settings(c=c, epsilon=epsilon, kernel="linear"))
    assert gap(line, x, y, K.Settings(c=c, epsilon=epsilon), x @ x.T) < 0.02


def test_classes_reach_the_optimum(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    y = ((x**2).sum(axis=1) > 1.3).astype(float)  # a ring that no line cuts off
    s = K.Settings(gamma=0.5)
    machine = K.fit(table(spark, x, y), 2, s)
    assert gap(machine, x, y, s, K.gaussian(x, x, 0.5)) < 0.02
    got = machine.transform(table(spark, x, y)).select("label", "prediction", vector_to_array("probability").alias("p")).collect()
    assert np.mean([r.label == r.prediction for r in got]) > 0.93
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in got) and np.mean([r.p[1] for r in got if r.label == 1]) > 0.8
    line = K.fit(table(spark, x, y), 2, K.Settings(kernel="linear"))
    assert np.mean((line.decide(x)[:, 0] > 0) == y) < 0.85


def test_few_landmarks_are_near_the_kernel(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    y = np.digitize(np.sqrt((x**2).sum(axis=1)), [1.2, 1.9]).astype(float)
    df = table(spark, x, y)
    machine = K.fit(df, 3, K.Settings(landmarks=60, c=10.0))
    assert len(machine.map.landmarks) == 60 and K.kernel_error(df, machine) < 0.02
    got = machine.transform(df).select("label", "prediction", vector_to_array("probability").alias("p")).collect()
    assert np.mean([r.label == r.prediction for r in got]) > 0.9 and all(len(r.p) == 3 and abs(sum(r.p) - 1) < 1e-9 for r in got)


@pytest.mark.parametrize("algorithm", ["Support Vector Classifier", "Support Vector Regressor"])
def test_trained_saved_and_loaded(spark, tmp_path, algorithm):
    cls = algorithm.endswith("Classifier")
    df = spark.range(300).select("id", (F.col("id") % 17).cast("double").alias("a"), (F.abs(F.col("id") % 17 - 8) > 4).cast("string").alias("kind"),
                                 (F.abs(F.col("id") % 17 - 8) * 1.0).alias("effort"))
    config = TrainingConfig("classification" if cls else "regression", algorithm, "id", "kind" if cls else "effort", ("a",), {"C": 10.0})
    result = M.train(df, config)
    assert result.metrics["f1" if cls else "r2"] > 0.95 and (not cls or result.metrics["roc_auc"] > 0.95)
    M.save(result.prepare, result.model, f"{tmp_path}/m")
    back = {r.id: r.prediction for r in M.predict_batch(df, f"{tmp_path}/m", config).select("id", "prediction").collect()}
    assert len(back) == 300 and all(abs(back[r.id] - r.prediction) < 1e-9 for r in result.test.select("id", "prediction").collect())


def test_degenerate_tables(spark):
    x = np.array([[1.0, 2.0]] * 8)
    same = K.fit(table(spark, x, [3.0] * 8), 0, K.Settings())
    assert abs(same.decide(x)[0, 0] - 3) <= 0.11
    none = table(spark, np.array([[1.0, float("nan")]]), [1.0]).unionByName(
        spark.createDataFrame([(5, None, 1.0)], "id long, x array<double>, label double").withColumn("features", F.when(F.col("x").isNotNull(), array_to_vector("x"))))
    assert [r.prediction for r in same.transform(none).collect()] == [None, None]
    assert K.fit(none, 2, K.Settings()).width == 0
    with pytest.raises(ValueError):
        K.settings({"kernel": "poly"})


def test_large_tables_begin_on_drawn_rows(spark, monkeypatch):
    """All rows are passed at the last width only, a step takes two passes, and the optimum is that of all rows."""
    monkeypatch.setattr(K, "START_ROWS", 60, raising=False)
    passes, held = [], {}

    def here(table, work):
        """The same sums in this process: passes are many, and only their number is asked for."""
        if id(table) not in held:
            held[id(table)] = (table, table.toArrow().to_batches())
        passes.append(sum(b.num_rows for b in held[id(table)][1]))
        return work(held[id(table)][1])

    monkeypatch.setattr(K.B, "add_up", here)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 2))
    y = (x[:, 0] * x[:, 1] + rng.normal(size=240) / 5 > 0).astype(float)
    s = K.Settings(gamma=0.7, landmarks=240)
    machine = K.fit(table(spark, x, y), 2, s)
    assert sum(n == 240 for n in passes) <= 1 + (1 + 2 * s.steps) + 12
    assert gap(machine, x, y, s, K.gaussian(x, x, 0.7)) < 0.02
    whole = K.fit(table(spark, x, y), 2, K.Settings(gamma=0.7, landmarks=240, steps=60))
    assert (np.sign(machine.decide(x)) == np.sign(whole.decide(x))).mean() > 0.99
