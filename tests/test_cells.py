"""Forests on rows that are counted by bins, against plain counts and Spark's own forest."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.models import cells as C
from lumenframe.operators import select as S


def frame(n, seed=5):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "c": rng.normal(size=n), "d": rng.normal(size=n), "e": np.full(n, 2.0)})
    level = 2 * pdf.a + 0.6 * pdf.b + 0.4 * pdf.c + 0.2 * rng.normal(size=n)
    return pdf.assign(y=np.digitize(level, [0.2, 2.2]).astype(float))


def unpacked(table, width):
    for r in table.orderBy("block").collect():
        yield np.frombuffer(r.bins, np.uint8).reshape(width, r.n), np.frombuffer(r.y), np.frombuffer(r.rows), r.block


def test_every_row_is_counted_in_its_cell(spark):
    pdf = frame(4000)
    pdf.loc[:9, "b"] = 9.0  # a rare value has a bin of its own
    cols = [f"x{i}" for i in range(14)]  # more than one number holds
    wide = pd.DataFrame({c: pdf[list("abcde")[i % 5]] * (i + 1) for i, c in enumerate(cols)}).assign(y=pdf.y)
    df = spark.createDataFrame(wide).repartition(3)
    edges = C.edges_of(df, cols)
    assert [len(e) for e in edges[:5]] == [31, 5, 31, 31, 0]
    want = {}
    for row in wide.to_numpy():
        key = (*(int(np.searchsorted(e, v, side="left")) for e, v in zip(edges, row)), int(row[-1]))
        want[key] = want.get(key, 0) + 1
    got = {}
    for bins, y, rows, _ in unpacked(C.counted(df, "y", cols), len(cols)):
        for i in range(len(y)):
            got[(*bins[:, i].tolist(), int(y[i]))] = rows[i]
    assert got == want


def test_more_rows_do_not_make_more_cells(spark):
    df = spark.createDataFrame(frame(2000)).select("b", F.round("a").alias("a"), "y")
    sizes = [C.counted(df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(k)))), "y", ["a", "b"]).agg(F.sum("n")).first()[0] for k in (1, 20)]
    assert sizes[0] == sizes[1] < 200


def test_samples_of_cells_are_those_of_their_rows():
    rows = np.repeat([1.0, 3.0, 40.0], 40000)
    w = C.drawn(42, 0, 0, rows).reshape(3, -1)
    assert np.allclose(w.mean(axis=1), [1, 3, 40], rtol=0.02) and np.allclose(w.var(axis=1), [1, 3, 40], rtol=0.05)
    assert np.allclose([(w[0] == k).mean() for k in range(4)], [0.3679, 0.3679, 0.1839, 0.0613], atol=0.01)


def test_sums_and_best_split_of_a_root(spark):
    cols = list("abcde")
    table = C.counted(spark.createDataFrame(frame(3000)).repartition(2), "y", cols)
    tree = C.T.Growing(3)
    root = C.T.Open(4, tree.add(np.zeros(3)), 1, 0)
    found = C._ask(table, 5, [0, 1, 4], 3, 42, {4: tree}, [root])[0]
    want = np.zeros((3, C.BINS, 3))
    for bins, y, rows, block in unpacked(table, 5):
        w = C.drawn(42, 4, block, rows)
        for i in range(len(y)):
            for f, b in enumerate(bins[[0, 1, 4], i]):
                want[f, b, int(y[i])] += w[i]
    assert np.array_equal(found, want)

    def gini(n):
        return n.sum() - (n * n).sum() / n.sum() if n.sum() else 0.0

    gains = [(gini(want[f].sum(0)) - gini(want[f, : b + 1].sum(0)) - gini(want[f, b + 1 :].sum(0)), f, b) for f in range(3) for b in range(C.BINS - 1)]
    best = max(gains)
    gain, f, b, left = C._split(found, np.arange(3))
    assert np.isclose(gain, best[0]) and np.isclose(dict(((f, b), g) for g, f, b in gains)[f, b], best[0])
    assert np.array_equal(left, want[f, : b + 1].sum(0)) and C._split(found, np.array([2])) is None


@pytest.mark.parametrize("trees", [1, 12])
def test_elimination_on_cells_is_that_of_rows(spark, monkeypatch, trees):
    """The path of large tables: no forest on rows, the same order of columns."""
    pdf = frame(6000)
    pdf.loc[:20, "d"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("kind", F.concat(F.lit("t"), F.col("y").cast("int"))).repartition(3)
    cols = ("a", "b", "c", "d")
    want = S.eliminate(df, "kind", cols, model="forest", keep=1, trees=12).collect()
    monkeypatch.setattr(S, "COUNTED", 100)
    monkeypatch.setattr(S, "RandomForestClassifier", None)
    got = S.eliminate(df, "kind", cols, model="forest", keep=1, trees=trees)
    assert got.collect() == want and max(want, key=lambda r: r["rank"])["column"] == "d"
    assert S.eliminate(df, "kind", cols, model="forest", keep=4).where("kept").count() == 4


def test_importances_are_those_of_the_named_forest(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    cols = list("abcde")
    df = spark.createDataFrame(frame(8000)).repartition(2)
    table = C.counted(df, "y", cols)
    fit = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=40, seed=1).fit(VectorAssembler(inputCols=cols, outputCol="x").transform(df))
    found = C.importances(table, 5, range(5), 3, 40)
    assert np.allclose(found, fit.featureImportances.toArray(), atol=0.06) and np.isclose(found.sum(), 1) and found[4] == 0
    assert np.array_equal(found, C.importances(table, 5, range(5), 3, 40))
    assert not C.importances(table, 5, [4], 3, 2).any()


def test_splits_between_leaves_of_one_class_are_taken_back():
    tree = C.T.Growing(2)
    a, b = tree.add(np.array([9.0, 4.0])), tree.add(np.array([1.0, 3.0]))
    tree.split(a, 0, 0, b, tree.add(np.array([8.0, 1.0])), 2.0)
    tree.split(b, 1, 0, tree.add(np.array([0.0, 2.0])), tree.add(np.array([1.0, 1.5])), 0.5)
    assert C._gains(tree, 3).tolist() == [1.0, 0.0, 0.0]


@pytest.mark.parametrize("counted", [False, True])
def test_the_query_grows_the_whole_forest(spark, monkeypatch, tmp_path, counted):
    """The named forest has 100 trees in every round, on rows and on counted cells."""
    from lumenframe.queries import QUERIES
    from lumenframe.queries.selection import RFE

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({c: rng.integers(0, 9, 400).astype(float) for c in RFE}).assign(l_returnflag=rng.choice(["A", "N", "R"], 400))
    spark.createDataFrame(pdf).write.parquet(f"{tmp_path}/lineitem.parquet")
    grown, forest, importances = [], S.RandomForestClassifier, C.importances
    monkeypatch.setattr(S, "RandomForestClassifier", lambda **p: grown.append(p["numTrees"]) or forest(**p))
    monkeypatch.setattr(C, "importances", lambda *a: grown.append(a[4]) or importances(*a))
    if counted:
        monkeypatch.setattr(S, "COUNTED", 100)
    found = QUERIES["fs_rfe_rf"](spark, str(tmp_path)).collect()
    assert grown == [100, 100] and sum(r["kept"] for r in found) == 3 and len(found) == 5
