"""Paths meant for large tables, forced on small ones and compared with brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions.ordering import dense_codes, running_totals, seeded_rank
from lumenframe.functions.stats import exact_quantiles, grouped_quantiles
from lumenframe.metrics import classification, clustering
from lumenframe.models import training as T
from lumenframe.operators import charts, profile
from lumenframe.operators.density import dbscan
from lumenframe.operators.graph import connected_components
from lumenframe.operators.joins import latest_events
from lumenframe.operators.neighbors import nearest
from lumenframe.operators.nulls import _bayesian_ridge, fill_iterative
from lumenframe.operators.outliers import elliptic_envelope
from lumenframe.operators.profile import correlation
from lumenframe.operators.splits import holdout, k_folds, stratified_folds
from lumenframe.plans.recommend import ALGORITHMS
from lumenframe.plans.report import apply_user

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    # A third of all rows share one value and one group.
    pdf = pd.DataFrame({"k": np.arange(3000), "x": rng.normal(size=3000) ** 3, "g": rng.integers(0, 4, 3000).astype(str)})
    pdf.loc[:999, ["x", "g"]] = [7.0, "0"]
    return pdf, spark.createDataFrame(pdf).repartition(6).persist()


@pytest.mark.parametrize("limit", [10, 300, 100000])
def test_quantiles(values, limit):
    pdf, df = values
    got = exact_quantiles(df, ["x", "k"], PROBS, direct_values=limit)
    for c in ("x", "k"):
        np.testing.assert_allclose(got[c], np.quantile(pdf[c], PROBS), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("limit, bucket", [(100000, None), (10, None), (10, 40)])
def test_grouped_quantiles(values, limit, bucket):
    pdf, df = values
    got = {r["g"]: r["q"] for r in grouped_quantiles(df, ["g"], "x", PROBS, direct_values=limit, bucket_rows=bucket).collect()}
    for g, part in pdf.groupby("g"):
        np.testing.assert_allclose(got[g], np.quantile(part["x"], PROBS), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(values, descending):
    pdf, df = values
    rows = df.select("g", "k", F.lit(1).alias("w"))
    got = running_totals(rows, "k", ["w"], ["g"], descending=descending, bucket_rows=100).toPandas()
    want = pdf.sort_values("k", ascending=not descending).groupby("g").cumcount() + 1
    got = got.set_index("k")["cum_w"]
    assert (got.sort_index() == want.sort_index().rename(None).set_axis(pdf["k"].loc[want.sort_index().index])).all()


def test_dense_codes(values):
    pdf, df = values
    codes, distinct, letters = dense_codes(df, "k", bucket_rows=100)
    got = codes.toPandas().set_index("value")["code"].to_dict()
    texts = sorted(pdf["k"].astype(str))
    assert letters == sum(map(len, texts)) and distinct == 3000 and got == {v: i for i, v in enumerate(texts)}


def test_auc_with_buckets(values):
    _, df = values
    a = classification.auc(df, "x", F.col("k") % 3 == 0).first()[0]
    b = classification.auc(df, "x", F.col("k") % 3 == 0, bucket_rows=50).first()[0]
    assert a == pytest.approx(b, abs=1e-12)


def brute(q, d, k, same=False):
    out = {}
    for qk, qx in q:
        dist = sorted((float(np.sqrt(np.sum((qx - dx) ** 2))), dk) for dk, dx in d if not (same and dk == qk))
        out[qk] = dist[:k]
    return out


@pytest.mark.parametrize("ship", [100000, 250, 0])
def test_nearest(spark, ship):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    # A crowd around one point: more than one block in one cell.
    x[:250] = rng.normal(scale=1e-3, size=(250, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(key=np.arange(600)))
    q, d = df.where("key % 2 = 0"), df
    if ship == 250:
        q, d = d, q.limit(200).withColumn("key", F.col("key"))
    got = nearest(q, d, "key", "key", ["a", "b", "c"], 4, exclude_same_key=True, ship_rows=ship, block_rows=40).toPandas()
    qs = [(r["key"], x[r["key"]]) for r in q.select("key").collect()]
    ds = [(r["key"], x[r["key"]]) for r in d.select("key").collect()]
    want = brute(qs, ds, 4, same=True)
    assert len(got) == 4 * len(qs)
    for key, part in got.groupby("query_key"):
        assert part.sort_values("rank")["donor_key"].tolist() == [k for _, k in want[key]]


def test_nearest_blocks_with_gaps(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(300, 2)), columns=["a", "b"]).assign(key=np.arange(300))
    pdf.loc[::5, "a"] = np.nan
    df = spark.createDataFrame(pdf)
    few = nearest(df, df, "key", "key", ["a", "b"], 3, nan_aware=True, exclude_same_key=True).orderBy("query_key", "rank").toPandas()
    many = nearest(df, df, "key", "key", ["a", "b"], 3, nan_aware=True, exclude_same_key=True, ship_rows=0, block_rows=50)
    pd.testing.assert_frame_equal(few, many.orderBy("query_key", "rank").toPandas())


def test_silhouette_blocks(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame(rng.normal(size=(300, 2)), columns=["a", "b"]).assign(key=np.arange(300))
    pdf["c"] = np.where(pdf.key < 200, 0, 1)
    pdf.loc[pdf.c == 1, "a"] += 3
    df = spark.createDataFrame(pdf)
    a = clustering.silhouette(df, "key", "c", ["a", "b"]).first()[0]
    b = clustering.silhouette(df, "key", "c", ["a", "b"], ship_rows=0, block_rows=60).first()[0]
    assert a == pytest.approx(b, abs=1e-12) and a > 0.2


def brute_dbscan(x, eps, need):
    near = [[j for j in range(len(x)) if np.sum((x[i] - x[j]) ** 2) <= eps * eps] for i in range(len(x))]
    core = {i for i in range(len(x)) if len(near[i]) >= need}
    label = {}
    for i in sorted(core):
        if i not in label:
            stack = [i]
            label[i] = i
            while stack:
                for j in near[stack.pop()]:
                    if j in core and j not in label:
                        label[j] = i
                        stack.append(j)
    return {i: label.get(i, min((label[j] for j in near[i] if j in core), default=-1)) for i in range(len(x))}


@pytest.mark.parametrize("direct", [10_000, 3])
def test_dbscan(spark, direct):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(120, 2)), rng.normal(loc=6, size=(60, 2)), rng.uniform(-10, 10, size=(40, 2)), np.full((30, 2), 3.0)])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(key=np.arange(len(x))))
    got = dbscan(df, "key", ["a", "b"], 0.7, 5, direct_pairs=direct).toPandas().set_index("key")["cluster"].to_dict()
    assert got == brute_dbscan(x, 0.7, 5)


def test_components_of_a_chain(spark):
    edges = spark.range(60).where("id % 20 <> 19").selectExpr("id as src", "id + 1 as dst")
    got = connected_components(spark.range(61).withColumnRenamed("id", "node"), edges).toPandas().set_index("node")["component"]
    assert all(got[i] == (i // 20) * 20 for i in range(60)) and got[60] == 60


def test_iterative_fill(spark):
    """The same rounds done row by row."""
    rng = np.random.default_rng(6)
    a = rng.normal(size=200)
    x = np.column_stack([a, 2 * a + rng.normal(scale=0.1, size=200), rng.normal(size=200) - a])
    gaps = rng.random(x.shape) < 0.15
    gaps[:, 2] &= ~gaps[:, 0]
    held = np.where(gaps, np.nan, x)
    pdf = pd.DataFrame(held, columns=["a", "b", "c"]).assign(key=np.arange(200))
    got = fill_iterative(spark.createDataFrame(pdf), ["a", "b", "c"]).orderBy("key").toPandas()[["a", "b", "c"]].to_numpy()
    filled = np.where(gaps, np.nanmean(held, axis=0), held)
    order = np.argsort(gaps.sum(axis=0), kind="stable")
    for _ in range(10):
        for c in order:
            others = [i for i in range(3) if i != c]
            rows = ~gaps[:, c]
            xs, y = filled[rows][:, others], held[rows, c]
            mx, my = xs.mean(axis=0), y.mean()
            w = _bayesian_ridge((xs - mx).T @ (xs - mx), (xs - mx).T @ (y - my), ((y - my) ** 2).sum(), len(y))
            filled[gaps[:, c], c] = my + (filled[gaps[:, c]][:, others] - mx) @ w
    np.testing.assert_allclose(got, filled, rtol=1e-6, atol=1e-6)


def test_split_sizes(values):
    pdf, df = values
    assert holdout(df, "k", 0.2).where("is_test").count() == 600
    by = holdout(df, "k", 0.1, by="g").groupBy("g").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect()
    assert sum(r["t"] for r in by) == 300 and all(abs(r["t"] - r["n"] * 0.1) < 1 for r in by)
    sizes = [r["count"] for r in k_folds(df, "k", 7).groupBy("fold").count().collect()]
    assert sorted(sizes) == sorted([429] * 4 + [428] * 3)
    strata = stratified_folds(df, "k", "g", 5).groupBy("g", "fold").count().toPandas()
    assert strata.groupby("g")["count"].agg(lambda s: s.max() - s.min()).max() <= 1
    ranks = seeded_rank(df, "k", 42, "g").groupBy("g").agg(F.max("rank").alias("m"), F.count_distinct("rank").alias("d"), F.count("*").alias("n"))
    assert all(r["m"] == r["d"] == r["n"] for r in ranks.collect())


def test_status_events_keep_last_given(spark):
    rows = [(1, 1, "a", None), (1, 2, None, 5), (1, 3, "b", None), (2, 9, None, None)]
    df = spark.createDataFrame(rows, "k int, t int, s string, v int")
    got = {r["k"]: (r["s"], r["v"]) for r in latest_events(df, "k", ["t"], ["s", "v"]).collect()}
    assert got == {1: ("b", 5), 2: (None, None)}


GAPPED = [("a", 1.0), ("a", None), ("a", float("nan")), ("a", 3.0), ("b", None), (None, 2.0), (None, 5.0), ("b", None)]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_with_gaps(spark, descending):
    """Null and NaN come last, whichever way the rows are ordered and however many there are."""
    rows = [(k, float(k) if k < 40 else None if k == 40 else float("nan"), 1) for k in range(42)]
    df = spark.createDataFrame(rows[:41], "k int, x double, w int").union(spark.createDataFrame([], "k int, x double, w int"))
    got = [sorted((r.k, r.cum_w) for r in running_totals(df, "x", ["w"], descending=descending, bucket_rows=b).collect()) for b in (None, 5)]
    assert got[0] == got[1] and dict(got[0])[40] == 41 and len(got[0]) == 41
    nan = spark.createDataFrame([rows[1], rows[41], rows[7]], "k int, x double, w int")
    for b in (None, 1):
        assert {r.k: r.cum_w for r in running_totals(nan, "x", ["w"], descending=descending, bucket_rows=b).collect()}[41] == 3


def test_grouped_quantiles_with_gaps(spark):
    df = spark.createDataFrame(GAPPED, "g string, x double")
    want = {"a": [2.0], "b": None, None: [3.5]}
    for limit, bucket in ((None, None), (1, None), (1, 2)):
        assert {r.g: r.q for r in grouped_quantiles(df, ["g"], "x", (0.5,), direct_values=limit, bucket_rows=bucket).collect()} == want


def test_curves_with_missing_scores(spark):
    rows = [(None, True), (0.2, True), (float("nan"), False), (0.9, True), (0.5, False), (0.2, False)] * 3
    df = spark.createDataFrame(rows, "s double, y boolean")
    for f in (classification.auc, classification.average_precision, classification.roc, classification.precision_recall):
        one, two = (sorted(map(str, f(df, "s", F.col("y"), bucket_rows=b).collect())) for b in (None, 1))
        assert one == two
    assert classification.roc(df, "s", F.col("y")).agg(F.max("tpr"), F.max("fpr")).first() == (1.0, 1.0)


def test_boxes_with_gaps(spark):
    df = spark.createDataFrame(GAPPED, "g string, x double")
    assert {r.g: r.median for r in charts.box(df, "x", ["g"]).collect()} == {"a": 2.0, None: 3.5}
    none = spark.createDataFrame([("a", None)], "g string, x double")
    assert charts.density(none, "x").collect() == [] and charts.violin(none, "x").collect() == []


def test_density_of_three_columns(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.2, (50, 3)), rng.normal(4, 0.2, (50, 3))])
    rows = [(i, *map(float, p)) for i, p in enumerate(x)] + [(100, None, 0.0, 0.0), (101, float("nan"), 0.0, 0.0)]
    got = {r.key: r.cluster for r in dbscan(spark.createDataFrame(rows, "k long, a double, b double, c double"), "k", ["a", "b", "c"], 0.6, 4).collect()}
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= 0.36
    core = near.sum(1) >= 4
    assert len(got) == 102 and got[100] == got[101] == -1
    for i in range(100):
        for j in range(100):
            if core[i] and core[j] and near[i, j]:
                assert got[i] == got[j] >= 0


def test_ellipse_keeps_rows_with_gaps(spark):
    rng = np.random.default_rng(6)
    rows = [(i, *map(float, rng.normal(size=2))) for i in range(80)] + [(80, None, 0.0), (81, 50.0, 50.0)]
    kept = {r.k for r in elliptic_envelope(spark.createDataFrame(rows, "k long, a double, b double"), ["a", "b"]).collect()}
    assert 80 in kept and 81 not in kept


def test_correlation_with_gaps(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame(rng.normal(size=(300, 4)) + 1e6, columns=list("abcd"))
    pdf["b"] += 2 * pdf["a"]
    pdf["d"] = 5.0
    pdf[rng.random((300, 4)) < 0.2] = np.nan
    want = pdf.corr()
    for r in correlation(spark.createDataFrame(pdf)).collect():
        assert r["corr"] is None if "d" in (r.row, r.col) else r["corr"] == pytest.approx(want.loc[r.row, r.col], abs=1e-7)


def test_missing_numbers_count_as_missing(spark):
    df = spark.createDataFrame([(1, float("nan"), "x"), (2, 1.0, None)], "k int, v double, s string")
    assert {r.column: r.missing for r in profile.column_info(df).collect()} == {"k": 0, "v": 1, "s": 1}
    assert {r.column: r.non_null for r in profile.data_info(df).collect()} == {"k": 2, "v": 1, "s": 1}
    assert profile.dataset_info(df.drop("s")).first().has_missing


def test_user_step_leaves_views_alone(spark):
    spark.createDataFrame([(7,)], "x int").createOrReplaceTempView("df")
    out = apply_user(spark.createDataFrame([(1,), (2,)], "x int"), "SELECT sum(x) AS s FROM df")
    assert out.first().s == 3 and spark.table("df").first().x == 7
    spark.catalog.dropTempView("df")


SPLIT_NAMES = [(task.lower(), name) for task, names in ALGORITHMS.items() for name in names] + [("clustering", "DBSCAN")]


@pytest.mark.parametrize("task, name", SPLIT_NAMES)
def test_every_offered_algorithm(spark, tmp_path, task, name):
    """Each trains, is saved and loaded, and predicts one value per row, also where features are missing."""
    rng = np.random.default_rng(8)
    rows = [(i, float(x), float(y), "AB"[i % 2], ("low", "mid", "high")[int(np.clip(x + 1.5, 0, 2.9))], float(2 * x + y))
            for i, (x, y) in enumerate(rng.normal(size=(90, 2)))]
    df = spark.createDataFrame(rows, "k long, x double, y double, t string, kind string, value double")
    target = {"classification": "kind", "regression": "value"}.get(task)
    features = ("x", "y") if task == "clustering" else ("x", "y", "t")
    params = {"n_estimators": 3, "max_depth": 3, "n_clusters": 2, "n_neighbors": 3, "eps": 1.0}
    config = T.TrainingConfig(task, name, "k", target, features, params)
    result = T.train(df, config)
    assert result.metrics and result.test.count() > 0
    if name == "DBSCAN":
        with pytest.raises(ValueError):
            T.save(result.prepare, result.model, str(tmp_path / "m"))
        return
    T.save(result.prepare, result.model, str(tmp_path / "m"))
    gaps = df.drop("kind", "value").withColumn("x", F.when(F.col("k") % 9 > 0, F.col("x")))
    got = T.predict_batch(gaps, str(tmp_path / "m"), config)
    assert got.count() == 90 and got.where("prediction is null").count() == 0
    if task == "classification":
        assert {r[0] for r in got.select("predicted_class").distinct().collect()} <= {"low", "mid", "high"}


def test_unseen_class_counts_as_wrong(spark):
    rows = [(i, float(i % 5), "new" if i == 3 else "ab"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, x double, c string")
    config = T.TrainingConfig("classification", "Decision Tree Classifier", "k", "c", ("x",), {"max_depth": 2})
    data = T.shaped(df, config)
    prepare, model, _ = T.fit(data.where("k <> 3"), config)
    test = model.transform(prepare.transform(data.where("k < 10")))
    assert test.count() == 10 and test.where("label <> prediction").where("k = 3").count() == 1


def test_inverse_normal_is_that_of_python():
    from statistics import NormalDist

    from lumenframe.operators.scale import inverse_normal

    p = np.concatenate([[1e-7, 1 - 1e-7, 0.075, 0.925, 0.5], np.logspace(-15, -0.31, 200), np.random.default_rng(0).random(500)])
    assert np.allclose(inverse_normal(p), [NormalDist().inv_cdf(v) for v in p], rtol=1e-13, atol=1e-13)


@pytest.mark.parametrize("limit", [None, 10])
def test_grid_of_quantiles_is_one_narrow_pass(spark, monkeypatch, limit):
    """A grid of 1,000 quantiles is read off the ranks, not off 2,000 aggregates of every value."""
    from lumenframe.functions import stats

    def refused(*_, **__):
        raise AssertionError("an aggregate for each quantile")

    monkeypatch.setattr(stats, "grouped_quantiles", refused)
    if limit is None:
        monkeypatch.setattr(stats, "DIRECT_VALUES", 10)
    x = np.round(np.random.default_rng(3).normal(size=900), 2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(3)
    grid = np.linspace(0, 1, 333)
    assert np.allclose(exact_quantiles(df, ["x"], list(grid), direct_values=limit)["x"], np.quantile(x, grid))


def test_isolation_scores_are_computed_once(spark, monkeypatch, tmp_path):
    """Quantile passes and the filter read written scores; no pass walks the trees again."""
    from lumenframe.operators import outliers

    seen = []
    quantiles = outliers.exact_quantiles

    def watched(df, *rest):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return quantiles(df, *rest)

    monkeypatch.setattr(outliers, "exact_quantiles", watched)
    x = np.random.default_rng(1).normal(size=(400, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, a double, b double")
    kept = outliers.isolation_forest(df, "k", ["a", "b"])
    assert kept.count() == 380 and kept.columns == ["k", "a", "b"]
    assert seen and "ArrowEvalPython" not in seen[0]


@pytest.mark.parametrize("ship", [None, 10])
def test_silhouette_of_wide_rows(spark, ship):
    """Distances of wide rows come from a matrix product; near rows far from zero are still measured exactly."""
    rng = np.random.default_rng(2)
    x = 1e5 + np.concatenate([rng.normal(size=(40, 12)), 3 + rng.normal(size=(30, 12)) * 1e-5, np.zeros((20, 12))])
    c = np.repeat([0, 1, 2], [40, 30, 20])
    df = spark.createDataFrame([(i, int(k), [float(v) for v in r]) for i, (k, r) in enumerate(zip(c, x))], "id long, c long, x array<double>")
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = []
    for i in range(len(x)):
        a = dist[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(dist[i, c == k].mean() for k in range(3) if k != c[i])
        want.append((b - a) / max(a, b))
    got = {r["key"]: r["silhouette"] for r in clustering.silhouette_rows(df, "id", "c", "x", ship_rows=ship, block_rows=25).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want, atol=1e-9)
    same = df.withColumn("x", F.expr("transform(x, v -> 100000.1)"))
    assert {r["silhouette"] for r in clustering.silhouette_rows(same, "id", "c", "x", ship_rows=ship, block_rows=25).collect()} == {0.0}


def test_silhouette_is_not_taken_feature_by_feature():
    """Twelve times the features must not cost twelve times the passes over all pairs."""
    import time

    rng = np.random.default_rng(0)
    x, labels = rng.normal(size=(3000, 192)), rng.integers(0, 5, 3000)
    seconds = []
    for width in (16, 192):
        start = time.process_time()
        clustering._distance_sums(np.arange(3000), x[:, :width].copy(), x[:, :width].copy(), labels)
        seconds.append(time.process_time() - start)
    assert seconds[1] < 6 * seconds[0]


def test_term_weights_send_texts_once(spark):
    """One shuffle by key serves counts and norms; terms with their counts are shipped."""
    from lumenframe.operators.encode import tf_idf

    rows = [(1, "one two two"), (2, "two three"), (2, "two four"), (None, "one"), (3, None)]
    out = tf_idf(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1
    weights = {(r["k"], r["term"]): r["weight"] for r in out.collect()}
    df = {"one": 2, "two": 2, "three": 1, "four": 1}
    for key, counts in ((1, {"one": 1, "two": 2}), (2, {"two": 2, "three": 1, "four": 1}), (None, {"one": 1})):
        raw = {t: n * (np.log(6 / (1 + df[t])) + 1) for t, n in counts.items()}
        norm = np.sqrt(sum(v * v for v in raw.values()))
        assert all(abs(weights.pop((key, t)) - v / norm) < 1e-12 for t, v in raw.items())
    assert not weights


def test_marking_rows_leaves_them_where_they_are(spark):
    from lumenframe.operators.splits import holdout

    rows = spark.range(4000).withColumn("c", F.when(F.col("id") % 10 == 0, "a").otherwise("b")).repartition(8)
    marked = holdout(rows, "id", 0.25, by="c").withColumn("p", F.spark_partition_id()).persist()
    sizes = [r["count"] for r in marked.groupBy("p").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000  # not one task per class
    got = {r.c: (r.t, r.n) for r in marked.groupBy("c").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect()}
    marked.unpersist()
    assert got == {"a": (100, 400), "b": (900, 3600)}


def test_silhouette_copies_no_row(spark, monkeypatch):
    """Blocks of all rows meet without a shuffle of copies; rows without a key count for the others only."""
    from lumenframe.operators import tiles

    rng = np.random.default_rng(12)
    x, c = rng.normal(size=(300, 10)), rng.integers(0, 4, 300) + 2**60
    keys = [None if i % 50 == 3 else i for i in range(300)]
    df = spark.createDataFrame([(k, int(g), [float(v) for v in r]) for k, g, r in zip(keys, c, x.tolist())], "id long, c long, x array<double>").repartition(3)
    sent, packed = [], tiles.packed
    monkeypatch.setattr(tiles, "packed", lambda rows, *a: sent.append(rows.count()) or packed(rows, *a))
    got = {r["key"]: r["silhouette"] for r in clustering.silhouette_rows(df, "id", "c", "x", ship_rows=0, block_rows=40).collect()}
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(300):
        if keys[i] is not None:
            a = gap[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
            b = min(gap[i, c == g].mean() for g in set(c) - {c[i]})
            assert abs(got[i] - (b - a) / max(a, b)) < 1e-9
    assert len(got) == 294 and sent == [294, 300]
