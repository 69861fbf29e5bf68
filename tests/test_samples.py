"""Small samples with answers worked out by hand."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import text as X
from lumenframe.models import boost
from lumenframe.operators import encode, nulls, outliers, project, scale
from lumenframe.plans import clean as C
from lumenframe.plans.report import apply_user
from lumenframe.sources import readers as R
from lumenframe.sources import writers as W


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame([(1.0, None, 1.0), (2.0, 2.0, None), (None, 3.0, None), (4.0, 4.0, 4.0)], "A double, B double, C double")


@pytest.fixture(scope="module")
def spikes(spark):
    return spark.createDataFrame([(10, 20, 1), (12, 22, 2), (14, 23, 3), (15, 24, 4), (1000, -999, 5)], "A long, B long, C long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_nulls(gaps):
    assert rows(nulls.handle(gaps, nulls.DROP_ROWS)) == [(4.0, 4.0, 4.0)]
    assert nulls.handle(gaps, nulls.DROP_COLUMNS).columns == []
    mean = nulls.handle(gaps, nulls.MEAN).collect()
    assert mean[2]["A"] == pytest.approx(7 / 3) and mean[0]["B"] == 3.0 and mean[1]["C"] == 2.5
    assert nulls.handle(gaps, nulls.MOST_FREQUENT).collect()[2]["A"] == 1.0
    with pytest.raises(ValueError):
        nulls.handle(gaps, "Guess")
    with pytest.raises(ValueError):
        nulls.apply_rules(gaps, {"A": "Guess"})
    assert nulls.apply_rules(gaps, {"Z": nulls.MEAN, "A": nulls.DROP_ROWS}).count() == 3


def test_outliers(spikes):
    assert outliers.iqr(spikes).count() == 4
    assert outliers.zscore(spikes).count() == 5
    masked = outliers.iqr(spikes, mode="mask").collect()[-1]
    assert masked["A"] is None and masked["B"] is None and masked["C"] == 5


def test_null_fails_zscore_but_passes_fence(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    assert outliers.zscore(df).count() == 3
    assert outliers.iqr(df).count() == 4


def test_norms(spark):
    df = spark.createDataFrame([(1, 2), (0, 0)], "a long, b long")
    assert rows(scale.normalize_rows(df, "l1")) == [(0.0, 0.0), (1 / 3, 2 / 3)]
    assert rows(scale.normalize_rows(df, "l2"))[1] == pytest.approx((1 / math.sqrt(5), 2 / math.sqrt(5)))
    assert rows(scale.normalize_rows(df, "max")) == [(0.0, 0.0), (0.5, 1.0)]


def test_scalers(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": np.arange(1.0, 101.0), "one": 5.0}))
    s = scale.standard(df).agg(F.avg("x"), F.stddev_pop("x"), F.max("one")).first()
    assert s[0] == pytest.approx(0, abs=1e-12) and s[1] == pytest.approx(1) and s[2] == 0
    m = scale.min_max(df).agg(F.min("x"), F.max("x"), F.max("one")).first()
    assert tuple(m) == (0.0, 1.0, 0.0)
    q = scale.quantile(df, ["x"]).agg(F.min("x"), F.max("x"), F.avg("x")).first()
    assert tuple(q) == pytest.approx((0.0, 1.0, 0.5))
    with pytest.raises(ValueError):
        scale.box_cox(df.withColumn("x", F.col("x") - 1), ["x"])


def test_power_is_most_likely(spark):
    rng = np.random.default_rng(0)
    x = np.exp(rng.normal(size=500)) - 0.5
    found = scale._best_powers(
        spark.createDataFrame(pd.DataFrame({"x": x})), ["x"], scale.yeo_johnson_value, lambda c: F.signum(c) * F.log1p(F.abs(c))
    )["x"]

    def likelihood(p):
        up = ((x + 1) ** p - 1) / p if p else np.log1p(x)
        down = -((1 - x) ** (2 - p) - 1) / (2 - p) if p != 2 else -np.log1p(-x)
        with np.errstate(invalid="ignore"):
            y = np.where(x >= 0, up, down)
        return -len(x) / 2 * np.log(y.var()) + (p - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))

    with np.errstate(invalid="ignore"):
        best = max(np.linspace(found - 0.5, found + 0.5, 1001), key=likelihood)
    assert found == pytest.approx(best, abs=2e-3)


def test_labels(spark):
    df = spark.createDataFrame([("cat",), ("dog",), ("dog",), ("cat",), ("mouse",), (None,)], "label string")
    assert [r[0] for r in encode.label(df).orderBy("label").collect()] == [0, 0, 1, 1, 2, 3]
    assert sorted(r[0] for r in encode.category_codes(df).collect()) == [-1, 0, 0, 1, 1, 2]
    assert encode.one_hot(spark.createDataFrame([("red",), ("blue",)], "color string")).columns == ["color_blue", "color_red"]


def test_terms(spark):
    df = spark.createDataFrame([(1, "I love AI"), (2, "AI is great")], "id int, text string")
    assert rows(encode.term_counts(df, "id", "text")) == [(1, "ai", 1), (1, "love", 1), (2, "ai", 1), (2, "great", 1), (2, "is", 1)]
    weights = encode.tf_idf(df, "id", "text").groupBy("id").agg(F.sum(F.col("weight") ** 2)).collect()
    assert all(w[1] == pytest.approx(1.0) for w in weights)


def test_zero_fill(spark):
    df = spark.createDataFrame([(float("nan"), None), (float("inf"), "a")], "x double, s string")
    assert rows(project.fill_zero(project.replace_infinite(df))) == [(0.0, "0"), (0.0, "a")]


@pytest.mark.parametrize(
    "raw, want",
    [
        ('so {"a": {"b": None}} }', '{"a": {"b": null}}'),
        ("none", None),
        ("{open", None),
        ("{not json}", None),
        ('```json\n{"x": True}\n```', '{"x": true}'),
        (None, None),
    ],
)
def test_first_json(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(X.first_json(F.col("t"))).first()[0] == want


def test_code_block(spark):
    texts = ["a ```python\nx = 1\n``` b", "```\ny\n```", "words\nimport os\nz", "words"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.code_block(F.col("t"))).collect()] == ["x = 1", "y", "import os\nz", None]


def test_sheet_round_trip(spark, tmp_path):
    rows = [(1, 'x "<&>" y', 1.5), (2, None, 2.25), (3, "a,b", None)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    W.write(df, str(tmp_path / "s"), "excel")
    assert sorted(tuple(r) for r in R.read_sheet(spark, str(tmp_path / "s"), df.schema).collect()) == rows
    with pytest.raises(ValueError):
        R.load(spark, "x.xlsx", "xlsx")


def test_clean_order_and_defaults(spark):
    df = spark.createDataFrame([(1, "b", 3.0, 1.0), (2, "a", None, 0.0), (3, "a", 5.0, 1.0)], "id int, s string, x double, y double")
    out = C.clean(df, C.from_choices({"key": "id", "target": "y", "nulls": "nonsense"}))
    assert out.columns == df.columns and out.count() == 3
    assert {r["y"] for r in out.collect()} == {0.0, 1.0}
    assert C.from_choices({"scaling": "nonsense"}).scaling == "Standard Scaler"


def test_user_step_must_give_a_table(spark):
    df = spark.range(5)
    assert apply_user(df, "SELECT id * 2 AS x FROM df").count() == 5
    with pytest.raises(TypeError):
        apply_user(df, lambda d: 1)


def test_boosting_beats_one_stump(spark):
    from pyspark.ml.feature import VectorAssembler

    rng = np.random.default_rng(7)
    x = rng.uniform(-1, 1, size=(600, 2))
    pdf = pd.DataFrame(x, columns=["a", "b"]).assign(label=((x[:, 0] > 0.2) | (x[:, 1] > 0.5)).astype(float))
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(pdf))
    share = lambda m: m.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert share(boost.fit_classifier(df, 2, rounds=10)) > share(boost.fit_classifier(df, 2, rounds=1))


def test_ellipse_and_forest_find_far_rows(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(400, 2)), np.full((10, 2), 12.0) + rng.normal(size=(10, 2))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(k=np.arange(410)))
    for kept in (outliers.elliptic_envelope(df, ["a", "b"]), outliers.isolation_forest(df, "k", ["a", "b"])):
        assert kept.where("k >= 400").count() == 0 and 380 <= kept.count() <= 392


def test_table_without_numbers(spark):
    from lumenframe.operators import profile

    df = spark.createDataFrame([("a",), ("a",), (None,)], "s string")
    for out in (profile.describe_numeric(df), profile.correlation(df), profile.outlier_counts(df), profile.skew_kurtosis(df)):
        assert out.count() == 0
    top = profile.describe_categorical(df).first()
    assert (top["count"], top["unique"], top["top"], top["freq"]) == (2, 1, "a", 2)
    q = profile.quality(df).first()
    assert (q["nulls"], q["duplicates"]) == (1, 1)
    assert {r["insight"] for r in profile.insights(df).collect()} == {"most_missing", "constant"}


def test_column_of_nulls(spark):
    from lumenframe.operators import profile

    df = spark.createDataFrame([(1.0, None), (3.0, None)], "x double, y double")
    got = {(r["column"], r["stat"]): r["value"] for r in profile.describe_numeric(df).collect()}
    assert got["x", "median"] == 2.0 and got["y", "count"] == 0.0 and got["y", "median"] is None
    assert outliers.iqr(df).count() == 2
