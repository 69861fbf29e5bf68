"""Model queries. Each trains on the whole table minus its test share and returns metric rows."""

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from lumenframe.models import forest as T
from lumenframe.models import histogram as H
from lumenframe.models import neighbors as NB
from lumenframe.models import training as M
from lumenframe.models.training import TrainingConfig
from lumenframe.operators.density import dbscan
from lumenframe.operators.splits import holdout
from lumenframe.queries.registry import query, r, rounded, sr
from lumenframe.session import scratch_path

ORDER_COLS = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"]


def orders(t):
    """Orders with a class that price and priority explain, and a value that price explains."""
    return t.orders.select(
        *ORDER_COLS,
        F.expr("case when o_totalprice > 300000 then 'large' when o_orderpriority < '3' then 'urgent' else 'plain' end").alias("kind"),
        (F.col("o_totalprice") > 250000).cast("int").alias("big"),
        (F.col("o_totalprice") / 1000 + F.col("o_custkey") % 7).alias("effort"),
    )


FEATURES = ("o_totalprice", "o_orderpriority", "o_custkey")


def classify(algorithm, target="kind", **params):
    return TrainingConfig("classification", algorithm, "o_orderkey", target, FEATURES, params)


def regress(algorithm, **params):
    return TrainingConfig("regression", algorithm, "o_orderkey", "effort", FEATURES, params)


def trained(t, config):
    result = M.train(orders(t), config)
    return rounded(M.metric_rows(t.spark, config.algorithm, result.metrics))


MODELS = {
    "ml_logreg": classify("Logistic Regression", max_iter=50),
    "ml_ridge": regress("Ridge", alpha=1.0),
    "ml_lasso": regress("Lasso", alpha=0.1),
    "ml_elasticnet": regress("ElasticNet", alpha=0.1),
    "ml_dt_cls": classify("Decision Tree Classifier", max_depth=5),
    "ml_dt_reg": regress("Decision Tree Regressor", max_depth=5),
    "ml_rf_cls": classify("Random Forest Classifier", n_estimators=20, max_depth=5),
    "ml_rf_reg": regress("Random Forest Regressor", n_estimators=20, max_depth=5),
    "ml_gbt_cls": classify("Gradient Boosting Classifier", n_estimators=5),
    "ml_gbt_reg": regress("Gradient Boosting Regressor", n_estimators=10),
    "ml_ada_cls": classify("AdaBoost Classifier", n_estimators=8),
    "ml_ada_reg": regress("AdaBoost Regressor", n_estimators=8),
    "ml_svc": classify("Support Vector Classifier", max_iter=20),
    "ml_svr": regress("Support Vector Regressor"),
    "ml_xgb_lgbm": classify("XGBoost", target="big", n_estimators=5),
}

for _name, _config in MODELS.items():

    @query(_name)
    def _(t, _config=_config):
        return trained(t, _config)


@query("ml_xgb_gains", f"""
WITH cells AS (SELECT CASE WHEN l_linenumber < 7 THEN l_quantity END AS x, l_extendedprice / 100000 AS y FROM lineitem),
g AS (SELECT x, sum((SELECT avg(y) FROM cells) - y) AS g, count(*) AS n FROM cells GROUP BY x),
total AS (SELECT sum(g) AS tg, sum(n) AS tn, sum(g) FILTER (x IS NULL) AS gg, sum(n) FILTER (x IS NULL) AS gn, max(x) AS most FROM g),
seen AS (SELECT x, sum(g) OVER (ORDER BY x) AS gl, sum(n) OVER (ORDER BY x) AS nl FROM g WHERE x IS NOT NULL),
sides AS (SELECT x, s.missing_left, gl + CASE WHEN s.missing_left THEN gg ELSE 0 END AS gl, nl + CASE WHEN s.missing_left THEN gn ELSE 0 END AS nl, tg, tn
 FROM seen, total, (VALUES (true), (false)) s(missing_left) WHERE x < most)
SELECT x::DOUBLE AS threshold, missing_left, {sr('0.5 * (gl * gl / (nl + 1) + (tg - gl) * (tg - gl) / (tn - nl + 1) - tg * tg / (tn + 1))', 4)} AS gain FROM sides""")
def _(t):
    """Gain of every split of the first node of a regression on one column with gaps, missing values on either side."""
    x = F.expr("case when l_linenumber < 7 then l_quantity end")
    rows = t.lineitem.select(F.array(x.cast("double")).alias("features"), (F.col("l_extendedprice") / 100000).alias("label"))
    found = H.first_gains(rows, 0, H.settings("XGBoost", {}))
    return found.select("threshold", "missing_left", r("gain", 4).alias("gain"))


BANDS = "CASE WHEN o_totalprice > 300000 THEN 0 WHEN o_orderpriority < '3' THEN 1 ELSE 2 END"


@query("ml_gbt_round", f"""
WITH cells AS (SELECT floor(o_totalprice / 10000) AS x, {BANDS} AS y FROM orders),
share AS (SELECT k, (SELECT count(*) FROM cells WHERE y = k) / (SELECT count(*) FROM cells)::DOUBLE AS p FROM range(3) c(k)),
g AS (SELECT k, p, x, sum(p - (y = k)::INT) AS g, count(*) AS n FROM cells, share GROUP BY k, p, x),
seen AS (SELECT k, p, x, sum(g) OVER (PARTITION BY k ORDER BY x) AS gl, sum(n) OVER (PARTITION BY k ORDER BY x) AS nl, sum(g) OVER (PARTITION BY k) AS tg,
  sum(n) OVER (PARTITION BY k) AS tn FROM g),
best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY gl * gl / nl + (tg - gl) * (tg - gl) / (tn - nl) DESC, x) AS place FROM seen WHERE nl < tn)
SELECT k::INTEGER AS class, x::DOUBLE AS threshold, {sr('-0.1 * gl / (1.5 * p * (1 - p) * nl)')} AS left_value,
  {sr('-0.1 * (tg - gl) / (1.5 * p * (1 - p) * (tn - nl))')} AS right_value FROM best WHERE place = 1""")
def _(t):
    """The trees of one round over three classes: best split by least squares, Newton steps in the leaves."""
    rows = t.orders.select(F.array(F.floor(F.col("o_totalprice") / 10000).cast("double")).alias("features"), F.expr(BANDS).cast("double").alias("label"))
    model = H.fit(rows, 3, H.Settings(rounds=1, max_depth=1, by_rows=True))
    out = [(k, float(tree.threshold[0]), *(float(tree.value[x[0]]) for x in (tree.left, tree.right))) for k, tree in enumerate(model.rounds[0])]
    return rounded(t.spark.createDataFrame(out, "class int, threshold double, left_value double, right_value double"))


@query("ml_tree_split", f"""
WITH cells AS (SELECT floor(o_totalprice / 10000) AS x, {BANDS} AS y FROM orders),
n AS (SELECT x, k, count(*) FILTER (y = k) AS n FROM cells, range(3) c(k) GROUP BY x, k),
seen AS (SELECT x, k, sum(n) OVER (PARTITION BY k ORDER BY x) AS l, sum(n) OVER (PARTITION BY k) AS t FROM n),
gains AS (SELECT x, sum(l * l) / sum(l) + sum((t - l) * (t - l)) / sum(t - l) AS gain, list(l / (SELECT sum(s.l) FROM seen s WHERE s.x = seen.x) ORDER BY k) AS shares
 FROM seen GROUP BY x HAVING sum(t - l) > 0),
best AS (SELECT x, shares FROM gains ORDER BY gain DESC, x LIMIT 1)
SELECT 'halfway' AS source, (x + (SELECT min(c.x) FROM cells c WHERE c.x > best.x)) / 2 AS threshold, {sr('shares[1]')} AS left_0, {sr('shares[2]')} AS left_1 FROM best
UNION ALL SELECT 'bin', (x + (SELECT min(c.x) FROM cells c WHERE c.x > best.x)) / 2, {sr('shares[1]')}, {sr('shares[2]')} FROM best""")
def _(t):
    """The first split of a tree over three classes, once finished in a task and once from sums over the cluster."""
    rows = t.orders.select(F.array(F.floor(F.col("o_totalprice") / 10000).cast("double")).alias("features"), F.expr(BANDS).cast("double").alias("label"))
    out = []
    for name, limit in (("halfway", T.LIMIT), ("bin", 50)):
        tree, shares = T.fit(rows, 3, T.Settings(max_depth=1, limit=max(limit, 2))).trees[0]
        out.append((name, float(tree.threshold[0]), *(float(v) for v in shares[tree.left[0]][:2])))
    return rounded(t.spark.createDataFrame(out, "source string, threshold double, left_0 double, left_1 double"))


@query("ml_linreg", f"""
SELECT {sr('regr_slope(l_extendedprice, l_quantity)', 3)} AS slope, {sr('regr_intercept(l_extendedprice, l_quantity)', 3)} AS intercept FROM lineitem""")
def _(t):
    from lumenframe.models.estimators import estimator

    table = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(
        t.lineitem.select("l_quantity", F.col("l_extendedprice").alias("label")))
    fit = estimator("regression", "Linear Regression").fit(table)
    found = t.spark.createDataFrame([(float(fit.coefficients[0]), float(fit.intercept))], "slope double, intercept double")
    return rounded(found, 3)


GNB = ["l_quantity", "l_extendedprice", "l_discount"]


@query("ml_gnb", " UNION ALL ".join(
    f"SELECT l_returnflag, count(*) AS n, '{c}' AS \"column\", {sr(f'avg({c})', 4)} AS mean, {sr(f'var_pop({c})', 2)} AS var FROM lineitem GROUP BY l_returnflag" for c in GNB))
def _(t):
    out = M.gaussian_parameters(t.lineitem, "l_returnflag", GNB)
    return out.select("l_returnflag", "n", "column", r("mean", 4).alias("mean"), r("var", 2).alias("var"))


@query("ml_gnb_fit")
def _(t):
    return trained(t, classify("Gaussian Naive Bayes"))


SQUARES = "list_sum([(x[1] - x[2]) * (x[1] - x[2]) for x in list_zip(q.embedding::double[], d.embedding::double[])])"
SPLIT = """WITH s AS (SELECT vec_id, embedding, label, row_number() OVER (ORDER BY md5(concat(vec_id::varchar, '|42'))) <=
 ceil(0.2 * (SELECT count(*) FROM embeddings)) AS is_test FROM embeddings)"""
NEAR = SPLIT + f""", n AS (SELECT q.vec_id, d.label, d.vec_id AS donor, sqrt({SQUARES}) AS dist FROM s q JOIN s d ON q.is_test AND NOT d.is_test),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, donor) AS rn FROM n) WHERE rn <= 5)
"""


def neighbours(t, predict):
    marked = holdout(t.embeddings, "vec_id").persist()
    return predict(marked.where(~F.col("is_test")), marked.where("is_test"), "vec_id", "embedding", "label", 5)


@query("ml_knn_cls", NEAR + """SELECT vec_id, label::double AS prediction FROM (SELECT vec_id, label, row_number() OVER
 (PARTITION BY vec_id ORDER BY count(*) DESC, label) AS place FROM k GROUP BY vec_id, label) WHERE place = 1""")
def _(t):
    return neighbours(t, NB.predict_class)


@query("ml_knn_reg", NEAR + f"SELECT vec_id, {sr('avg(label)')} AS prediction FROM k GROUP BY vec_id")
def _(t):
    return rounded(neighbours(t, NB.predict_value))


@query("ml_kmeans")
def _(t):
    config = TrainingConfig("clustering", "KMeans Clustering", "vec_id", None, ("embedding",), {"n_clusters": 10}, scale=False)
    result = M.train(t.embeddings, config)
    return rounded(M.metric_rows(t.spark, "KMeans Clustering", result.metrics))


# Parts by size and price; a part has about two others within the radius.
RADIUS, NEED = 1.5, 4
WITHIN = "(a.p_size - b.p_size) * (a.p_size - b.p_size) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice) <= 2.25"


@query("ml_dbscan", f"""
WITH RECURSIVE pairs AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON {WITHIN}),
core AS (SELECT a AS k FROM pairs GROUP BY a HAVING count(*) >= {NEED}),
edge AS (SELECT a, b FROM pairs WHERE a IN (SELECT k FROM core) AND b IN (SELECT k FROM core)),
reach(root, k) AS (SELECT k, k FROM core UNION SELECT r.root, e.b FROM reach r JOIN edge e ON e.a = r.k),
named AS (SELECT k, min(root) AS cluster FROM reach GROUP BY k),
border AS (SELECT a AS k, min(cluster) AS cluster FROM pairs JOIN named ON named.k = b WHERE a NOT IN (SELECT k FROM core) GROUP BY a)
SELECT p_partkey AS key, n.k IS NOT NULL AS is_core, coalesce(n.cluster, o.cluster, -1) AS cluster
FROM part LEFT JOIN named n ON n.k = p_partkey LEFT JOIN border o ON o.k = p_partkey""")
def _(t):
    return dbscan(t.part, "p_partkey", ["p_size", "p_retailprice"], RADIUS, NEED)


@query("ml_fit_many")
def _(t):
    configs = {
        "a": classify("Decision Tree Classifier", max_depth=4),
        "b": classify("Gaussian Naive Bayes"),
        "c": classify("No Such Model"),
    }
    out = M.fit_many(orders(t), configs)
    return out.select("run_id", "algorithm", "success", "error", r(F.try_element_at("metrics", F.lit("f1"))).alias("f1"))


@query("ml_pipeline")
def _(t):
    """Split, encode, scale, fit, score, save, and read the saved metrics back."""
    config = classify("Random Forest Classifier", n_estimators=10, max_depth=5)
    result = M.train(orders(t), config)
    path = scratch_path(t.spark, "run")
    M.save(result.prepare, result.model, f"{path}/model")
    M.metric_rows(t.spark, "run", result.metrics).write.mode("overwrite").json(f"{path}/metrics")
    return rounded(t.spark.read.schema("run_id string, metric string, value double").json(f"{path}/metrics"))


def saved_model(t):
    config = classify("Logistic Regression", max_iter=20)
    result = M.train(orders(t), config)
    path = scratch_path(t.spark, "model")
    M.save(result.prepare, result.model, path)
    return path, config


@query("ml_predict_batch", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 AND floor(o_totalprice / 10000) >= 30 THEN '1' ELSE '0' END AS predicted_class FROM orders""")
def _(t):
    """Every row is scored with a saved one-split tree, those with a missing feature too; the classes are the target's own."""
    band = F.floor(F.col("o_totalprice") / 10000).cast("double")
    rows = t.orders.select("o_orderkey", band.alias("band"), (band >= 30).cast("int").alias("high"))
    config = TrainingConfig("classification", "Decision Tree Classifier", "o_orderkey", "high", ("band",), {"max_depth": 1})
    result = M.train(rows, config)
    path = scratch_path(t.spark, "model")
    M.save(result.prepare, result.model, path)
    gaps = rows.select("o_orderkey", F.expr("case when o_orderkey % 10 > 0 then band end").alias("band"))
    return M.predict_batch(gaps, path, config).select("o_orderkey", "predicted_class")


@query("ml_predict_conf")
def _(t):
    path, config = saved_model(t)
    scored = M.with_confidence(M.predict_batch(orders(t).drop("kind"), path, config))
    return scored.select("o_orderkey", "predicted_class", r("confidence", 4).alias("confidence"))


@query("ml_importance")
def _(t):
    return rounded(M.feature_importance(M.train(orders(t), classify("Random Forest Classifier", n_estimators=20, max_depth=5))))


@query("cv_scores")
def _(t):
    return rounded(M.cross_validate(orders(t), classify("Decision Tree Classifier", max_depth=4), 3))
