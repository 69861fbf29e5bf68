"""Recommendation queries: groups of line items, of several sizes, stand for datasets."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.plans import recommend as A
from lumenframe.queries.registry import query, r, sr, union_all

# Groups from a few rows to a third of the table; columns are counted as distinct quantities and line numbers.
GROUPS = {"order": "l_orderkey", "supplier": "l_suppkey", "line": "l_linenumber", "flag": "l_returnflag"}
TASKS = "CASE count(*) % 4 WHEN 0 THEN 'Regression' WHEN 1 THEN 'Clustering' ELSE 'Classification' END"
PROFILE = union_all(
    f"""SELECT '{name}-' || {key}::varchar AS dataset, count(*) AS num_rows,
 count(DISTINCT l_quantity) + count(DISTINCT l_linenumber) AS num_columns, count(DISTINCT l_quantity) AS num_numeric,
 bool_or(l_discount = 0.0 AND l_tax = 0.08) AS has_missing, {TASKS} AS task,
 CASE WHEN count(*) % 3 = 0 THEN NULL ELSE 'target' END AS target, count(DISTINCT l_linestatus) AS target_classes
FROM lineitem GROUP BY {key}""" for name, key in GROUPS.items())
P = f"WITH p AS ({PROFILE}), c AS (SELECT *, CASE WHEN num_rows < 1000 THEN 'small_dataset' WHEN num_rows < 10000 THEN 'medium_dataset' ELSE 'large_dataset' END AS size_category, " \
    "CASE WHEN num_columns > 50 THEN 'high_dimensional' ELSE 'normal_dimensional' END AS dimensionality, " \
    "num_numeric / num_columns AS numeric_ratio, (num_columns - num_numeric) / num_columns AS categorical_ratio FROM p)\n"


def profiles(t) -> DataFrame:
    """One dataset profile per group and level."""
    parts = []
    for name, key in GROUPS.items():
        parts.append(t.lineitem.groupBy(key).agg(
            F.count("*").alias("num_rows"),
            (F.count_distinct("l_quantity") + F.count_distinct("l_linenumber")).alias("num_columns"),
            F.count_distinct("l_quantity").alias("num_numeric"),
            F.bool_or((F.col("l_discount") == 0.0) & (F.col("l_tax") == 0.08)).alias("has_missing"),
            F.expr(TASKS).alias("task"),
            F.expr("case when count(*) % 3 = 0 then null else 'target' end").alias("target"),
            F.count_distinct("l_linestatus").alias("target_classes"),
        ).withColumn("dataset", F.concat(F.lit(f"{name}-"), F.col(key).cast("string"))).drop(key))
    return reduce(DataFrame.unionByName, parts)


def listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def joined(array: str) -> str:
    return f"array_to_string({array}, '; ')"


def cases(table: dict, column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {listed(v)}" for k, v in table.items()) + " ELSE [] END"


@query("rec_characteristics", P + f"SELECT dataset, size_category, dimensionality, {sr('numeric_ratio')} AS numeric_ratio, {sr('categorical_ratio')} AS categorical_ratio, has_missing FROM c")
def _(t):
    return A.characteristics(profiles(t)).select("dataset", "size_category", "dimensionality", r("numeric_ratio").alias("numeric_ratio"), r("categorical_ratio").alias("categorical_ratio"), "has_missing")


def rule_rows(table, place):
    return " ".join(f"WHEN '{k}' THEN '{v[place]}'" for k, v in table.items())


@query("rec_algorithm", P + f""", k AS (SELECT *, CASE WHEN task = 'Regression' AND num_columns > 20 AND size_category = 'small_dataset' THEN 'regularization_needed'
 WHEN task = 'Regression' AND dimensionality = 'high_dimensional' THEN 'medium_dataset' WHEN dimensionality = 'high_dimensional' THEN 'high_dimensional' ELSE size_category END AS rule FROM c)
SELECT dataset, task, CASE task WHEN 'Clustering' THEN 'KMeans Clustering' WHEN 'Classification' THEN CASE rule {rule_rows(A.CLASSIFICATION, 0)} END ELSE CASE rule {rule_rows(A.REGRESSION, 0)} END END AS algorithm,
 CASE task WHEN 'Clustering' THEN '{{"n_clusters":' || CASE WHEN num_rows > 1000 THEN least(10, greatest(3, num_rows // 100)) ELSE 3 END || ',"n_init":10,"random_state":42}}'
 WHEN 'Classification' THEN CASE rule {rule_rows(A.CLASSIFICATION, 1)} END ELSE CASE rule {rule_rows(A.REGRESSION, 1)} END END AS hyperparameters FROM k""")
def _(t):
    return A.algorithm(A.characteristics(profiles(t))).select("dataset", "task", "algorithm", "hyperparameters")


@query("rec_metrics", P + f"SELECT dataset, {joined(cases(A.ADVISED_METRICS, 'task') + ' || CASE WHEN task = ' + chr(39) + 'Classification' + chr(39) + ' AND target_classes = 2 THEN [' + chr(39) + 'roc_auc' + chr(39) + '] ELSE [] END')} AS metrics FROM c")
def _(t):
    return A.metrics(profiles(t)).select("dataset", F.concat_ws("; ", "metrics").alias("metrics"))


@query("rec_cv_folds", P + "SELECT dataset, num_rows, CASE WHEN num_rows < 500 THEN 3 WHEN num_rows > 10000 THEN 10 ELSE 5 END AS cv_folds FROM c")
def _(t):
    return A.folds(profiles(t)).select("dataset", "num_rows", "cv_folds")


def compact(pairs) -> str:
    return joined("list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{v}' END" for c, v in pairs) + "], lambda x: x IS NOT NULL)")


SMALL = "size_category = 'small_dataset'"


@query("rec_suggestions", P + "SELECT dataset, " + compact([
    ("has_missing", A.HINT_MISSING), ("categorical_ratio > 0.3", A.HINT_CATEGORIES), ("numeric_ratio > 0.5", A.HINT_SCALE),
    ("dimensionality = 'high_dimensional'", A.HINT_WIDE), (SMALL, A.HINT_VALIDATE), (SMALL, A.HINT_OVERFIT)]) + " AS suggestions FROM c")
def _(t):
    return A.suggestions(A.characteristics(profiles(t))).select("dataset", F.concat_ws("; ", "suggestions").alias("suggestions"))


@query("rec_warnings", P + "SELECT dataset, " + compact([
    ("num_rows < 100", A.WARN_TINY), ("num_columns > num_rows", A.WARN_WIDE), ("task <> 'Clustering' AND target IS NULL", A.WARN_TARGET),
    ("has_missing", A.WARN_MISSING)]) + " AS warnings FROM c")
def _(t):
    return A.warnings(profiles(t)).select("dataset", F.concat_ws("; ", "warnings").alias("warnings"))


@query("rec_algo_list", P + f"SELECT dataset, {joined(cases(A.ALGORITHMS, 'task'))} AS algorithms FROM c")
def _(t):
    return A.algorithm_list(profiles(t)).select("dataset", F.concat_ws("; ", "algorithms").alias("algorithms"))


def params_rows() -> str:
    rows = []
    for task, models in A.DEFAULT_PARAMS.items():
        for model, params in models.items():
            text = ",".join(f"{k}={v}" for k, v in sorted(params.items()))
            rows.append(f"('{task}', '{model}', '{text}')")
    return ", ".join(rows)


@query("rec_default_params", P + f""", m AS (SELECT dataset, task, CASE WHEN num_rows % 2 = 0 THEN 'XGBoost' WHEN task = 'Clustering' THEN 'KMeans Clustering' ELSE 'Ridge' END AS model FROM c)
SELECT dataset, m.task, m.model, d.params FROM m LEFT JOIN (VALUES {params_rows()}) d(task, model, params) ON lower(m.task) = d.task AND m.model = d.model""")
def _(t):
    model = F.when(F.col("num_rows") % 2 == 0, "XGBoost").when(F.col("task") == "Clustering", "KMeans Clustering").otherwise("Ridge")
    found = A.default_params(profiles(t).withColumn("model", model))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return found.select("dataset", "task", "model", text.alias("params"))


TAKEN = "CASE algorithm " + " ".join(f"WHEN '{a}' THEN {listed(n)}" for a, n in A.TAKEN_PARAMS.items()) + " ELSE [] END"
GIVEN = ["C", "learning_rate", "max_depth", "n_clusters", "n_estimators"]


@query("rec_params_for_algo", P + f""", k AS (SELECT dataset, num_rows, CASE task WHEN 'Regression' THEN 'Random Forest Regressor' WHEN 'Clustering' THEN 'KMeans Clustering' ELSE 'Logistic Regression' END AS algorithm FROM c)
SELECT dataset, algorithm, array_to_string([p || '=' || (num_rows % 5) for p in list_filter({listed(GIVEN)}, lambda x: list_contains({TAKEN}, x) AND num_rows % 5 <> 0)], ',') AS hyperparameters FROM k""")
def _(t):
    algorithm = F.when(F.col("task") == "Regression", "Random Forest Regressor").when(F.col("task") == "Clustering", "KMeans Clustering").otherwise("Logistic Regression")
    given = F.map_from_arrays(F.array(*map(F.lit, GIVEN)), F.array(*[F.col("num_rows") % 5] * len(GIVEN)))
    kept = A.params_for_algorithm(profiles(t).withColumn("algorithm", algorithm).withColumn("given", given))
    text = F.array_join(F.transform(F.map_entries("hyperparameters"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return kept.select("dataset", "algorithm", text.alias("hyperparameters"))


@query("rec_default_metrics", P + f"SELECT dataset, CASE WHEN target IS NULL THEN {joined(cases(A.DEFAULT_METRICS, 'task'))} ELSE 'custom' END AS metrics FROM c")
def _(t):
    given = F.when(F.col("target").isNotNull(), F.array(F.lit("custom")))
    return A.default_metrics(profiles(t).withColumn("given", given)).select("dataset", F.concat_ws("; ", "metrics").alias("metrics"))
