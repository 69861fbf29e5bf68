"""Settings by rule from dataset profiles: one profile per row, every rule a column expression.

A profile row has ``num_rows``, ``num_columns``, ``num_numeric``, ``has_missing``, ``task``,
``target`` and ``target_classes``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Algorithm and hyper-parameters per task and size or shape of the data.
CLASSIFICATION = {
    "small_dataset": ("Logistic Regression", '{"max_iter":1000,"random_state":42}'),
    "medium_dataset": ("Random Forest Classifier", '{"max_depth":10,"n_estimators":100,"random_state":42}'),
    "large_dataset": (
        "Gradient Boosting Classifier",
        '{"learning_rate":0.1,"max_depth":6,"n_estimators":100,"random_state":42}',
    ),
    "high_dimensional": ("Support Vector Classifier", '{"C":1.0,"kernel":"rbf","random_state":42}'),
}
REGRESSION = {
    "small_dataset": ("Linear Regression", "{}"),
    "medium_dataset": ("Random Forest Regressor", '{"max_depth":10,"n_estimators":100,"random_state":42}'),
    "large_dataset": (
        "Gradient Boosting Regressor",
        '{"learning_rate":0.1,"max_depth":6,"n_estimators":100,"random_state":42}',
    ),
    "regularization_needed": ("Ridge Regression", '{"alpha":1.0,"random_state":42}'),
}
CLUSTERING = "KMeans Clustering"

# Hints and warnings.
HINT_MISSING = "Handle missing values before training (imputation or removal)"
HINT_CATEGORIES = "Consider encoding categorical variables (one-hot or label encoding)"
HINT_SCALE = "Consider feature scaling (StandardScaler or MinMaxScaler)"
HINT_WIDE = "Consider dimensionality reduction (PCA or feature selection)"
HINT_VALIDATE = "Consider cross-validation for robust model evaluation"
HINT_OVERFIT = "Watch for overfitting due to small dataset size"
WARN_TINY = "Very small dataset - results may not be reliable"
WARN_WIDE = "More features than samples - high risk of overfitting"
WARN_TARGET = "No target column specified for supervised learning"
WARN_MISSING = "Dataset contains missing values - preprocessing required"

# Default metrics per task, when a profile is given and when nothing is.
ADVISED_METRICS = {
    "Classification": ("accuracy", "precision", "recall", "f1"),
    "Regression": ("mae", "mse", "rmse", "r2"),
    "Clustering": ("silhouette", "davies_bouldin", "calinski_harabasz"),
}
DEFAULT_METRICS = {
    "Classification": ("accuracy", "precision", "recall", "f1", "roc_auc"),
    "Regression": ("mae", "mse", "rmse", "r2", "mape"),
    "Clustering": ("silhouette", "davies_bouldin", "calinski_harabasz"),
}

# Algorithms offered per task.
ALGORITHMS = {
    "Classification": (
        "Logistic Regression",
        "Random Forest Classifier",
        "Decision Tree Classifier",
        "Support Vector Classifier",
        "Gaussian Naive Bayes",
        "KNN Classifier",
        "Gradient Boosting Classifier",
        "AdaBoost Classifier",
    ),
    "Regression": (
        "Linear Regression",
        "Ridge Regression",
        "Lasso Regression",
        "Random Forest Regressor",
        "Decision Tree Regressor",
        "Support Vector Regressor",
        "KNN Regressor",
        "Gradient Boosting Regressor",
        "AdaBoost Regressor",
    ),
    "Clustering": ("KMeans Clustering",),
}

# Default hyper-parameters per task and model.
DEFAULT_PARAMS = {
    "classification": {
        "Logistic Regression": {"max_iter": "1000", "random_state": "42"},
        "Random Forest Classifier": {"n_estimators": "100", "max_depth": "10", "random_state": "42"},
        "Gradient Boosting Classifier": {
            "n_estimators": "100", "learning_rate": "0.1", "max_depth": "6", "random_state": "42",
        },
        "Support Vector Classifier": {"C": "1.0", "kernel": "rbf", "random_state": "42"},
        "KNN Classifier": {},
        "Decision Tree Classifier": {},
        "AdaBoost Classifier": {},
        "Gaussian Naive Bayes": {},
        "XGBoost": {"random_state": "42"},
        "LightGBM": {"random_state": "42"},
    },
    "regression": {
        "Linear Regression": {},
        "Random Forest Regressor": {"n_estimators": "100", "max_depth": "10", "random_state": "42"},
        "Gradient Boosting Regressor": {
            "n_estimators": "100", "learning_rate": "0.1", "max_depth": "6", "random_state": "42",
        },
        "Ridge": {"alpha": "1.0", "random_state": "42"},
        "Support Vector Regressor": {},
        "KNN Regressor": {},
        "Decision Tree Regressor": {},
        "AdaBoost Regressor": {},
        "ElasticNet": {},
        "XGBoost": {"random_state": "42"},
        "LightGBM": {"random_state": "42"},
    },
    "clustering": {
        "KMeans Clustering": {"n_clusters": "3", "random_state": "42", "n_init": "10"},
        "DBSCAN": {},
    },
}

# Form parameters that an algorithm takes.
TAKEN_PARAMS = {
    "Random Forest Classifier": ("n_estimators", "max_depth"),
    "Random Forest Regressor": ("n_estimators", "max_depth"),
    "Gradient Boosting Classifier": ("n_estimators", "learning_rate"),
    "Gradient Boosting Regressor": ("n_estimators", "learning_rate"),
    "Support Vector Classifier": ("C",),
    "Support Vector Regressor": ("C",),
    "KNN Classifier": ("n_neighbors",),
    "KNN Regressor": ("n_neighbors",),
    "KMeans Clustering": ("n_clusters",),
}


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def characteristics(df: DataFrame) -> DataFrame:
    """Add size class, dimensionality and the shares of numeric and other columns."""
    size = (
        F.when(F.col("num_rows") < 1000, "small_dataset")
        .when(F.col("num_rows") < 10000, "medium_dataset")
        .otherwise("large_dataset")
    )
    width = F.when(F.col("num_columns") > 50, "high_dimensional").otherwise("normal_dimensional")
    share = F.col("num_numeric") / F.nullif(F.col("num_columns"), F.lit(0))
    other = (F.col("num_columns") - F.col("num_numeric")) / F.nullif(F.col("num_columns"), F.lit(0))
    return df.withColumns(
        {"size_category": size, "dimensionality": width, "numeric_ratio": share, "categorical_ratio": other}
    )


def algorithm(df: DataFrame) -> DataFrame:
    """Add ``algorithm`` and ``hyperparameters`` (JSON text) for profiles with characteristics."""
    small, wide = F.col("size_category") == "small_dataset", F.col("dimensionality") == "high_dimensional"
    rule = (
        F.when((F.col("task") == "Regression") & (F.col("num_columns") > 20) & small, "regularization_needed")
        .when((F.col("task") == "Regression") & wide, "medium_dataset")
        .when(wide, "high_dimensional")
        .otherwise(F.col("size_category"))
    )
    chosen = df.withColumn("_rule", rule)
    name, params = F.lit(None).cast("string"), F.lit(None).cast("string")
    for task, table in (("Classification", CLASSIFICATION), ("Regression", REGRESSION)):
        for key, (algo, settings) in table.items():
            here = (F.col("task") == task) & (F.col("_rule") == key)
            name = F.when(here, algo).otherwise(name)
            params = F.when(here, settings).otherwise(params)
    clusters = F.when(
        F.col("num_rows") > 1000, F.least(F.lit(10), F.greatest(F.lit(3), F.floor(F.col("num_rows") / 100)))
    ).otherwise(3)
    grouped = F.col("task") == "Clustering"
    name = F.when(grouped, CLUSTERING).otherwise(name)
    params = F.when(
        grouped, F.concat(F.lit('{"n_clusters":'), clusters.cast("string"), F.lit(',"n_init":10,"random_state":42}'))
    ).otherwise(params)
    return chosen.withColumns({"algorithm": name, "hyperparameters": params}).drop("_rule")


def metrics(df: DataFrame) -> DataFrame:
    """Add the advised metrics; a target with two classes also gets ``roc_auc``."""
    out = F.array().cast("array<string>")
    for task, names in ADVISED_METRICS.items():
        out = F.when(F.col("task") == task, _texts(names)).otherwise(out)
    binary = (F.col("task") == "Classification") & (F.col("target_classes") == 2)
    return df.withColumn("metrics", F.when(binary, F.array_append(out, F.lit("roc_auc"))).otherwise(out))


def folds(df: DataFrame) -> DataFrame:
    return df.withColumn("cv_folds", F.when(F.col("num_rows") < 500, 3).when(F.col("num_rows") > 10000, 10).otherwise(5))


def suggestions(df: DataFrame) -> DataFrame:
    small = F.col("size_category") == "small_dataset"
    hints = F.array(
        F.when(F.col("has_missing"), HINT_MISSING),
        F.when(F.col("categorical_ratio") > 0.3, HINT_CATEGORIES),
        F.when(F.col("numeric_ratio") > 0.5, HINT_SCALE),
        F.when(F.col("dimensionality") == "high_dimensional", HINT_WIDE),
        F.when(small, HINT_VALIDATE),
        F.when(small, HINT_OVERFIT),
    )
    return df.withColumn("suggestions", F.array_compact(hints))


def warnings(df: DataFrame) -> DataFrame:
    found = F.array(
        F.when(F.col("num_rows") < 100, WARN_TINY),
        F.when(F.col("num_columns") > F.col("num_rows"), WARN_WIDE),
        F.when((F.col("task") != "Clustering") & (F.coalesce("target", F.lit("")) == ""), WARN_TARGET),
        F.when(F.col("has_missing"), WARN_MISSING),
    )
    return df.withColumn("warnings", F.array_compact(found))


def algorithm_list(df: DataFrame) -> DataFrame:
    """Add the algorithms offered for the task."""
    out = F.array().cast("array<string>")
    for task, names in ALGORITHMS.items():
        out = F.when(F.col("task") == task, _texts(names)).otherwise(out)
    return df.withColumn("algorithms", out)


def default_params(df: DataFrame, task: str = "task", model: str = "model") -> DataFrame:
    """Attach default hyper-parameters; a model the task does not know keeps null."""
    rows = [(t, m, p) for t, models in DEFAULT_PARAMS.items() for m, p in models.items()]
    table = df.sparkSession.createDataFrame(rows, "_task string, _model string, params map<string,string>")
    same = (F.lower(F.col(task)) == F.col("_task")) & (F.col(model) == F.col("_model"))
    return df.join(F.broadcast(table), same, "left").drop("_task", "_model")


def params_for_algorithm(df: DataFrame, algorithm: str = "algorithm", given: str = "given") -> DataFrame:
    """Keep only the parameters the algorithm takes, and of those only the ones that are set."""
    taken = F.create_map(*[x for a, names in TAKEN_PARAMS.items() for x in (F.lit(a), _texts(names))])
    names = F.coalesce(F.try_element_at(taken, F.col(algorithm)), F.array().cast("array<string>"))
    kept = F.map_filter(F.col(given), lambda k, v: F.array_contains(names, k) & v.isNotNull() & (v != 0))
    return df.withColumn("hyperparameters", kept)


def default_metrics(df: DataFrame, given: str = "given", task: str = "task") -> DataFrame:
    """The given metrics, else the defaults of the task."""
    out = F.array().cast("array<string>")
    for name, names in DEFAULT_METRICS.items():
        out = F.when(F.col(task) == name, _texts(names)).otherwise(out)
    return df.withColumn("metrics", F.coalesce(F.col(given), out))
