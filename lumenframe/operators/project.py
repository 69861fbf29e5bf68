"""Column selection, row filters and small value repairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.stats import numeric_columns, string_columns

# Alias of a model name → official name.
MODEL_ALIASES = {
    "RandomForest": "Random Forest Classifier",
    "LogisticRegression": "Logistic Regression",
    "SVM": "Support Vector Classifier",
    "KNeighbors": "KNN Classifier",
    "DecisionTree": "Decision Tree Classifier",
    "GradientBoosting": "Gradient Boosting Classifier",
    "AdaBoost": "AdaBoost Classifier",
    "NaiveBayes": "Gaussian Naive Bayes",
    "LinearRegression": "Linear Regression",
    "RandomForestRegressor": "Random Forest Regressor",
    "GradientBoostingRegressor": "Gradient Boosting Regressor",
    "SVR": "Support Vector Regressor",
    "KNNRegressor": "KNN Regressor",
    "DecisionTreeRegressor": "Decision Tree Regressor",
    "AdaBoostRegressor": "AdaBoost Regressor",
    "ElasticNetRegressor": "ElasticNet",
    "KMeans": "KMeans Clustering",
    "DBSCAN": "DBSCAN",
}

# Official model names.
OFFICIAL_MODELS = (
    "Random Forest Classifier",
    "Random Forest Regressor",
    "Logistic Regression",
    "Support Vector Classifier",
    "Support Vector Regressor",
    "KNN Classifier",
    "KNN Regressor",
    "Decision Tree Classifier",
    "Decision Tree Regressor",
    "Gradient Boosting Classifier",
    "Gradient Boosting Regressor",
    "AdaBoost Classifier",
    "AdaBoost Regressor",
    "Gaussian Naive Bayes",
    "XGBoost",
    "LightGBM",
    "Linear Regression",
    "Ridge",
    "ElasticNet",
    "KMeans Clustering",
    "DBSCAN",
)


def split_roles(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Features and target as two selections of one table."""
    return df.drop(target), df.select(target)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the named columns; names that are absent are ignored."""
    return df.drop(*cols)


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*numeric_columns(df))


def select_text(df: DataFrame) -> DataFrame:
    return df.select(*string_columns(df))


def keep_present(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull())


def keep_top_values(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows whose value is among the ``n`` most frequent; equal counts go to the smaller value."""
    top = df.where(F.col(col).isNotNull()).groupBy(col).count().orderBy(F.col("count").desc(), F.col(col)).limit(n)
    return df.join(F.broadcast(top.select(col)), col, "left_semi")


def all_columns(cols: Sequence[str], test) -> Column:
    """True where ``test`` holds in every column."""
    return reduce(Column.__and__, [test(F.col(c)) for c in cols])


def any_column(cols: Sequence[str], test) -> Column:
    return reduce(Column.__or__, [test(F.col(c)) for c in cols])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def rename_values(df: DataFrame, col: str, names: dict[str, str]) -> DataFrame:
    """Replace the values found in ``names``; others stay."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return df.withColumn(col, F.coalesce(F.try_element_at(table, F.col(col)), F.col(col)))


def replace_infinite(df: DataFrame, value: float = 0.0) -> DataFrame:
    floats = {f.name: f.dataType for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(
        {c: F.when(F.abs(F.col(c)) == float("inf"), F.lit(value).cast(t)).otherwise(F.col(c)) for c, t in floats.items()}
    )


def fill_zero(df: DataFrame) -> DataFrame:
    """Nulls and NaN become 0; in text columns the text ``0``, as a column has one type."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    clean = df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floats}) if floats else df
    return clean.fillna(0).fillna("0")


def checked_method(col: Column, allowed: Sequence[str], default: str) -> Column:
    """The method name when it is allowed, else the default."""
    return F.when(col.isin(list(allowed)), col).otherwise(F.lit(default))


def official_model(col: Column) -> Column:
    """Official model name of an alias or an official name; null when it is neither."""
    table = F.create_map(*[F.lit(x) for pair in MODEL_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, col), F.when(col.isin(list(OFFICIAL_MODELS)), col))
