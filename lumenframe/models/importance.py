"""Feature importance tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ranked(importance: DataFrame) -> DataFrame:
    """Features by importance, highest first; one row per feature, so one task is enough."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("importance").desc(), "feature")
    return importance.withColumn("rank", F.row_number().over(w).cast("long"))


def of_model(spark: SparkSession, model, features: Sequence[str]) -> DataFrame:
    """Tree importances, else the size of the coefficients; nothing when a model has neither."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        values = abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        values = abs(model.coefficients.toArray())
    else:
        values = []
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return ranked(spark.createDataFrame(rows, "feature string, importance double"))
