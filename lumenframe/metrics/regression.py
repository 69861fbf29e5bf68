"""Regression metrics, all from one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def all_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """MAE, MSE, RMSE, R² and MAPE in one row."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    e = y - p
    paired = F.when(e.isNotNull(), y)
    return df.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1.0 - F.sum(e * e) / F.nullif(F.count(e) * F.var_pop(paired), F.lit(0.0))).alias("r2"),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"),
    )


def residuals(df: DataFrame, truth: str, predicted: str, keep: list[str]) -> DataFrame:
    """Actual, predicted and residual per row."""
    return df.select(
        *keep,
        F.col(truth).alias("actual"),
        F.col(predicted).alias("predicted"),
        (F.col(truth) - F.col(predicted)).alias("residual"),
    )
