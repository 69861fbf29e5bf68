"""Comparison of runs: one row per model, long form for charts, and the best run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Metrics where less is better.
LOWER_IS_BETTER = ("mse", "rmse", "mae", "davies_bouldin")


def wide(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per model, one column per metric."""
    return results.groupBy("model").pivot("metric", list(metrics)).agg(F.first("value"))


def long(table: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return table.unpivot("model", list(metrics), "metric", "value").where("value is not null")


def best(results: DataFrame) -> DataFrame:
    """Best model per metric, in the direction of the metric; equal values go to the smaller name."""
    lower = F.col("metric").isin(list(LOWER_IS_BETTER))
    worth = F.when(lower, F.col("value")).otherwise(-F.col("value"))
    return results.where("value is not null").groupBy("metric").agg(
        F.min_by("model", F.struct(worth, F.col("model"))).alias("model"),
        F.min_by("value", F.struct(worth, F.col("model"))).alias("value"),
    )
