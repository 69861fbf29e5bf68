"""k nearest neighbours as models: votes and means over the exact neighbour join."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.density import dbscan
from lumenframe.operators.neighbors import nearest
from lumenframe.session import cut_lineage


def predict_class(
    train: DataFrame, test: DataFrame, key: str, features: Sequence[str] | str, label: str, k: int = 5, **options
) -> DataFrame:
    """``(key, prediction)``: the most frequent label among the neighbours; ties go to the smaller label."""
    found = nearest(test, train, key, key, features, k, carry=label, **options)
    votes = found.groupBy("query_key", "carried").agg(F.count("*").alias("n"))
    best = F.min_by("carried", F.struct(-F.col("n"), F.col("carried")))
    return votes.groupBy(F.col("query_key").alias(key)).agg(best.alias("prediction"))


def predict_value(
    train: DataFrame, test: DataFrame, key: str, features: Sequence[str] | str, label: str, k: int = 5, **options
) -> DataFrame:
    """``(key, prediction)``: mean label of the neighbours."""
    found = nearest(test, train, key, key, features, k, carry=label, **options)
    return found.groupBy(F.col("query_key").alias(key)).agg(F.avg("carried").alias("prediction"))


@dataclass(frozen=True)
class NeighborModel:
    """The training rows themselves, ``(key, x, label)``; rows to score need the same key column."""

    rows: DataFrame
    key: str
    k: int
    votes: bool
    kind = "neighbours"

    def transform(self, df: DataFrame) -> DataFrame:
        given = cut_lineage(df.withColumn("_x", vector_to_array("features")))
        predict = predict_class if self.votes else predict_value
        asked = given.select(F.col(self.key).alias("_key"), "_x")
        found = predict(self.rows, asked, "_key", "_x", "label", self.k).select(F.col("_key").alias("_found"), F.col("prediction").cast("double"))
        return given.join(found, given[self.key] == F.col("_found"), "left").drop("_found", "_x")

    def save(self, spark: SparkSession, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        facts = spark.createDataFrame([(self.key, self.k, self.votes)], "key string, k int, votes boolean")
        facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NeighborModel:
        facts = spark.read.parquet(f"{path}/facts").first()
        return cls(spark.read.parquet(f"{path}/rows"), facts.key, facts.k, facts.votes)


def fit_neighbors(ready: DataFrame, key: str, k: int, votes: bool) -> NeighborModel:
    rows = ready.select(F.col(key).alias("_key"), vector_to_array("features").alias("_x"), F.col("label").cast("double").alias("label"))
    return NeighborModel(cut_lineage(rows), key, k, votes)


@dataclass(frozen=True)
class DensityModel:
    """DBSCAN has no rule for other rows: it clusters the rows it is given."""

    key: str
    eps: float
    min_samples: int
    width: int

    def transform(self, df: DataFrame) -> DataFrame:
        given = cut_lineage(df)
        x = vector_to_array("features")
        cols = [f"x{i}" for i in range(self.width)]
        points = given.select(F.col(self.key).alias("_key"), *[x[i].alias(c) for i, c in enumerate(cols)])
        found = dbscan(points, "_key", cols, self.eps, self.min_samples).select("key", F.col("cluster").cast("double").alias("prediction"))
        return given.join(found, given[self.key].cast("long") == found["key"], "left").drop(found["key"])
