"""AdaBoost over small Spark trees.

A fitted tree is turned into a column expression. The logarithm of a row's weight is a column that each round
adds to; every few rounds the rows are written and read again, so that no expression holds all earlier trees.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.stats import collect_stats
from lumenframe.session import cut_lineage

# Rounds whose trees one weight expression may hold.
ROUNDS_APART = 5


def tree_expression(model, features: Column) -> Column:
    """The prediction of a fitted tree over an array of numeric features."""

    def walk(node) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(float(node.prediction()))
        split = node.split()
        test = features[split.featureIndex()] <= F.lit(float(split.threshold()))
        return F.when(test, walk(node.leftChild())).otherwise(walk(node.rightChild()))

    return walk(model._java_obj.rootNode())


def _save(model, spark: SparkSession, path: str, classes: int) -> None:
    """Every tree in a folder of its own, beside their weights."""
    for i, tree in enumerate(model.trees):
        tree.write().overwrite().save(f"{path}/tree{i}")
    rows = [(i, w, classes) for i, w in enumerate(model.weights)]
    spark.createDataFrame(rows, "i int, weight double, classes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")


def _load(spark: SparkSession, path: str, kind) -> tuple[tuple, tuple, int]:
    rows = spark.read.parquet(f"{path}/weights").orderBy("i").collect()  # one row per round
    return tuple(kind.load(f"{path}/tree{r.i}") for r in rows), tuple(r.weight for r in rows), rows[0].classes


@dataclass(frozen=True)
class BoostedClassifier:
    trees: tuple
    weights: tuple[float, ...]
    classes: int
    kind = "boosted classifier"

    def save(self, spark: SparkSession, path: str) -> None:
        _save(self, spark, path, self.classes)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedClassifier:
        trees, weights, classes = _load(spark, path, DecisionTreeClassificationModel)
        return cls(trees, weights, classes)

    def votes(self, x: Column) -> Column:
        """Vote weight per class, as an array."""
        given = [tree_expression(t, x) for t in self.trees]
        return F.array(
            *[
                reduce(Column.__add__, [F.when(g == c, F.lit(w)).otherwise(0.0) for g, w in zip(given, self.weights)])
                for c in range(self.classes)
            ]
        )

    def transform(self, df: DataFrame) -> DataFrame:
        voted = df.withColumn("_votes", self.votes(vector_to_array("features")))
        best = F.array_position("_votes", F.array_max("_votes")) - 1
        return voted.withColumn("prediction", best.cast("double")).drop("_votes")


def fit_classifier(df: DataFrame, classes: int, *, rounds: int = 50, rate: float = 1.0, depth: int = 1) -> BoostedClassifier:
    """SAMME (Hastie et al., 2009) on ``features`` and ``label``."""
    data = cut_lineage(df.select("features", "label", F.lit(0.0).alias("exponent")))
    x = vector_to_array("features")
    trees, weights = [], []
    for turn in range(rounds):
        if turn and turn % ROUNDS_APART == 0:
            data = cut_lineage(data)
        weighted = data.withColumn("weight", F.exp("exponent"))
        tree = DecisionTreeClassifier(weightCol="weight", maxDepth=depth, seed=42).fit(weighted)
        wrong = tree_expression(tree, x) != F.col("label")
        s = collect_stats(
            weighted, {"bad": F.sum(F.when(wrong, F.col("weight")).otherwise(0.0)), "all": F.sum("weight")}
        )
        error = s["bad"] / s["all"]
        if error >= 1.0 - 1.0 / classes:
            # The tree is no better than a guess: keep it only when there is no other.
            if not trees:
                trees, weights = [tree], [1.0]
            break
        if error <= 0:
            trees.append(tree)
            weights.append(1.0)
            break
        weight = rate * (log((1 - error) / error) + log(classes - 1))
        trees.append(tree)
        weights.append(weight)
        data = data.withColumn("exponent", F.col("exponent") + F.when(wrong, F.lit(weight)).otherwise(0.0))
    return BoostedClassifier(tuple(trees), tuple(weights), classes)


@dataclass(frozen=True)
class BoostedRegressor:
    trees: tuple
    weights: tuple[float, ...]
    kind = "boosted regressor"

    def save(self, spark: SparkSession, path: str) -> None:
        _save(self, spark, path, 0)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedRegressor:
        trees, weights, _ = _load(spark, path, DecisionTreeRegressionModel)
        return cls(trees, weights)

    def transform(self, df: DataFrame) -> DataFrame:
        """Weighted median of the trees."""
        x = vector_to_array("features")
        cells = [
            F.struct(tree_expression(t, x).alias("p"), F.lit(w).alias("w")) for t, w in zip(self.trees, self.weights)
        ]
        half = sum(self.weights) / 2.0
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("p"))

        def step(acc: Column, item: Column) -> Column:
            total = acc["sum"] + item["w"]
            return F.struct(
                total.alias("sum"),
                F.when(acc["p"].isNull() & (total >= half), item["p"]).otherwise(acc["p"]).alias("p"),
            )

        ordered = df.withColumn("_given", F.array_sort(F.array(*cells)))
        return ordered.withColumn("prediction", F.aggregate("_given", start, step)["p"]).drop("_given")


def fit_regressor(df: DataFrame, *, rounds: int = 50, rate: float = 1.0, depth: int = 3) -> BoostedRegressor:
    """AdaBoost.R2 (Drucker, 1997) with linear loss; trees are fitted on weighted rows."""
    data = cut_lineage(df.select("features", "label", F.lit(0.0).alias("exponent")))
    x = vector_to_array("features")
    trees, weights = [], []
    for turn in range(rounds):
        if turn and turn % ROUNDS_APART == 0:
            data = cut_lineage(data)
        weighted = data.withColumn("weight", F.exp("exponent"))
        tree = DecisionTreeRegressor(weightCol="weight", maxDepth=depth, seed=42).fit(weighted)
        miss = F.abs(tree_expression(tree, x) - F.col("label"))
        worst = collect_stats(weighted, {"m": F.max(miss)})["m"]
        if not worst:
            trees.append(tree)
            weights.append(1.0)
            break
        loss = miss / F.lit(worst)
        s = collect_stats(weighted, {"bad": F.sum(F.col("weight") * loss), "all": F.sum("weight")})
        error = s["bad"] / s["all"]
        if error >= 0.5:
            if not trees:
                trees, weights = [tree], [1.0]
            break
        beta = error / (1.0 - error)
        trees.append(tree)
        weights.append(rate * log(1.0 / beta))
        data = data.withColumn("exponent", F.col("exponent") + (1.0 - loss) * F.lit(rate * log(beta)))
    return BoostedRegressor(tuple(trees), tuple(weights))
