"""Classification metrics. Rows are counted once; every figure is derived from the small counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.ordering import running_totals
from lumenframe.functions.stats import number


def pair_counts(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """``(truth, predicted, n)`` for the pairs that occur."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts over the full grid of classes, zeros included."""
    counts = pair_counts(df, truth, predicted)
    labels = F.array_sort(F.array_union(F.collect_set("truth"), F.collect_set("predicted")))
    grid = counts.agg(labels.alias("c")).select("c", F.explode("c").alias("truth"))
    grid = grid.select("truth", F.explode("c").alias("predicted"))
    return grid.join(counts, ["truth", "predicted"], "left").select(
        "truth", "predicted", F.coalesce("n", F.lit(0)).alias("n")
    )


def _ratio(a: Column, b: Column) -> Column:
    """Zero when nothing is there to divide by."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def class_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("given"), hit.cast("long").alias("hit")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("given"), F.lit(0).cast("long").alias("hit")),
    )
    sums = (
        pair_counts(df, truth, predicted).select(F.inline(sides)).groupBy("label")
        .agg(F.sum("actual").alias("support"), F.sum("given").alias("given"), F.sum("hit").alias("hit"))
    )
    precision = _ratio(F.col("hit"), F.col("given"))
    recall = _ratio(F.col("hit"), F.col("support"))
    scored = sums.withColumns({"precision": precision, "recall": recall})
    return scored.withColumn(
        "f1", _ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    ).drop("given")


def weighted(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 in one row."""
    n = F.sum("support")
    return class_scores(df, truth, predicted).agg(
        (F.sum("hit") / n).alias("accuracy"),
        *[(F.sum(F.col(m) * F.col("support")) / n).alias(m) for m in ("precision", "recall", "f1")],
    )


def report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per-class rows, then accuracy, the macro average and the weighted average."""
    scores = class_scores(df, truth, predicted)
    n = F.sum("support")
    names = ("precision", "recall", "f1")
    per_class = scores.select(F.col("label").cast("string"), *names, "support")
    macro = scores.agg(F.lit("macro avg").alias("label"), *[F.avg(m).alias(m) for m in names], n.alias("support"))
    mean = scores.agg(
        F.lit("weighted avg").alias("label"),
        *[(F.sum(F.col(m) * F.col("support")) / n).alias(m) for m in names],
        n.alias("support"),
    )
    accuracy = scores.agg(
        F.lit("accuracy").alias("label"), *[(F.sum("hit") / n).alias(m) for m in names], n.alias("support")
    )
    return per_class.unionByName(accuracy).unionByName(macro).unionByName(mean)


def threshold_counts(
    df: DataFrame, score: str, positive: Column, keys: Sequence[str] = (), *, bucket_rows: int | None = None
) -> DataFrame:
    """``(keys, score, pos, neg, cum_pos, cum_neg)`` per distinct score, from the highest down.

    Equal scores are merged before anything is ordered, and the running totals are bucketed. Rows
    without a score (null or NaN) share one last threshold, null: no number ever selects them.
    """
    counts = df.groupBy(*keys, number(score).alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    return running_totals(counts, "score", ["pos", "neg"], keys, descending=True, bucket_rows=bucket_rows)


def roc(df: DataFrame, score: str, positive: Column, **options) -> DataFrame:
    """False and true positive rates at every threshold, with the origin (no threshold) first."""
    points = threshold_counts(df, score, positive, **options)
    whole = df.agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n")).first()
    rates = points.select(
        F.col("score").alias("threshold"),
        (F.col("cum_neg") / F.nullif(F.lit(whole["n"]), F.lit(0))).alias("fpr"),
        (F.col("cum_pos") / F.nullif(F.lit(whole["p"]), F.lit(0))).alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return rates.unionByName(origin)


def _area(keys: Sequence[str] = ()) -> list[Column]:
    """Trapezoids between neighbouring thresholds need no look back: the step before is total minus own."""
    strip = F.col("neg") * (2.0 * F.col("cum_pos") - F.col("pos")) / 2.0
    p, n = F.sum("pos"), F.sum("neg")
    return [p.alias("positives"), n.alias("negatives"), (F.sum(strip) / F.nullif(p * 1.0 * n, F.lit(0.0))).alias("auc")]


def auc(df: DataFrame, score: str, positive: Column, **options) -> DataFrame:
    """Area under the ROC curve."""
    return threshold_counts(df, score, positive, **options).agg(*_area()).select("auc")


def auc_one_vs_rest(df: DataFrame, truth: str, scores: dict[str, str], **options) -> DataFrame:
    """One-vs-rest AUC per class, averaged by class size; ``scores`` maps class to score column."""
    cells = [
        F.struct(
            F.lit(c).alias("class"), F.col(s).cast("double").alias("score"), (F.col(truth) == c).alias("is_class")
        )
        for c, s in scores.items()
    ]
    long = df.select(F.inline(F.array(*cells)))
    areas = threshold_counts(long, "score", F.col("is_class"), ["class"], **options).groupBy("class").agg(*_area())
    return areas.agg((F.sum(F.col("auc") * F.col("positives")) / F.sum("positives")).alias("auc"))


def precision_recall(df: DataFrame, score: str, positive: Column, **options) -> DataFrame:
    """Precision and recall at every threshold, and the end point (1, 0) without one."""
    points = threshold_counts(df, score, positive, **options)
    total = df.agg(F.count_if(positive)).first()[0]
    found = points.select(
        F.col("score").alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        (F.col("cum_pos") / F.nullif(F.lit(total), F.lit(0))).alias("recall"),
    )
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return found.unionByName(end)


def average_precision(df: DataFrame, score: str, positive: Column, **options) -> DataFrame:
    """Sum of recall steps times precision."""
    points = threshold_counts(df, score, positive, **options)
    step = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return points.agg((F.sum(step) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))
