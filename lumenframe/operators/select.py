"""Feature selection and reduction to two components."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.stats import collect_stats, number, numeric_columns
from lumenframe.models import cells

# Names of the selectors.
VARIANCE = "Variance Threshold"
ANOVA = "Select K Best (ANOVA)"
REGRESSION = "Select K Best (Regression)"
RFE_LINEAR = "RFE (Logistic Regression)"
RFE_FOREST = "RFE (Random Forest)"
METHODS = (VARIANCE, ANOVA, REGRESSION, RFE_LINEAR, RFE_FOREST)

#: Rows above which a forest grows on counted cells: Spark's own keeps a number per row and tree, and reads all rows once per level.
COUNTED = 200_000


def variances(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, variance, kept)``; a column with no spread is not kept."""
    row = df.agg(*[F.var_pop(number(c)).alias(f"v{i}") for i, c in enumerate(cols)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(cols)]
    return row.select(F.inline(F.array(*cells))).withColumn("kept", F.coalesce(F.col("variance") > 0, F.lit(False)))


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    """Rank the columns of a table; there is one row per column."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc_nulls_last(), "column")
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("kept", F.col("rank") <= k)


def anova(df: DataFrame, target: str, cols: Sequence[str], k: int = 10) -> DataFrame:
    """One-way F of every column against the classes: class moments in one pass, then class rows are summed."""
    aggs = []
    for i, c in enumerate(cols):
        x = number(c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    classes = df.where(F.col(target).isNotNull()).groupBy(target).agg(*aggs)
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("m"), F.col(f"v{i}").alias("v")
        )
        for i, c in enumerate(cols)
    ]
    rows = classes.select(F.inline(F.array(*cells))).where("n > 0")
    total, groups = F.sum("n"), F.count("*")
    # Class means move around their weighted mean: n·var over the class rows, weighted by class size.
    grand = F.sum(F.col("n") * F.col("m")) / total
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - total * grand * grand
    within = F.sum(F.col("n") * F.col("v"))
    score = (between / F.nullif(groups - 1.0, F.lit(0.0))) / F.nullif(within / F.nullif(total - groups, F.lit(0)), F.lit(0.0))
    return _ranked(rows.groupBy("column").agg(score.alias("score")), k)


def f_regression(df: DataFrame, target: str, cols: Sequence[str], k: int = 10) -> DataFrame:
    """F = r² / (1 − r²) · (n − 2) of every column against a numeric target, in one pass."""
    y = number(target)
    aggs = []
    for i, c in enumerate(cols):
        both = F.when(y.isNotNull(), number(c))
        aggs += [F.corr(number(c), y).alias(f"r{i}"), F.count(both).alias(f"n{i}")]
    row = df.agg(*aggs)
    cells = []
    for i, c in enumerate(cols):
        square = F.col(f"r{i}") * F.col(f"r{i}")
        score = square / F.nullif(1.0 - square, F.lit(0.0)) * (F.col(f"n{i}") - 2)
        cells.append(F.struct(F.lit(c).alias("column"), score.alias("score")))
    return _ranked(row.select(F.inline(F.array(*cells))), k)


def eliminate(
    df: DataFrame, target: str, cols: Sequence[str], *, model: str = "logistic", keep: int = 10, trees: int = 100
) -> DataFrame:
    """Recursive elimination: fit, drop the weakest column, repeat; ``(column, rank, kept)``.

    The forest of a table of more than ``COUNTED`` rows reads them once: the same kind of trees grow on rows counted by bins.
    """
    left = list(cols)
    ranks: dict[str, int] = {}
    present = df.where(reduce(Column.__and__, [number(c).isNotNull() for c in left]) & F.col(target).isNotNull())
    index = StringIndexer(inputCol=target, outputCol="_y", stringOrderType="alphabetAsc").fit(present)
    data = index.transform(present).select("_y", *[number(c).alias(c) for c in left]).persist()
    rows_ = max(1, data.count())
    counted = None
    try:
        if model != "logistic" and rows_ > COUNTED and len(left) > keep:
            counted = cells.counted(data, "_y", cols)
            data.unpersist()
        while len(left) > keep:
            table = VectorAssembler(inputCols=left, outputCol="_x").transform(data)
            if model == "logistic":
                # The named model has C = 1 and up to 1,000 steps; Spark's penalty is per row.
                fit = LogisticRegression(
                    featuresCol="_x", labelCol="_y", maxIter=1000, regParam=1.0 / rows_, standardization=False
                ).fit(table)
                rows = fit.coefficientMatrix.toArray()
                weight = (rows**2).sum(axis=0)
            elif counted is not None:
                weight = cells.importances(counted, len(cols), [cols.index(c) for c in left], len(index.labels), trees)
            else:
                fit = RandomForestClassifier(featuresCol="_x", labelCol="_y", numTrees=trees, seed=42).fit(table)
                weight = fit.featureImportances.toArray()
            worst = min(range(len(left)), key=lambda i: weight[i])
            ranks[left.pop(worst)] = len(left) - keep + 2
    finally:
        data.unpersist()
    ranks |= dict.fromkeys(left, 1)
    rows = [(c, ranks[c], ranks[c] == 1) for c in cols]
    return df.sparkSession.createDataFrame(rows, "column string, rank long, kept boolean")


def apply(df: DataFrame, method: str, target: str, cols: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """Keep the chosen numeric columns, the target and every column that was not a candidate."""
    cols = list(cols or numeric_columns(df, [target]))
    if method == VARIANCE:
        scores = variances(df, cols)
    elif method == ANOVA:
        scores = anova(df, target, cols, k)
    elif method == REGRESSION:
        scores = f_regression(df, target, cols, k)
    elif method == RFE_LINEAR:
        scores = eliminate(df, target, cols, keep=k)
    elif method == RFE_FOREST:
        scores = eliminate(df, target, cols, model="forest", keep=k)
    else:
        raise ValueError(f"unknown feature selector: {method}")
    kept = {row["column"] for row in scores.where("kept").collect()}
    return df.drop(*[c for c in cols if c not in kept])


def components(df: DataFrame, features: Sequence[str] | str, k: int = 2) -> DataFrame:
    """Add ``pc1 .. pck``: projections of the centred features on their principal components.

    ``features`` is a list of numeric columns, or one array column.
    """
    if isinstance(features, str):
        table = df.withColumn("_x", array_to_vector(F.col(features).cast("array<double>")))
    else:
        table = VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="skip").transform(df)
    fit = PCA(k=k, inputCol="_x", outputCol="_pc").fit(table)
    width = fit.pc.numRows
    arr = vector_to_array("_x")
    means = collect_stats(table.select(arr.alias("a")), {i: F.avg(F.col("a")[i]) for i in range(width)})
    # The model projects without centring; subtracting the projected mean gives the same directions, centred.
    shift = [sum(means[i] * fit.pc[i, j] for i in range(width)) for j in range(k)]
    out = fit.transform(table).withColumn("_p", vector_to_array("_pc"))
    exprs = {f"pc{j + 1}": F.col("_p")[j] - F.lit(float(shift[j])) for j in range(k)}
    return out.withColumns(exprs).drop("_x", "_pc", "_p")
