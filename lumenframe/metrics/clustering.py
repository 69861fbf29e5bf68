"""Clustering metrics.

Centroid scores read cluster moments from one aggregation. The Euclidean silhouette has no closed
form: every row must meet every row. It runs as blocks of rows that meet without copies and returns only sums per
row and cluster; :func:`silhouette_squared` is the variant whose cost grows with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.stats import number
from lumenframe.operators import tiles as T

SHIP_ROWS = 20_000
SHIP_NUMBERS = 4_000_000
#: Features from which a matrix product gives the distances, and squares (as parts of the rows' own) below which rounding would show.
WIDE = 8
NEAR = 1e-6


def _vector(features: Sequence[str] | str) -> Column:
    if isinstance(features, str):
        return F.col(features).cast("array<double>")
    return F.array(*[number(c) for c in features])


def cluster_moments(df: DataFrame, cluster: str, features: Sequence[str] | str) -> DataFrame:
    """``(cluster, n, mean, var)``: size and per-feature population moments of every cluster."""
    slim = df.select(F.col(cluster).alias("cluster"), _vector(features).alias("x")).where("cluster is not null")
    width = slim.select(F.size("x")).first()[0]
    aggs = [F.count("*").alias("n")]
    aggs += [F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)]
    aggs += [F.var_pop(F.col("x")[i]).alias(f"v{i}") for i in range(width)]
    return slim.groupBy("cluster").agg(*aggs).select(
        "cluster",
        "n",
        F.array(*[f"m{i}" for i in range(width)]).alias("mean"),
        F.array(*[f"v{i}" for i in range(width)]).alias("var"),
    )


def _square(a: str, b: str) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g)


def davies_bouldin(df: DataFrame, cluster: str, features: Sequence[str] | str) -> DataFrame:
    """Mean over clusters of the worst ratio of spreads to centre distance."""
    centres = cluster_moments(df, cluster, features).select("cluster", "mean")
    slim = df.select(F.col(cluster).alias("cluster"), _vector(features).alias("x"))
    spread = slim.join(centres, "cluster").groupBy("cluster", "mean").agg(F.avg(F.sqrt(_square("x", "mean"))).alias("s"))
    # One row per cluster: the table of centres is as small as the number of clusters.
    rows = spread.toPandas()
    mean = np.array(rows["mean"].tolist(), dtype=float)
    s = rows["s"].to_numpy()
    worst = []
    for i in range(len(rows)):
        gap = np.sqrt(((mean - mean[i]) ** 2).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(gap > 0, (s + s[i]) / gap, 0.0)
        ratio[i] = 0.0
        worst.append(ratio.max())
    value = float(np.mean(worst)) if worst else None
    return df.sparkSession.createDataFrame([(value,)], "davies_bouldin double")


def calinski_harabasz(df: DataFrame, cluster: str, features: Sequence[str] | str) -> DataFrame:
    """Between-cluster over within-cluster dispersion, from cluster moments alone."""
    rows = cluster_moments(df, cluster, features).select(
        "cluster", "n", F.posexplode(F.arrays_zip("mean", "var")).alias("dim", "z")
    )
    n, m, v = F.col("n"), F.col("z.mean"), F.col("z.var")
    dims = rows.groupBy("dim").agg(
        F.sum(n).alias("total"),
        F.count("*").alias("k"),
        F.sum(n * v).alias("within"),
        (F.sum(n * m * m) - F.sum(n * m) * F.sum(n * m) / F.sum(n)).alias("between"),
    )
    total, k = F.max("total"), F.max("k")
    score = (F.sum("between") / (k - 1)) / (F.sum("within") / (total - k))
    return dims.agg(score.alias("calinski_harabasz"))


def _cluster_sums(x: np.ndarray, other: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The clusters of ``labels``, and the sum of distances from each row to the rows of each of them."""
    order = np.argsort(labels, kind="stable")
    other = other[order]
    names, first = np.unique(labels[order], return_index=True)
    sums = np.zeros((len(x), len(names)))
    if x.shape[1] >= WIDE and np.maximum(np.abs(x).max(initial=0.0), np.abs(other).max(initial=0.0)) < 1e150:  # false for NaN, too
        far = NEAR / T.rounding(np.float64, x.shape[1])
        for part, total, slack in T.squares(x, other):
            # One matrix product; rows so near that rounding would show are measured feature by feature.
            near = np.flatnonzero((total <= (slack * far)[:, None]).reshape(-1))
            for at in range(0, len(near), 100_000):
                k, l = np.divmod(near[at : at + 100_000], len(other))
                total[k, l] = ((x[part][k] - other[l]) ** 2).sum(axis=1)
            sums[part] = np.add.reduceat(np.sqrt(total, out=total), first, axis=1)
        return names, sums
    step = max(1, 2_000_000 // max(1, len(other)))
    for start in range(0, len(x), step):
        part = slice(start, start + step)
        total = np.zeros((len(x[part]), len(other)))
        for c in range(x.shape[1]):
            gap = x[part, c : c + 1] - other[None, :, c]
            total += gap * gap
        sums[part] = np.add.reduceat(np.sqrt(total, out=total), first, axis=1)
    return names, sums


def _distance_sums(keys: np.ndarray, x: np.ndarray, other: np.ndarray, labels: np.ndarray) -> pd.DataFrame:
    """Sum of distances from each row to the rows of each cluster in the other block."""
    names, sums = _cluster_sums(x, other, labels)
    return pd.DataFrame(
        {"key": np.repeat(keys, len(names)), "other": np.tile(names, len(x)), "total": sums.ravel()}
    )


def _block_sums(slim: DataFrame, rows: int, width: int, block_rows: int | None, schema: str) -> DataFrame:
    """:func:`_distance_sums` of all rows, as blocks that meet without copies; a task adds up the sums of its rows before it returns them."""

    def begin(block: T.Block) -> tuple[T.Block, dict[int, np.ndarray]]:
        return block, {}

    def add(state: tuple[T.Block, dict[int, np.ndarray]], other: T.Block) -> None:
        block, held = state
        names, sums = _cluster_sums(block.x, other.x, other.extra)
        for name, total in zip(names.tolist(), sums.T):
            held[name] = held[name] + total if name in held else total.copy()

    def end(state: tuple[T.Block, dict[int, np.ndarray]]) -> pa.RecordBatch:
        block, held = state
        columns = [np.tile(block.keys, len(held)), np.repeat(np.array([*held], np.int64), len(block.keys)), np.concatenate([*held.values(), np.zeros(0)])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "other", "total"])

    # A row without a key has no score, but others have a distance to it.
    packed = slim.select(F.coalesce(F.col("key").cast("long"), F.lit(0)).alias("key"), "x", F.col("c").alias("extra"), F.col("key").isNotNull().alias("named"))
    return T.meet(packed.where("named"), packed, rows, rows, width, block_rows, begin, add, end, schema)


def silhouette_rows(
    df: DataFrame,
    key: str,
    cluster: str,
    features: Sequence[str] | str,
    *,
    ship_rows: int | None = None,
    block_rows: int | None = None,
) -> DataFrame:
    """``(key, cluster, silhouette)`` with Euclidean distances over all rows."""
    slim = df.select(F.col(key).alias("key"), F.col(cluster).cast("long").alias("c"), _vector(features).alias("x"))
    slim = slim.where("c is not null")
    rows, numbers = slim.agg(F.count("*"), F.coalesce(F.sum(F.size("x")), F.lit(0))).first()
    schema = "key long, other long, total double"
    if rows <= (SHIP_ROWS if ship_rows is None else ship_rows) and numbers <= SHIP_NUMBERS:
        whole = slim.select("c", "x").toPandas()
        shipped = df.sparkSession.sparkContext.broadcast(
            (np.array(whole["x"].tolist(), dtype=float), whole["c"].to_numpy())
        )

        def against_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            other, labels = shipped.value
            for b in batches:
                if len(b):
                    yield _distance_sums(b["key"].to_numpy(), np.array(b["x"].tolist(), dtype=float), other, labels)

        sums = slim.mapInPandas(against_all, schema)
    else:
        sums = _block_sums(slim, rows, -(-numbers // rows), block_rows, schema)
    sizes = slim.groupBy("c").agg(F.count("*").alias("n"))
    per = sums.groupBy("key", "other").agg(F.sum("total").alias("total"))
    per = per.join(sizes.select(F.col("c").alias("other"), "n"), "other").join(slim.select("key", "c"), "key")
    own = F.col("other") == F.col("c")
    a = F.max(F.when(own, F.col("total") / F.nullif(F.col("n") - 1, F.lit(0))))
    b = F.min(F.when(~own, F.col("total") / F.col("n")))
    scored = per.groupBy("key", "c").agg(a.alias("a"), b.alias("b"))
    value = F.when(F.col("a").isNull() | (F.greatest("a", "b") == 0), F.lit(0.0)).otherwise(
        (F.col("b") - F.col("a")) / F.greatest("a", "b")
    )
    return scored.select("key", F.col("c").alias("cluster"), value.alias("silhouette"))


def silhouette(df: DataFrame, key: str, cluster: str, features: Sequence[str] | str, **options) -> DataFrame:
    """Mean silhouette; null unless there are at least two clusters."""
    return silhouette_rows(df, key, cluster, features, **options).agg(
        F.when(F.count_distinct("cluster") > 1, F.avg("silhouette")).alias("silhouette")
    )


def silhouette_squared(df: DataFrame, cluster: str, features: Sequence[str] | str) -> float:
    """Silhouette on squared distances, which cluster moments give without meeting rows."""
    table = df.select(F.col(cluster).cast("double").alias("prediction"), array_to_vector(_vector(features)).alias("features"))
    return ClusteringEvaluator().evaluate(table)


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index from counts of pairs."""
    table = contingency(df, a, b)
    pairs = lambda c: c * (c - 1.0) / 2.0
    rows = table.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("ra"))
    cols = table.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("rb"))
    cells = table.agg(F.sum(pairs(F.col("n"))).alias("both"), F.sum("n").alias("total"))
    one = lambda d: d.withColumn("_k", F.lit(1))
    joined = one(cells).join(one(rows), "_k").join(one(cols), "_k")
    expected = F.col("ra") * F.col("rb") / pairs(F.col("total"))
    top = (F.col("ra") + F.col("rb")) / 2.0
    value = F.when(top == expected, F.lit(1.0)).otherwise((F.col("both") - expected) / F.nullif(top - expected, F.lit(0.0)))
    return joined.select(value.alias("ari"))


def normalized_mutual_info(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information over the mean of the two entropies."""
    table = contingency(df, a, b)
    total = table.agg(F.sum("n").alias("total"))
    rows = table.groupBy("a").agg(F.sum("n").alias("na"))
    cols = table.groupBy("b").agg(F.sum("n").alias("nb"))
    one = lambda d: d.withColumn("_k", F.lit(1))
    cells = one(table.join(rows, "a").join(cols, "b")).join(one(total), "_k")
    n, t = F.col("n"), F.col("total")
    shared = cells.agg(F.sum(n / t * F.log(n * t / (F.col("na") * F.col("nb")))).alias("mi"))
    entropy = lambda d, c, name: one(d).join(one(total), "_k").agg((-F.sum(F.col(c) / t * F.log(F.col(c) / t))).alias(name))
    joined = one(shared).join(one(entropy(rows, "na", "ha")), "_k").join(one(entropy(cols, "nb", "hb")), "_k")
    mean = (F.col("ha") + F.col("hb")) / 2.0
    return joined.select(F.when(mean == 0, F.lit(1.0)).otherwise(F.col("mi") / F.nullif(mean, F.lit(0.0))).alias("nmi"))
