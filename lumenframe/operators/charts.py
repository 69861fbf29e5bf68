"""The data behind charts: bins, boxes, densities, shares, trees of sums and point sets."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.stats import collect_stats, grouped_quantiles, number
from lumenframe.operators.profile import sample_seeded


def histogram(df: DataFrame, x: str, bins: int = 20, color: Sequence[str] = ()) -> DataFrame:
    """Counts per equal-width bin (and colour) between the smallest and the largest value."""
    ends = collect_stats(df, {"lo": F.min(number(x)), "hi": F.max(number(x))})
    lo, hi = ends["lo"], ends["hi"]
    if lo is None:
        lo, hi = 0.0, 1.0
    width = (hi - lo) / bins or 1.0
    place = F.least(F.floor((number(x) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("long")
    return (
        df.where(number(x).isNotNull()).groupBy(place.alias("bin"), *color).agg(F.count("*").alias("n"))
        .withColumn("bin_start", F.lit(lo) + F.col("bin") * F.lit(width))
    )


def count_plot(df: DataFrame, x: str, color: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(x, *color).agg(F.count("*").alias("n"))


def bar(df: DataFrame, x: str, y: str, color: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(x, *color).agg(F.sum(y).alias("total"))


def pie(df: DataFrame, name: str, values: str | None = None, top: int = 15) -> DataFrame:
    """Share per name among the ``top`` most frequent names."""
    size = F.sum(values) if values else F.count("*").cast("double")
    slices = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"), size.alias("size"))
    kept = slices.orderBy(F.col("n").desc(), F.col(name)).limit(top)
    whole = F.sum("size").over(Window.partitionBy(F.lit(0)))
    return kept.select(name, "n", "size", (F.col("size") / whole).alias("share"))


def treemap(df: DataFrame, path: Sequence[str], value: str) -> DataFrame:
    """Sums along a path of columns, at every level down from the root."""
    return df.rollup(*path).agg(
        F.sum(value).alias("total"),
        F.count("*").alias("n"),
        (F.lit(len(path)) - F.bit_count(F.grouping_id())).cast("long").alias("level"),
    )


def radar(df: DataFrame, r: str, theta: str, color: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(theta, *color).agg(F.avg(r).alias("mean"))


def box(df: DataFrame, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers at the last points inside the fence, and the number of points beyond."""
    quartiles = grouped_quantiles(df, keys, y, (0.25, 0.5, 0.75))
    boxes = quartiles.select(
        *keys,
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
        (F.col("q")[0] - 1.5 * (F.col("q")[2] - F.col("q")[0])).alias("_lo"),
        (F.col("q")[2] + 1.5 * (F.col("q")[2] - F.col("q")[0])).alias("_hi"),
    )
    points = df.select(*keys, number(y).alias("_y")).where("_y is not null")
    if keys:
        named = boxes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "q1", "median", "q3", "_lo", "_hi")
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        joined = points.join(named, same)
    else:
        b = boxes.first()
        joined = points.withColumns({c: F.lit(b[c]) for c in boxes.columns})
    inside = F.col("_y").between(F.col("_lo"), F.col("_hi"))
    return joined.groupBy(*keys).agg(
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("_y"))).alias("lower"),
        F.max(F.when(inside, F.col("_y"))).alias("upper"),
        F.count_if(~inside).alias("outliers"),
    )


def density(df: DataFrame, x: str, points: int = 100, bins: int = 1024) -> DataFrame:
    """Gaussian kernel density on an even grid, Scott's bandwidth, from binned counts.

    Rows are only binned; the kernel sums run over at most ``bins`` rows. Without any value there are no points.
    """
    s = collect_stats(
        df,
        {"n": F.count(number(x)), "s": F.stddev_samp(number(x)), "lo": F.min(number(x)), "hi": F.max(number(x))},
    )
    n, lo, hi = s["n"], s["lo"], s["hi"]
    if not n:
        return df.sparkSession.createDataFrame([], "point long, x double, density double")
    width = (s["s"] or 1.0) * n ** (-0.2)
    step = (hi - lo) / bins or 1.0
    place = F.least(F.floor((number(x) - F.lit(lo)) / F.lit(step)), F.lit(bins - 1))
    counts = df.where(number(x).isNotNull()).groupBy(place.alias("b")).agg(F.count("*").alias("w"))
    centre = F.lit(lo) + (F.col("b") + 0.5) * F.lit(step)
    grid = counts.select(centre.alias("c"), "w", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    at = F.lit(lo) + F.col("i") * F.lit((hi - lo) / (points - 1))
    z = (at - F.col("c")) / F.lit(width)
    kernel = F.col("w") * F.exp(-0.5 * z * z)
    scale = n * width * 2.5066282746310002
    return grid.groupBy("i").agg((F.sum(kernel) / F.lit(scale)).alias("density")).select(
        F.col("i").cast("long").alias("point"),
        (F.lit(lo) + F.col("i") * F.lit((hi - lo) / (points - 1))).alias("x"),
        "density",
    )


def violin(df: DataFrame, y: str, points: int = 100) -> DataFrame:
    """Density points with the box figures beside them."""
    b = box(df, y).first()
    figures = {c: F.lit(b[c]).cast("double") for c in ("q1", "median", "q3", "lower", "upper")}
    return density(df, y, points).withColumns({**figures, "outliers": F.lit(b["outliers"]).cast("long")})


def scatter(df: DataFrame, cols: Sequence[str], key: str | None = None, n: int | None = None) -> DataFrame:
    """Point set; with ``n`` a reproducible draw of that many points."""
    picked = df if n is None else sample_seeded(df, key, n)
    return picked.select(*cols)


def pair_points(df: DataFrame, key: str, dims: Sequence[str]) -> DataFrame:
    """``(key, x_col, y_col, x, y)`` for every pair of dimensions, without a join."""
    cells = [
        F.struct(
            F.lit(a).alias("x_col"), F.lit(b).alias("y_col"), number(a).alias("x"), number(b).alias("y")
        )
        for a, b in combinations(dims, 2)
    ]
    return df.select(key, F.inline(F.array(*cells)))


def series(df: DataFrame, time: str, unit: str, value: str, color: Sequence[str] = ()) -> DataFrame:
    """One value per time step and line, to be read in the order of ``step``."""
    step = F.date_format(F.date_trunc(unit, F.col(time)), "yyyy-MM-dd HH:mm:ss")
    return df.groupBy(step.alias("step"), *color).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def group_share(df: DataFrame, x: Sequence[str], color: Sequence[str], y: str) -> DataFrame:
    """Share of each colour in its group; sums come first, so the window sees one row per colour."""
    sums = df.groupBy(*x, *color).agg(F.sum(y).alias("total"))
    return sums.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy(*x)))
