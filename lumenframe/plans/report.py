"""Result tables in one long form, and reports as text lines."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.stats import numeric_columns, string_columns
from lumenframe.functions.text import fixed
from lumenframe.operators import charts, profile
from lumenframe.plans.clean import CleaningConfig, clean, masked, prepare
from lumenframe.session import cut_lineage


def _long(df: DataFrame, section: str, item: str, stat: Column, value: Column, text: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        F.col(item).cast("string").alias("item"),
        stat.cast("string").alias("stat"),
        value.cast("double").alias("value"),
        (F.lit(None) if text is None else text).cast("string").alias("text"),
    )


def statistics(df: DataFrame, config: CleaningConfig, descriptions: DataFrame | None = None) -> DataFrame:
    """Clean a table and describe it: ``(section, item, stat, value, text)``.

    Statistics and correlations are of the cleaned table, quality figures of the table as loaded
    (with outlier cells blanked), descriptions are joined by column name.
    """
    cleaned = cut_lineage(clean(df, config))
    cols = [c for c in numeric_columns(cleaned) if c != config.key]
    parts = [_long(profile.describe_numeric(cleaned, cols), "describe", "column", F.col("stat"), F.col("value"))]
    parts.append(_long(profile.correlation(cleaned, cols), "correlation", "row", F.col("col"), F.col("corr")))
    quality = profile.quality(masked(prepare(df, config), config))
    quality = quality.unpivot("column", ["nulls", "duplicates"], "stat", "value")
    parts.append(_long(quality, "quality", "column", F.col("stat"), F.col("value")))
    if descriptions is not None:
        names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
        joined = profile.describe_columns(names, descriptions)
        parts.append(_long(joined, "description", "column", F.lit("text"), F.lit(None), F.col("description")))
    return reduce(DataFrame.unionByName, parts)


def inspect(df: DataFrame, key: str) -> DataFrame:
    """Shape, first and last rows, column facts, statistics and correlations of any table."""
    parts = [_long(profile.shape(df), "shape", "summary", F.lit("rows"), F.col("n_rows"))]
    for name, rows in (("head", profile.head(df, key)), ("tail", profile.tail(df, key))):
        parts.append(_long(rows, name, key, F.lit("row"), F.lit(None), F.to_json(F.struct(*df.columns))))
    info = profile.column_info(df)
    facts = ["non_null", "missing", "missing_pct", "distinct_values"]
    info = info.withColumns({c: F.col(c).cast("double") for c in facts}).unpivot(["column", "dtype"], facts, "stat", "value")
    parts.append(_long(info, "info", "column", F.col("stat"), F.col("value"), F.col("dtype")))
    cols = [c for c in numeric_columns(df) if c != key]
    if cols:
        parts.append(_long(profile.describe_numeric(df, cols), "describe", "column", F.col("stat"), F.col("value")))
        parts.append(_long(profile.correlation(df, cols), "correlation", "row", F.col("col"), F.col("corr")))
    return reduce(DataFrame.unionByName, parts)


def automatic_charts(df: DataFrame, max_cols: int = 5, max_slices: int = 15, max_heat: int = 20) -> DataFrame:
    """Chart data for the first columns of each kind: histogram, box and density per number, a
    correlation map, and shares for texts with few values. ``(chart, item, label, x, y)``."""

    def rows(d: DataFrame, chart: str, item: str, label, x, y) -> DataFrame:
        return d.select(
            F.lit(chart).alias("chart"), F.lit(item).alias("item"), label.cast("string").alias("label"),
            x.cast("double").alias("x"), y.cast("double").alias("y"),
        )

    parts = []
    numbers = numeric_columns(df)[:max_cols]
    none = F.lit(None)
    for c in numbers:
        parts.append(rows(charts.histogram(df, c), "hist", c, F.col("bin"), F.col("bin_start"), F.col("n")))
        b = charts.box(df, c)
        cells = [F.struct(F.lit(s).alias("s"), F.col(s).cast("double").alias("v")) for s in ("lower", "q1", "median", "q3", "upper", "outliers")]
        figures = b.select(F.inline(F.array(*cells)))
        parts.append(rows(figures, "box", c, F.col("s"), none, F.col("v")))
        curve = charts.density(df, c)
        parts.append(rows(curve, "violin", c, F.col("point"), F.col("x"), F.col("density")))
        parts.append(rows(curve, "kde", c, F.col("point"), F.col("x"), F.col("density")))
    if 2 <= len(numbers) <= max_heat:
        heat = profile.correlation(df, numbers)
        parts.append(rows(heat, "heatmap", "all", F.concat_ws("|", "row", "col"), none, F.col("corr")))
    texts = string_columns(df)[:max_cols]
    if texts:
        distinct = df.agg(*[F.count_distinct(c).alias(c) for c in texts]).first()
        for c in texts:
            if distinct[c] <= max_slices:
                parts.append(rows(charts.pie(df, c), "pie", c, F.col(c), F.col("n"), F.col("share")))
    return reduce(DataFrame.unionByName, parts)


def apply_user(df: DataFrame, step: Callable[[DataFrame], DataFrame] | str, view: str = "df") -> DataFrame:
    """Run a user's step on a table: a function, or SQL over the view ``df``. It must give a table.

    A view of the caller with that name is there again afterwards.
    """
    if isinstance(step, str):
        spark = df.sparkSession
        before = spark.table(view) if spark.catalog.tableExists(view) else None
        df.createOrReplaceTempView(view)
        try:
            return spark.sql(step)  # the plan is resolved; the name is no longer needed
        finally:
            spark.catalog.dropTempView(view)
            if before is not None:
                before.createOrReplaceTempView(view)
    out = step(df)
    if not isinstance(out, DataFrame):
        raise TypeError("the step must return a DataFrame")
    return out


def metric_lines(metrics: DataFrame, importance: DataFrame | None = None, kind: str = "markdown") -> DataFrame:
    """``(line_no, line)`` of a report: metric rows at four decimals, importances from the highest down.

    ``metrics`` has one row per metric and ``importance`` one per feature: a report is small by nature.
    """
    if kind == "markdown":
        form = lambda a, b: F.concat(F.lit("| "), a, F.lit(" | "), b, F.lit(" |"))
    elif kind == "html":
        form = lambda a, b: F.concat(F.lit("<tr><td>"), a, F.lit("</td><td>"), b, F.lit("</td></tr>"))
    else:
        form = lambda a, b: F.to_json(F.struct(a.alias("name"), b.alias("value")))
    rows = metrics.select(F.lit(0).alias("part"), F.lit(0.0).alias("place"), F.col("metric").alias("name"), fixed(F.col("value")).alias("shown"))
    if importance is not None:
        rows = rows.unionByName(
            importance.select(F.lit(1).alias("part"), (-F.col("importance")).alias("place"), F.col("feature").alias("name"), fixed(F.col("importance")).alias("shown"))
        )
    order = Window.partitionBy(F.lit(0)).orderBy("part", "place", "name")
    return rows.select(F.row_number().over(order).cast("long").alias("line_no"), form(F.col("name"), F.col("shown")).alias("line"))

