"""Profiles of a table: shape, columns, samples, statistics, quality, correlation, insights."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.ordering import seeded_hash
from lumenframe.functions.stats import (
    bessel_kurtosis,
    bessel_skewness,
    collect_stats,
    exact_quantiles,
    frequencies,
    long_numbers,
    number,
    numeric_columns,
    string_columns,
    top_by,
)


def shape(df: DataFrame) -> DataFrame:
    width = len(df.columns)
    rows = df.agg(F.count("*").alias("n_rows"))
    text = F.format_string("The table has %d rows and %d columns.", F.col("n_rows"), F.lit(width))
    return rows.select("n_rows", F.lit(width).cast("long").alias("n_columns"), text.alias("summary"))


def _kind_name(t: T.DataType) -> str:
    if isinstance(t, T.IntegralType):
        return "integer"
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return "float"
    return "string"


def held(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    c = F.col(name)
    floating = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return F.when(~F.isnan(c), c) if floating else c


def column_kinds(df: DataFrame, target: str | None = None) -> DataFrame:
    """Kind per non-target column that really holds a value somewhere in the table."""
    kinds = {f.name: _kind_name(f.dataType) for f in df.schema if f.name != target}
    row = df.agg(*[F.count(held(df, c)).alias(c) for c in kinds])
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(c).alias("n_values")) for c, k in kinds.items()
    ]
    return row.select(F.inline(F.array(*cells)))


def data_info(df: DataFrame) -> DataFrame:
    """Name, type and non-null count per column, with the row count of the table."""
    row = df.agg(F.count("*").alias("n_rows"), *[F.count(held(df, c)).alias(f"c_{c}") for c in df.columns])
    cells = [
        F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"c_{c}").alias("non_null"), F.col("n_rows"))
        for c, t in df.dtypes
    ]
    return row.select(F.inline(F.array(*cells)))


def column_info(df: DataFrame) -> DataFrame:
    """Non-null, missing, missing percent, distinct and type per column, from one shuffle."""
    dtype = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    held = F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
    return (
        frequencies(df, df.columns)
        .groupBy("column")
        .agg(held.alias("non_null"), (F.sum("n") - held).alias("missing"), F.count("value").alias("distinct_values"))
        .select(
            "column",
            "non_null",
            "missing",
            F.round(100.0 * F.col("missing") / (F.col("missing") + F.col("non_null")), 2).alias("missing_pct"),
            "distinct_values",
            dtype[F.col("column")].alias("dtype"),
        )
    )


def dataset_info(df: DataFrame) -> DataFrame:
    """Rows, columns, type map and a has-missing flag in one pass."""
    missing = reduce(Column.__or__, [F.bool_or(held(df, c).isNull()) for c in df.columns])
    types = ",".join(f"{c}:{t}" for c, t in df.dtypes)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(df.columns)).cast("long").alias("n_columns"),
        F.lit(types).alias("column_types"),
        missing.alias("has_missing"),
    )


def validate(df: DataFrame, target: str) -> DataFrame:
    """Nulls per column with a validity flag; an absent target is reported, not raised."""
    ok = target in df.columns
    row = df.agg(F.count("*").alias("n_rows"), *[(F.count("*") - F.count(held(df, c))).alias(f"c_{c}") for c in df.columns])
    error = F.lit(None).cast("string") if ok else F.lit(f"target column {target} not found")
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(t).alias("dtype"),
            F.col(f"c_{c}").alias("nulls"),
            F.col("n_rows"),
            F.lit(ok).alias("valid"),
            error.alias("error"),
        )
        for c, t in df.dtypes
    ]
    return row.select(F.inline(F.array(*cells)))


def value_counts(df: DataFrame, cols: Sequence[str], top_n: int | None = None) -> DataFrame:
    """Count per value per column, nulls dropped; with ``top_n`` the most frequent ones and their rank."""
    counts = frequencies(df, cols).where(F.col("value").isNotNull())
    if top_n is None:
        return counts
    return top_by(counts, ["column"], [F.col("n").desc(), F.col("value").asc()], top_n)


def sample(df: DataFrame, n: int = 30, seed: int | None = None) -> DataFrame:
    """``n`` random rows without replacement; a top-n, not a sort."""
    return df.withColumn("_r", F.rand(seed)).orderBy("_r").limit(n).drop("_r")


def sample_seeded(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The same ``n`` rows on every run; all rows when the table is not larger."""
    return df.orderBy(seeded_hash(key, seed)).limit(n)


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(F.col(key).asc()).limit(n)


def tail(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    return df.orderBy(F.col(key).desc()).limit(n).orderBy(F.col(key).asc())


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column, as ``(column, stat, value)``."""
    cols = list(cols or numeric_columns(df))
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, stat string, value double")
    quartiles = exact_quantiles(df, cols, (0.25, 0.5, 0.75))
    forms = {"count": lambda x: F.count(x).cast("double"), "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    found = collect_stats(df, {(i, s): form(number(c)).cast("double") for i, c in enumerate(cols) for s, form in forms.items()})
    stats = ["count", "mean", "std", "min", "q25", "median", "q75", "max"]
    rows = [(c, s, found[i, s]) for i, c in enumerate(cols) for s in forms]
    rows += [(c, s, quartiles[c][j]) for c in cols for j, s in enumerate(("q25", "median", "q75"))]
    rows.sort(key=lambda r: (cols.index(r[0]), stats.index(r[1])))
    return df.sparkSession.createDataFrame(rows, "column string, stat string, value double")


def describe_categorical(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, unique, top and freq per text column; equal counts go to the smaller value."""
    cols = list(cols or string_columns(df))
    counts = value_counts(df, cols)
    best = top_by(counts, ["column"], [F.col("n").desc(), F.col("value").asc()], 1)
    totals = counts.groupBy("column").agg(F.sum("n").alias("count"), F.count("*").alias("unique"))
    return totals.join(
        best.select("column", F.col("value").alias("top"), F.col("n").alias("freq")), "column", "left"
    )


def quality(df: DataFrame) -> DataFrame:
    """Nulls and repeated values per column; a repeated null counts as repeated."""
    return (
        frequencies(df, df.columns)
        .groupBy("column")
        .agg(
            F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
            (F.sum("n") - F.count("*")).alias("duplicates"),
        )
    )


def quality_totals(df: DataFrame) -> DataFrame:
    return quality(df).agg(F.sum("nulls").alias("total_nulls"), F.sum("duplicates").alias("total_duplicates"))


def _pair_sums(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(a, b, corr)`` for each pair of column numbers ``a <= b``, from one pass over the rows.

    A task adds up matrices of counts, sums and products over its rows; only those matrices are shuffled.
    Values are taken relative to some present value of their column, so that large means lose no digits.
    """
    k = len(cols)
    some = df.agg(*[F.any_value(number(c), F.lit(True)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    shift = np.array([some[i] if some[i] is not None and np.isfinite(some[i]) else 0.0 for i in range(k)])
    upper = np.triu_indices(k)

    def add(batches):
        total = np.zeros((6, k, k))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - shift
            here = ~np.isnan(x)
            x[~here] = 0.0
            m = here.astype(float)
            square = x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, square.T @ m, m.T @ square, x.T @ x])
        a, b = upper
        yield pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), *[pa.array(t[upper]) for t in total]], names=["a", "b", "n", "sx", "sy", "xx", "yy", "xy"]
        )

    cells = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(cols)])
    parts = cells.mapInArrow(add, "a long, b long, n double, sx double, sy double, xx double, yy double, xy double")
    sums = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "xx", "yy", "xy")])
    vx, vy = F.col("xx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("yy") - F.col("sy") * F.col("sy") / F.col("n")
    cov = F.col("xy") - F.col("sx") * F.col("sy") / F.col("n")
    # A spread within rounding error of zero is none.
    flat = (vx <= 1e-12 * F.col("xx")) | (vy <= 1e-12 * F.col("yy"))
    spread = F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))
    corr = F.when(F.col("n") > 0, F.when(flat, F.lit(None)).when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(cov / F.nullif(spread, F.lit(0.0))))
    return sums.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), corr.cast("double").alias("corr"))


def correlation(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson matrix in long form ``(row, col, corr)``; each pair uses the rows where both are present."""
    cols = list(cols or numeric_columns(df))
    if not cols:
        return df.sparkSession.createDataFrame([], "row string, col string, corr double")
    found = _pair_sums(df, cols)
    names = F.array(*map(F.lit, cols))
    both = F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("q")), F.struct(F.col("b").alias("p"), F.col("a").alias("q")))
    sides = F.when(F.col("a") == F.col("b"), F.slice(both, 1, 1)).otherwise(both)
    return found.select("corr", F.inline(sides)).select(
        names[F.col("p")].alias("row"), names[F.col("q")].alias("col"), "corr"
    )


def correlation_pivot(corr: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One display row per column from the long matrix."""
    return corr.groupBy("row").pivot("col", list(cols)).agg(F.first("corr"))


def describe_columns(columns: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Attach a description to each column name; names without one keep null."""
    return columns.join(descriptions, "column", "left")


def skew_kurtosis(df: DataFrame, cols: Sequence[str] | None = None, places: int = 2) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, stat string, value double")
    found = long_numbers(df, cols).groupBy("i").agg(
        F.round(bessel_skewness(F.col("x")), places).alias("skewness"),
        F.round(bessel_kurtosis(F.col("x")), places).alias("kurtosis"),
    )
    names = F.array(*map(F.lit, cols))
    return found.withColumn("column", names[F.col("i")]).unpivot("column", ["skewness", "kurtosis"], "stat", "value")


def iqr_fences(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> dict[str, tuple[float, float]]:
    q = exact_quantiles(df, cols, (0.25, 0.75))
    return {c: (lo - factor * (hi - lo), hi + factor * (hi - lo)) for c, (lo, hi) in q.items() if lo is not None}


def outlier_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Values outside the 1.5·IQR fence per numeric column."""
    cols = list(cols or numeric_columns(df))
    fences = iqr_fences(df, cols)
    if not fences:
        return df.sparkSession.createDataFrame([], "column string, outliers long")
    row = df.agg(
        *[F.count_if((number(c) < fences[c][0]) | (number(c) > fences[c][1])).alias(c) for c in fences]
    )
    return row.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("outliers")) for c in fences]))
    )


def insights(df: DataFrame, cardinality: int = 50) -> DataFrame:
    """Most missing column, constant columns, most skewed column, text columns with many values."""
    info = column_info(df)
    texts = string_columns(df)
    number_cols = numeric_columns(df)
    missing = info.where("missing > 0").agg(
        F.max_by("column", F.struct(F.col("missing"), F.col("column"))).alias("column"),
        F.max("missing").cast("double").alias("value"),
    ).where("column is not null").select(F.lit("most_missing").alias("insight"), "column", "value")
    constant = info.where("distinct_values = 1").select(
        F.lit("constant").alias("insight"), "column", F.col("distinct_values").cast("double").alias("value")
    )
    wide = info.where((F.col("distinct_values") > cardinality) & F.col("column").isin(texts)).select(
        F.lit("high_cardinality").alias("insight"), "column", F.col("distinct_values").cast("double").alias("value")
    )
    skew = skew_kurtosis(df, number_cols).where("stat = 'skewness'")
    # A column without a skewness (constant, or fewer than three values) cannot be the most skewed.
    skewed = skew.where(F.col("value").isNotNull() & ~F.isnan("value")).agg(
        F.max_by("column", F.struct(F.col("value"), F.col("column"))).alias("column"), F.max("value").alias("value")
    ).where("column is not null").select(F.lit("most_skewed").alias("insight"), "column", "value")
    return missing.unionByName(constant).unionByName(skewed).unionByName(wide)


def long_description(df: DataFrame, key: str, sample_rows: int = 5, top_n: int = 10) -> DataFrame:
    """One record with the columns, a small sample, column facts and top values, as JSON text."""
    rows = sample_seeded(df, key, sample_rows).select(F.struct(*df.columns).alias("r"))
    sample_part = json_safe(rows).agg(F.to_json(F.collect_list("r")).alias("data_sample"))
    info = data_info(df).agg(F.to_json(F.collect_list(F.struct("column", "dtype", "non_null"))).alias("data_info"))
    counts = value_counts(df, string_columns(df), top_n).agg(
        F.to_json(F.collect_list(F.struct("column", "value", "n"))).alias("value_count")
    )
    names = df.sparkSession.createDataFrame([(df.columns, 1)], "cols array<string>, one int")
    out = names
    for part in (sample_part, info, counts):
        out = out.join(part.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


def _safe(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(t, (T.DateType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return c.cast("string")
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda e: _safe(e, t.elementType))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda k, v: _safe(v, t.valueType))
    if isinstance(t, T.StructType):
        fields = [_safe(c[f.name], f.dataType).alias(f.name) for f in t.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, times become ISO text, nested values likewise."""
    return df.select(*[_safe(F.col(f.name), f.dataType).alias(f.name) for f in df.schema])
