"""Statistics that every fitted step shares: one-pass aggregates, value frequencies, exact quantiles.

Results that go to the driver are one row of aggregates per table, never data rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.ordering import running_totals

# Most distinct values an in-memory exact percentile may hold per column, and most rows of a column
# whose distinct values one task may rank.
DIRECT_VALUES = 50_000
RANK_VALUES = 5_000_000
SKETCH_ACCURACY = 10_000


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns; booleans and dates are not numeric."""
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in skip]


def number(name: str) -> Column:
    """A column as double with NaN read as null."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


def long_numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(i, x)``: every numeric cell with the place of its column, without a shuffle.

    Aggregates per ``i`` keep the generated code the same size however many columns there are; a
    wide list of aggregates would outgrow what the JVM compiles.
    """
    return df.select(F.posexplode(F.array(*[number(c) for c in cols])).alias("i", "x"))


def collect_stats(df: DataFrame, aggregates: dict, width: int = 40) -> dict:
    """Run many aggregates in as few passes as the width allows; one row comes back per pass."""
    keys = list(aggregates)
    out = {}
    for start in range(0, len(keys), width):
        part = keys[start : start + width]
        row = df.agg(*[aggregates[k].alias(f"s{i}") for i, k in enumerate(part)]).first()
        out.update(zip(part, row))
    return out


def melt(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long form ``(column, value)`` with values as text and NaN as missing, without a shuffle."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    whole = lambda c: F.when(~F.isnan(c), F.col(c)) if c in floating else F.col(c)
    cells = [F.struct(F.lit(c).alias("column"), whole(c).cast("string").alias("value")) for c in cols]
    return df.select(F.inline(F.array(*cells)))


def frequencies(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` for every column in one shuffle; counts are combined before it."""
    return melt(df, cols).groupBy("column", "value").agg(F.count("*").alias("n"))


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], *, direct_values: int | None = None
) -> dict[str, list[float]]:
    """Exact, linearly interpolated quantiles per column.

    A column whose values fit a bounded map goes through ``percentile``. Up to a few million rows its
    values are counted and ranked. Any other column is narrowed: a sketch brackets the wanted rank,
    exact counts confirm the bracket, and this repeats until few values are left inside it.
    """
    limit = DIRECT_VALUES if direct_values is None else direct_values
    rank_limit = RANK_VALUES if direct_values is None else 4 * direct_values
    cols = list(cols)
    if not cols:
        return {}
    found = long_numbers(df, cols).groupBy("i").agg(F.count("x").alias("n"), F.approx_count_distinct("x").alias("d"))
    held = {cols[row["i"]]: row for row in found.collect()}
    size = {c: held[c]["n"] if c in held else 0 for c in cols}
    small = [c for c in cols if size[c] <= limit or held[c]["d"] <= limit]
    grid = F.array(*[F.lit(float(p)) for p in probs])
    out = {c: [None] * len(probs) for c in small}
    for start in range(0, len(small), 8):
        part = small[start : start + 8]
        for row in long_numbers(df, part).groupBy("i").agg(F.percentile("x", grid).alias("q")).collect():
            if row["q"] is not None:
                out[part[row["i"]]] = list(row["q"])
    middle = [c for c in cols if c not in out and size[c] <= rank_limit]
    if middle:
        out |= _ranked_quantiles(df, middle, probs, size)
    large = [c for c in cols if c not in out]
    if len(probs) > 20:
        # A whole grid of quantiles is read off one ranking instead of narrowed one by one.
        for c in large:
            out[c] = _grid_quantiles(df, c, probs, size[c])
    elif large:
        wanted = {}
        for c in large:
            for p in probs:
                place = (size[c] - 1) * p
                wanted[c, math.floor(place)] = None
                wanted[c, math.ceil(place)] = None
        values = _order_statistics(df, wanted, size, limit)
        for c in large:
            out[c] = []
            for p in probs:
                place = (size[c] - 1) * p
                low, high = values[c, math.floor(place)], values[c, math.ceil(place)]
                out[c].append(low + (high - low) * (place - math.floor(place)))
    return {c: out[c] for c in cols}


def _ranked_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], size: dict) -> dict:
    """Quantiles read off the running count of distinct values, one task per column."""
    values = long_numbers(df, cols).where("x is not null").groupBy("i", "x").agg(F.count("*").alias("n"))
    run = Window.partitionBy("i").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.select("i", "x", "n", F.sum("n").over(run).alias("cum"))
    wanted = {i: _wanted_ranks(size[c], probs) for i, c in enumerate(cols)}
    held: dict[int, dict[int, float]] = {i: {} for i in wanted}
    for row in ranked.select("i", "x", "n", "cum").mapInPandas(_at_ranks(wanted), "i int, rank long, x double").collect():
        held[row["i"]][row["rank"]] = row["x"]
    return {c: _between(held[i], size[c], probs) for i, c in enumerate(cols)}


def _grid_quantiles(df: DataFrame, col: str, probs: Sequence[float], size: int) -> list[float]:
    """Many quantiles of one large column: distinct values are counted and ranked in buckets, wanted ranks are read off the running counts."""
    counts = df.select(number(col).alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    ranked = running_totals(counts, "x", ["n"]).select(F.lit(0).alias("i"), "x", "n", F.col("cum_n").alias("cum"))
    found = ranked.mapInPandas(_at_ranks({0: _wanted_ranks(size, probs)}), "i int, rank long, x double").collect()
    return _between({row["rank"]: row["x"] for row in found}, size, probs)


def _wanted_ranks(size: int, probs: Sequence[float]) -> np.ndarray:
    """Rising 0-based ranks on either side of every quantile."""
    places = [(size - 1) * float(p) for p in probs]
    return np.unique([turn(place) for place in places for turn in (math.floor, math.ceil)])


def _at_ranks(wanted: dict[int, np.ndarray]):
    """Values ``(i, x, n, cum)`` with their running counts to ``(i, rank, x)``: a value holds the ranks from ``cum - n`` to below ``cum``."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for b in batches:
            for i, part in b.groupby("i"):
                cum, x = part["cum"].to_numpy(), part["x"].to_numpy()
                first, end = (np.searchsorted(wanted[i], at) for at in (cum - part["n"].to_numpy(), cum))
                for k in np.flatnonzero(first < end):
                    yield pd.DataFrame({"i": np.int32(i), "rank": wanted[i][first[k] : end[k]], "x": x[k]})

    return run


def _between(held: dict[int, float], size: int, probs: Sequence[float]) -> list[float]:
    """Linearly interpolated quantiles from the values at their ranks."""
    out = []
    for p in probs:
        place = (size - 1) * float(p)
        low, high = held[math.floor(place)], held[math.ceil(place)]
        out.append(low + (high - low) * (place - math.floor(place)))
    return out


def _order_statistics(df: DataFrame, wanted: dict, sizes: dict[str, int], limit: int) -> dict:
    """Values at 0-based ranks, ``{(column, rank): value}``, each found by narrowing a bracket."""
    bracket = {t: (float("-inf"), float("inf"), 0, sizes[t[0]]) for t in wanted}
    slack = {t: 4.0 / SKETCH_ACCURACY for t in wanted}
    open_ = dict.fromkeys(wanted)
    while open_:
        sketch = {}
        for c, r in open_:
            low, high, before, inside = bracket[c, r]
            p = (r - before + 0.5) / inside
            ends = [max(0.0, p - slack[c, r]), min(1.0, p + slack[c, r])]
            x = number(c)
            sketch[c, r] = F.percentile_approx(
                F.when(x.between(low, high), x), F.array(*map(F.lit, ends)), SKETCH_ACCURACY
            )
        ends = collect_stats(df, sketch, width=40)
        checks = {}
        for (c, r), (low, high) in ends.items():
            x = number(c)
            held = x.between(low, high)
            checks["before", c, r] = F.count(F.when(x < low, 1))
            checks["inside", c, r] = F.count(F.when(held, 1))
            checks["distinct", c, r] = F.approx_count_distinct(F.when(held, x))
        seen = collect_stats(df, checks)
        for c, r in list(open_):
            low, high = ends[c, r]
            before, inside = seen["before", c, r], seen["inside", c, r]
            if not before <= r < before + inside:
                slack[c, r] *= 4
                continue
            stuck = inside == bracket[c, r][3]
            bracket[c, r] = (low, high, before, inside)
            if low == high or inside <= limit or seen["distinct", c, r] <= limit or stuck:
                del open_[c, r]
    found = {}
    for (c, r), (low, high, before, _) in bracket.items():
        if low == high:
            found[c, r] = low
            continue
        x = number(c)
        counts = df.where(x.between(low, high)).groupBy(x.alias("v")).agg(F.count("*").alias("n"))
        ranked = running_totals(counts, "v", ["n"])
        found[c, r] = ranked.where(F.col("cum_n") > r - before).agg(F.min("v")).first()[0]
    return found


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    col: str,
    probs: Sequence[float],
    *,
    direct_values: int | None = None,
    bucket_rows: int | None = None,
) -> DataFrame:
    """Exact quantiles of ``col`` per group: one row per group with an array column ``q``.

    Small tables use ``percentile``. Beyond that no group is gathered in one place: distinct values
    are counted, ranked by bucketed running totals, and the wanted ranks are picked by aggregation.
    A group without any value is a row with a null ``q``, at every size.
    """
    limit = DIRECT_VALUES if direct_values is None else direct_values
    rows = df.select(F.count(number(col))).first()[0]
    if rows <= limit:
        grid = F.array(*[F.lit(float(p)) for p in probs])
        return df.groupBy(*keys).agg(F.percentile(number(col), grid).alias("q"))
    named = [F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    names = [f"k{i}" for i in range(len(keys))]
    counts = (
        df.select(*named, number(col).alias("v")).where("v is not null").groupBy(*names, "v")
        .agg(F.count("*").alias("n"))
    )
    if bucket_rows is None and rows <= RANK_VALUES:
        whole = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
        run = whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumns({"cum_n": F.sum("n").over(run), "total": F.sum("n").over(whole)})
    else:
        ranked = running_totals(counts, "v", ["n"], names, bucket_rows=bucket_rows)
        if names:
            totals = counts.groupBy(*names).agg(F.sum("n").alias("total"))
            same = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in names]
            ranked = ranked.alias("r").join(totals.alias("t"), same).select("r.*", "t.total")
        else:
            ranked = ranked.withColumn("total", F.lit(rows))
    picks = []
    for i, p in enumerate(probs):
        place = (F.col("total") - 1) * F.lit(float(p))
        picks.append(F.min(F.when(F.col("cum_n") > F.floor(place), F.col("v"))).alias(f"lo{i}"))
        picks.append(F.min(F.when(F.col("cum_n") > F.ceil(place), F.col("v"))).alias(f"hi{i}"))
        picks.append(F.max(place - F.floor(place)).alias(f"fr{i}"))
    q = F.array(*[F.expr(f"lo{i} + (hi{i} - lo{i}) * fr{i}") for i in range(len(probs))])
    found = ranked.groupBy(*names).agg(*picks).select(*names, q.alias("q"))
    if names:
        groups = df.select(*named).distinct()
        same = [F.col(f"g.{k}").eqNullSafe(F.col(f"f.{k}")) for k in names]
        found = groups.alias("g").join(found.alias("f"), same, "left").select("g.*", "f.q")
    return found.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "q")


def bessel_skewness(c: Column) -> Column:
    """Sample skewness with the bias correction that pandas reports."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0)))


def bessel_kurtosis(c: Column) -> Column:
    """Sample excess kurtosis with the bias correction that pandas reports."""
    n = F.count(c)
    scale = F.nullif((n - 2.0) * (n - 3.0), F.lit(0.0))
    return F.when(n > 3, ((n + 1.0) * F.kurtosis(c) + 6.0) * (n - 1.0) / scale)


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group; Spark trims groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= n)
