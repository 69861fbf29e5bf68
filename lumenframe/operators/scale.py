"""Row norms and column scalers.

Column scalers fit with aggregates only and apply as projections of literals. Population deviations
and exact quantiles are used, which the ready-made estimators of Spark ML do not offer.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.stats import collect_stats, exact_quantiles, number, numeric_columns

# Names of the normalisers and scalers.
NORMALIZERS = ("L1 Normalization", "L2 Normalization", "Max Normalization", "Min-Max Scaling (0-1)", "Max-Abs Scaling")
SCALERS = (
    "Standard Scaler",
    "Min-Max Scaler",
    "Max-Abs Scaler",
    "Robust Scaler",
    "Power Transformer (Yeo-Johnson)",
    "Power Transformer (Box-Cox)",
    "Quantile Transformer (Uniform)",
    "Quantile Transformer (Normal)",
    "L2 Normalizer",
)


def _cols(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    return list(cols) if cols is not None else numeric_columns(df)


def normalize_rows(df: DataFrame, norm: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Divide each row by its ``l1``, ``l2`` or ``max`` norm; a zero row stays as it is."""
    cols = _cols(df, cols)
    if not cols:
        return df
    if norm == "l1":
        size = reduce(Column.__add__, [F.abs(number(c)) for c in cols])
    elif norm == "l2":
        size = F.sqrt(reduce(Column.__add__, [number(c) * number(c) for c in cols]))
    elif norm == "max":
        size = F.greatest(*[F.abs(number(c)) for c in cols]) if len(cols) > 1 else F.abs(number(cols[0]))
    else:
        raise ValueError(f"unknown norm: {norm}")
    sized = df.withColumn("_norm", F.when(size == 0, F.lit(1.0)).otherwise(size))
    return sized.withColumns({c: number(c) / F.col("_norm") for c in cols}).drop("_norm")


def _affine(df: DataFrame, fit: dict[str, tuple[float, float]]) -> DataFrame:
    """``(x - shift) / spread`` per column; a spread of zero divides by one."""
    return df.withColumns(
        {
            c: (number(c) - F.lit(float(shift))) / F.lit(float(spread) or 1.0)
            for c, (shift, spread) in fit.items()
            if shift is not None and spread is not None
        }
    )


def min_max(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Scale to [0, 1]; a constant column becomes 0."""
    cols = _cols(df, cols)
    s = collect_stats(df, {("a", c): F.min(number(c)) for c in cols} | {("b", c): F.max(number(c)) for c in cols})
    return _affine(df, {c: (s["a", c], s["b", c] - s["a", c]) for c in cols if s["a", c] is not None})


def max_abs(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = _cols(df, cols)
    s = collect_stats(df, {c: F.max(F.abs(number(c))) for c in cols})
    return _affine(df, {c: (0.0, s[c]) for c in cols})


def standard(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = _cols(df, cols)
    s = collect_stats(
        df, {("m", c): F.avg(number(c)) for c in cols} | {("s", c): F.stddev_pop(number(c)) for c in cols}
    )
    return _affine(df, {c: (s["m", c], s["s", c]) for c in cols})


def robust(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = _cols(df, cols)
    q = exact_quantiles(df, cols, (0.25, 0.5, 0.75))
    return _affine(df, {c: (m, hi - lo) for c, (lo, m, hi) in q.items() if m is not None})


def yeo_johnson_value(x: Column, power: Column) -> Column:
    two = 2.0 - power
    up = F.when(F.abs(power) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1.0, power) - 1.0) / power)
    down = F.when(F.abs(two) < 1e-12, F.log1p(-x)).otherwise((F.pow(1.0 - x, two) - 1.0) / two)
    return F.when(x >= 0, up).otherwise(-down)


def box_cox_value(x: Column, power: Column) -> Column:
    return F.when(F.abs(power) < 1e-12, F.log(x)).otherwise((F.pow(x, power) - 1.0) / power)


def _best_powers(df: DataFrame, cols: Sequence[str], value, log_part, zooms: int = 5) -> dict[str, float]:
    """Power of greatest likelihood per column: one pass per zoom scores a grid for all columns."""
    centre = dict.fromkeys(cols, 0.5)
    reach = dict.fromkeys(cols, 4.0)
    base = collect_stats(
        df, {("n", c): F.count(number(c)) for c in cols} | {("l", c): F.sum(log_part(number(c))) for c in cols}
    )
    grid = np.linspace(-1.0, 1.0, 17)
    tries = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(cols)]).withColumn(
        "step", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1)))
    )
    for _ in range(zooms):
        powers = {c: [float(centre[c] + reach[c] * p) for p in grid] for c in cols}
        aggs = []
        for i, c in enumerate(cols):
            power = F.array(*map(F.lit, powers[c]))[F.col("step")]
            aggs.append(F.var_pop(value(F.col(f"x{i}"), power)).alias(f"v{i}"))
        spread = {row["step"]: row for row in tries.groupBy("step").agg(*aggs).collect()}
        for i, c in enumerate(cols):
            scored = []
            for step, p in enumerate(grid):
                v = spread[step][f"v{i}"] if step in spread else None
                if v and np.isfinite(v):
                    power = powers[c][step]
                    scored.append((-base["n", c] / 2 * np.log(v) + (power - 1) * base["l", c], p, power))
            if scored:
                _, p, centre[c] = max(scored)
                # A best value at the end of the grid moves the grid on instead of zooming in.
                reach[c] = reach[c] if abs(p) == 1.0 else reach[c] / 6
    return centre


def yeo_johnson(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Yeo-Johnson power of maximum likelihood per column, then zero mean and unit deviation."""
    cols = _cols(df, cols)
    powers = _best_powers(df, cols, yeo_johnson_value, lambda x: F.signum(x) * F.log1p(F.abs(x)))
    return standard(df.withColumns({c: yeo_johnson_value(number(c), F.lit(float(powers[c]))) for c in cols}), cols)


def box_cox(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Box-Cox for positive columns; any other value is an error."""
    cols = _cols(df, cols)
    low = collect_stats(df, {c: F.min(number(c)) for c in cols})
    bad = [c for c in cols if low[c] is not None and low[c] <= 0]
    if bad:
        raise ValueError(f"Box-Cox needs positive values: {', '.join(bad)}")
    powers = _best_powers(df, cols, box_cox_value, F.log)
    return standard(df.withColumns({c: box_cox_value(number(c), F.lit(float(powers[c]))) for c in cols}), cols)


#: Coefficients of Wichura's AS 241 (1988), the constant last: numerators and denominators of the middle, the near and the far tails.
_MIDDLE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427,
     133.14166789178437745, 3.387132872796366608),
    (5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083,
     42.313330701600911252, 1.0),
)
_NEAR = (
    (7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504,
     5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455,
     1.6763848301838038494, 2.05319162663775882187, 1.0),
)
_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093, 0.29656057182850489123,
     1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772),
    (2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4, 0.0148753612908506148525,
     0.13692988092273580531, 0.59983220655588793769, 1.0),
)


def inverse_normal(p: np.ndarray) -> np.ndarray:
    """Quantiles of the standard normal distribution for whole arrays (0 < p < 1), by the method of Python's ``NormalDist``."""
    ratio = lambda t, x: np.polyval(t[0], x) / np.polyval(t[1], x)
    q = p - 0.5
    tail = np.sqrt(-np.log(np.minimum(p, 1.0 - p)))
    outer = np.where(tail <= 5.0, ratio(_NEAR, tail - 1.6), ratio(_FAR, tail - 5.0))
    return np.where(np.abs(q) <= 0.425, ratio(_MIDDLE, 0.180625 - q * q) * q, np.copysign(outer, q))


def quantile(df: DataFrame, cols: Sequence[str] | None = None, *, output: str = "uniform", n: int = 1000) -> DataFrame:
    """Map each column to its empirical distribution function; values of a tie take its midpoint.

    The fit is a table of at most ``n`` quantiles per column, exact over all rows.
    """
    cols = _cols(df, cols)
    rows = df.count()
    n = max(2, min(n, rows))
    grid = np.linspace(0.0, 1.0, n)
    tables = exact_quantiles(df, cols, [float(p) for p in grid])

    def mapper(q: np.ndarray):
        @F.pandas_udf("double")
        def apply(s: pd.Series) -> pd.Series:
            x = s.to_numpy(dtype=float)
            up = np.interp(x, q, grid)
            down = -np.interp(-x, -q[::-1], -grid[::-1])
            out = 0.5 * (up + down)
            out = np.where(x <= q[0], 0.0, np.where(x >= q[-1], 1.0, out))
            if output == "normal":
                out = inverse_normal(np.clip(out, 1e-7, 1.0 - 1e-7))
            return pd.Series(out).where(~np.isnan(x), None)

        return apply

    exprs = {}
    for c in cols:
        if tables[c][0] is not None:
            q = np.maximum.accumulate(np.array(tables[c], dtype=float))
            mapped = mapper(q)(F.coalesce(number(c), F.lit(float("nan"))))
            exprs[c] = F.when(number(c).isNotNull(), mapped)
    return df.withColumns(exprs) if exprs else df


def normalize(df: DataFrame, method: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Normalise by name."""
    steps = {
        "L1 Normalization": lambda: normalize_rows(df, "l1", cols),
        "L2 Normalization": lambda: normalize_rows(df, "l2", cols),
        "Max Normalization": lambda: normalize_rows(df, "max", cols),
        "Min-Max Scaling (0-1)": lambda: min_max(df, cols),
        "Max-Abs Scaling": lambda: max_abs(df, cols),
    }
    if method not in steps:
        raise ValueError(f"unknown normalization: {method}")
    return steps[method]()


def scale(df: DataFrame, method: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Scale by name."""
    steps = {
        "Standard Scaler": lambda: standard(df, cols),
        "Min-Max Scaler": lambda: min_max(df, cols),
        "Max-Abs Scaler": lambda: max_abs(df, cols),
        "Robust Scaler": lambda: robust(df, cols),
        "Power Transformer (Yeo-Johnson)": lambda: yeo_johnson(df, cols),
        "Power Transformer (Box-Cox)": lambda: box_cox(df, cols),
        "Quantile Transformer (Uniform)": lambda: quantile(df, cols),
        "Quantile Transformer (Normal)": lambda: quantile(df, cols, output="normal"),
        "L2 Normalizer": lambda: normalize_rows(df, "l2", cols),
    }
    if method not in steps:
        raise ValueError(f"unknown scaler: {method}")
    return steps[method]()
