"""Null handling for one column or a whole table.

Fits are single aggregate rows that become literals, so filling is a plain projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.stats import collect_stats, exact_quantiles, frequencies, number, numeric_columns, top_by
from lumenframe.operators.neighbors import nearest

# Names of the null handlers.
DROP_ROWS = "Drop Rows"
DROP_COLUMNS = "Drop Columns"
MEAN = "Mean Imputation"
MEDIAN = "Median Imputation"
MOST_FREQUENT = "Most Frequent Imputation"
CONSTANT = "Constant Imputation"
KNN = "KNN Imputation"
ITERATIVE = "Iterative Imputation"
METHODS = (DROP_ROWS, DROP_COLUMNS, MEAN, MEDIAN, MOST_FREQUENT, CONSTANT, KNN, ITERATIVE)


def missing(df: DataFrame, c: str) -> Column:
    """Null, or NaN in a floating column."""
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.col(c).isNull() | F.isnan(F.col(c))
    return F.col(c).isNull()


def _fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Replace missing cells by one literal per column; means and medians turn a column into double."""
    exprs = {}
    for c, v in values.items():
        if v is None:
            continue
        kind = T.DoubleType() if isinstance(v, float) else df.schema[c].dataType
        exprs[c] = F.when(missing(df, c), F.lit(v).cast(kind)).otherwise(F.col(c).cast(kind))
    return df.withColumns(exprs) if exprs else df


def drop_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(cols or df.columns))


def drop_null_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    held = collect_stats(df, {c: F.count_if(missing(df, c)) for c in cols})
    return df.drop(*[c for c in cols if held[c]])


def fill_mean(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    return _fill(df, collect_stats(df, {c: F.avg(number(c)) for c in cols}))


def fill_median(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    return _fill(df, {c: q[0] for c, q in exact_quantiles(df, cols, (0.5,)).items()})


def fill_most_frequent(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Most frequent value per column; equal counts go to the smallest value."""
    cols = list(cols or df.columns)
    numeric = set(numeric_columns(df))
    counts = frequencies(df, cols).where(F.col("value").isNotNull() & (F.col("value") != "NaN"))
    by_number = F.when(F.col("column").isin([c for c in cols if c in numeric]), F.expr("try_cast(value as double)"))
    best = top_by(counts, ["column"], [F.col("n").desc(), by_number.asc(), F.col("value").asc()], 1)
    modes = {row["column"]: row["value"] for row in best.collect()}
    exprs = {}
    for c, v in modes.items():
        kind = df.schema[c].dataType
        exprs[c] = F.when(missing(df, c), F.lit(v).cast(kind)).otherwise(F.col(c))
    return df.withColumns(exprs) if exprs else df


def fill_constant(df: DataFrame, cols: Sequence[str] | None = None, value=0) -> DataFrame:
    cols = list(cols or df.columns)
    exprs = {c: F.when(missing(df, c), F.lit(value).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in cols}
    return df.withColumns(exprs)


def fill_knn(df: DataFrame, key: str, cols: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """Missing cells take the mean of the ``k`` nearest rows that hold the column.

    Distance is Euclidean over the columns both rows hold, scaled up for the ones they do not.
    A cell with no usable neighbour takes the column mean.
    """
    cols = list(cols or numeric_columns(df, [key]))
    means = collect_stats(df, {c: F.avg(number(c)) for c in cols})
    gaps = collect_stats(df, {c: F.count_if(missing(df, c)) for c in cols})
    out = df
    for c in cols:
        if not gaps[c]:
            continue
        others = [x for x in cols if x != c]
        found = nearest(
            df.where(missing(df, c)), df.where(~missing(df, c)), key, key, others, k, nan_aware=True, carry=c
        )
        mean = found.groupBy("query_key").agg(F.avg("carried").alias("_fill"))
        out = (
            out.join(mean, out[key] == mean["query_key"], "left")
            .withColumn(c, F.coalesce(number(c), F.col("_fill"), F.lit(means[c])))
            .drop("query_key", "_fill")
        )
    return out.select(*df.columns)


def _bayesian_ridge(gram: np.ndarray, moment: np.ndarray, yy: float, n: int) -> np.ndarray:
    """Ridge weights whose two precisions maximise the evidence (MacKay's updates), from moments."""
    tiny = 1e-6
    values, vectors = np.linalg.eigh(gram)
    values = np.clip(values, 0.0, None)
    rotated = vectors.T @ moment
    noise = n / max(yy, 1e-300)
    prior = 1.0
    old = None
    for _ in range(300):
        weights = vectors @ (rotated / (values + prior / noise))
        if old is not None and np.abs(weights - old).sum() < 1e-3:
            break
        old = weights
        error = max(yy - 2 * weights @ moment + weights @ gram @ weights, 0.0)
        used = np.sum(noise * values / (prior + noise * values))
        prior = (used + 2 * tiny) / (np.sum(weights**2) + 2 * tiny)
        noise = (n - used + 2 * tiny) / (error + 2 * tiny)
    return weights


def fill_iterative(df: DataFrame, cols: Sequence[str] | None = None, rounds: int = 10) -> DataFrame:
    """Chained imputation: every column with gaps is regressed on the others, round after round.

    Inside one pattern of missing columns a filled value is a linear form of the held columns, at
    every round. One pass therefore collects counts, sums and cross products per pattern; all
    rounds run on those small matrices, and the last linear forms fill the table in one projection.
    """
    cols = list(cols or numeric_columns(df))
    k = len(cols)
    bits = [F.when(missing(df, c), F.lit("1")).otherwise(F.lit("0")) for c in cols]
    values = [F.coalesce(number(c), F.lit(0.0)) for c in cols]
    means = collect_stats(df, {c: F.avg(number(c)) for c in cols})
    centre = np.array([means[c] or 0.0 for c in cols])
    shifted = [v - F.lit(float(m)) for v, m in zip(values, centre)]
    aggs = [F.count("*").alias("n")]
    aggs += [F.sum(shifted[i]).alias(f"s{i}") for i in range(k)]
    aggs += [F.sum(shifted[i] * shifted[j]).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    rows = df.groupBy(F.concat(*bits).alias("pattern")).agg(*aggs).collect()
    patterns = {}
    for row in rows:
        held = np.array([b == "0" for b in row["pattern"]])
        second = np.zeros((k + 1, k + 1))
        second[0, 0] = row["n"]
        for i in range(k):
            second[0, i + 1] = second[i + 1, 0] = row[f"s{i}"] if held[i] else 0.0
            for j in range(i, k):
                if held[i] and held[j]:
                    second[i + 1, j + 1] = second[j + 1, i + 1] = row[f"p{i}_{j}"]
        # Row c of the form gives the centred value of column c from (1, centred held columns).
        form = np.zeros((k, k + 1))
        for i in range(k):
            if held[i]:
                form[i, i + 1] = 1.0
        patterns[row["pattern"]] = (held, second, form)
    gaps = np.array([sum(s[0, 0] for h, s, _ in patterns.values() if not h[c]) for c in range(k)])
    order = [c for c in np.argsort(gaps, kind="stable") if gaps[c] > 0]
    for _ in range(rounds if k > 1 else 0):
        for c in order:
            others = [i for i in range(k) if i != c]
            total = np.zeros((k + 1, k + 1))
            for held, second, form in patterns.values():
                if held[c]:
                    lift = np.vstack([np.eye(1, k + 1), form])
                    total += lift @ second @ lift.T
            n = total[0, 0]
            if n == 0:
                continue
            mean = total[0, 1:] / n
            cov = total[1:, 1:] - n * np.outer(mean, mean)
            weights = _bayesian_ridge(cov[np.ix_(others, others)], cov[others, c], cov[c, c], int(n))
            base = mean[c] - weights @ mean[others]
            for held, _, form in patterns.values():
                if not held[c]:
                    form[c] = weights @ form[others]
                    form[c, 0] += base
    pattern = F.concat(*bits)
    exprs = {}
    for i in order:
        value = number(cols[i])
        for bits_, (held, _, form) in patterns.items():
            if not held[i]:
                filled = F.lit(float(form[i, 0] + centre[i]))
                for j in range(k):
                    if held[j] and form[i, j + 1]:
                        filled = filled + F.lit(float(form[i, j + 1])) * shifted[j]
                value = F.when(pattern == bits_, filled).otherwise(value)
        exprs[cols[i]] = value
    return df.withColumns(exprs) if exprs else df


def handle(df: DataFrame, method: str, cols: Sequence[str] | None = None, *, key: str | None = None) -> DataFrame:
    """Apply one method to the named columns, or to the table.

    Statistics of numbers are used for numeric columns only; every other column then takes its
    most frequent value, whichever method was chosen.
    """
    if method not in METHODS:
        raise ValueError(f"unknown null handler: {method}")
    cols = [c for c in (cols or df.columns) if c in df.columns and c != key]
    if method == DROP_ROWS:
        return drop_rows(df, cols)
    if method == DROP_COLUMNS:
        return drop_null_columns(df, cols)
    numeric = [c for c in cols if c in numeric_columns(df)]
    others = [c for c in cols if c not in numeric]
    if numeric:
        if method == MEAN:
            df = fill_mean(df, numeric)
        elif method == MEDIAN:
            df = fill_median(df, numeric)
        elif method == MOST_FREQUENT:
            df = fill_most_frequent(df, numeric)
        elif method == CONSTANT:
            df = fill_constant(df, numeric)
        elif method == KNN:
            if key is None:
                raise ValueError("KNN imputation needs a key column")
            df = fill_knn(df, key, numeric)
        else:
            df = fill_iterative(df, numeric)
    return fill_most_frequent(df, others) if others else df


def apply_rules(
    df: DataFrame, rules: Mapping[str, str] | Sequence[Mapping[str, str]], *, key: str | None = None
) -> DataFrame:
    """Ordered column rules; a column the table lacks is skipped, an unknown method is an error."""
    for rule in [rules] if isinstance(rules, Mapping) else rules:
        for col, method in rule.items():
            if method not in METHODS:
                if col in df.columns:
                    raise ValueError(f"unknown null handler: {method}")
                continue
            if col in df.columns:
                df = handle(df, method, [col], key=key)
    return df
