"""Outlier rules: drop the rows, or blank the cells and keep the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.stats import collect_stats, exact_quantiles, number, numeric_columns, top_by
from lumenframe.operators.profile import iqr_fences
from lumenframe.session import cut_lineage

# Names of the outlier handlers.
Z_SCORE = "Z-Score Removal"
IQR = "IQR Removal"
FOREST = "Isolation Forest"
ELLIPSE = "Elliptic Envelope"
METHODS = (Z_SCORE, IQR, FOREST, ELLIPSE)


def zscore_tests(df: DataFrame, cols: Sequence[str], limit: float = 3.0) -> dict[str, Column]:
    """Per column: is the value within ``limit`` population deviations? Null and zero spread are not."""
    fit = collect_stats(
        df,
        {("m", c): F.avg(number(c)) for c in cols} | {("s", c): F.stddev_pop(number(c)) for c in cols},
    )
    tests = {}
    for c in cols:
        m, s = fit["m", c], fit["s", c]
        if not s:
            tests[c] = F.lit(False)
        else:
            tests[c] = F.coalesce(F.abs((number(c) - F.lit(m)) / F.lit(s)) < limit, F.lit(False))
    return tests


def iqr_tests(df: DataFrame, cols: Sequence[str], factor: float = 1.5) -> dict[str, Column]:
    """Per column: is the value inside the fence? A null compares false with both ends, so it is kept."""
    fences = iqr_fences(df, cols, factor)
    return {
        c: ~F.coalesce((number(c) < F.lit(fences[c][0])) | (number(c) > F.lit(fences[c][1])), F.lit(False))
        if c in fences
        else F.lit(True)
        for c in cols
    }


def _apply(df: DataFrame, tests: dict[str, Column], mode: str) -> DataFrame:
    if mode == "drop_rows":
        return df.where(reduce(Column.__and__, tests.values())) if tests else df
    if mode == "mask":
        return df.withColumns({c: F.when(t, F.col(c)) for c, t in tests.items()})
    raise ValueError(f"unknown mode: {mode}")


def zscore(df: DataFrame, cols: Sequence[str] | None = None, *, limit: float = 3.0, mode: str = "drop_rows") -> DataFrame:
    return _apply(df, zscore_tests(df, list(cols or numeric_columns(df)), limit), mode)


def iqr(df: DataFrame, cols: Sequence[str] | None = None, *, factor: float = 1.5, mode: str = "drop_rows") -> DataFrame:
    return _apply(df, iqr_tests(df, list(cols or numeric_columns(df)), factor), mode)


def isolation_scores(
    df: DataFrame, cols: Sequence[str], key: str, *, trees: int = 100, rows: int = 256, seed: int = 0
) -> DataFrame:
    """Add ``score``, the isolation score of Liu et al. (2008): near 1 is easy to isolate.

    Each tree sees ``rows`` rows (all, if there are fewer) drawn by a hash of its own, as the method
    prescribes, and is grown in its own task. The forest is a bounded table of split nodes, which every
    task uses to score all rows.
    """
    clean = [F.coalesce(number(c), F.lit(0.0)) for c in cols]
    slim = df.select(F.array(*clean).alias("x"), F.xxhash64(F.col(key), F.lit(seed)).alias("h"))
    # A tree's rows are those with its smallest hashes; a threshold keeps all but a few of the others away.
    many = max(1, slim.count())
    share = min(1.0, 2.0 * rows / many + 40.0 / many)
    mine = lambda t: F.pmod(F.xxhash64("h", t), F.lit(1 << 30))
    near = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: mine(t) < int(share * (1 << 30)))
    drawn = slim.withColumn("tree", F.explode(near)).withColumn("turn", mine(F.col("tree")))
    drawn = top_by(drawn, ["tree"], [F.col("turn"), F.col("h")], rows).select("x", "h", "tree")
    width = len(cols)

    def grow(key_: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("h")
        x = np.array(part["x"].tolist(), dtype=float).reshape(len(part), width)
        rng = np.random.default_rng((seed, int(key_[0])))
        depth = max(1, int(np.ceil(np.log2(max(len(x), 2)))))
        nodes = []
        stack = [(x, 0, -1, 0)]
        while stack:
            rows_, level, parent, side = stack.pop()
            me = len(nodes)
            spread = np.ptp(rows_, axis=0) if len(rows_) else np.zeros(width)
            open_ = np.flatnonzero(spread > 0)
            leaf = level >= depth or len(rows_) <= 1 or not len(open_)
            feature = -1 if leaf else int(rng.choice(open_))
            cut = 0.0 if leaf else float(rng.uniform(rows_[:, feature].min(), rows_[:, feature].max()))
            nodes.append([me, feature, cut, -1, -1, level + _path(len(rows_)) if leaf else 0.0])
            if parent >= 0:
                nodes[parent][3 + side] = me
            if not leaf:
                left = rows_[:, feature] < cut
                stack.append((rows_[left], level + 1, me, 0))
                stack.append((rows_[~left], level + 1, me, 1))
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "path"])
        return out.assign(tree=key_[0], size=len(x))

    schema = "node long, feature long, cut double, left long, right long, path double, tree long, size long"
    forest = drawn.groupBy("tree").applyInPandas(grow, schema).toPandas().sort_values(["tree", "node"])
    grown = [g.to_numpy(dtype=float) for _, g in forest.groupby("tree")]
    norm = _path(float(np.mean([g[0, 7] for g in grown]))) or 1.0
    tables = [(*(g[:, i].astype(np.int64) if i != 2 else g[:, i] for i in range(1, 5)), g[:, 5]) for g in grown]
    shipped = df.sparkSession.sparkContext.broadcast(tables)

    @F.pandas_udf("double")
    def score(col: pd.Series) -> pd.Series:
        x = np.array(col.tolist(), dtype=float).reshape(len(col), width)
        total = np.zeros(len(x))
        rows_ = np.arange(len(x))
        for t in shipped.value:
            at = np.zeros(len(x), dtype=int)
            feature, cut, left, right, path = t
            live = rows_ if feature[0] >= 0 else rows_[:0]
            while len(live):
                node = at[live]
                step = np.where(x[live, feature[node]] < cut[node], left[node], right[node])
                at[live] = step
                live = live[feature[step] >= 0]
            total += path[at]
        return pd.Series(2.0 ** (-total / len(shipped.value) / norm))

    return df.withColumn("score", score(F.array(*clean)))


def _path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def isolation_forest(
    df: DataFrame, key: str, cols: Sequence[str] | None = None, *, contamination: float = 0.05, seed: int = 0
) -> DataFrame:
    """Drop the ``contamination`` share of rows that is easiest to isolate."""
    cols = list(cols or numeric_columns(df, [key]))
    # Every pass of the quantile and the filter read the written scores.
    scored = cut_lineage(isolation_scores(df, cols, key, seed=seed))
    cut = exact_quantiles(scored, ["score"], (1.0 - contamination,))["score"][0]
    return scored.where(F.col("score") <= F.lit(cut)).drop("score")


def _moments(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray, int]:
    k = len(cols)
    aggs = {"n": F.count("*")} | {("m", c): F.avg(number(c)) for c in cols}
    aggs |= {
        ("v", i, j): F.covar_pop(number(cols[i]), number(cols[j])) for i in range(k) for j in range(i, k)
    }
    got = collect_stats(df, aggs)
    cov = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cov[i, j] = cov[j, i] = got["v", i, j] or 0.0
    return np.array([got["m", c] for c in cols], dtype=float), cov, got["n"]


def _mahalanobis(cols: Sequence[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Squared distance as a column expression."""
    inverse = np.linalg.pinv(cov)
    gaps = [number(c) - F.lit(float(m)) for c, m in zip(cols, mean)]
    terms = []
    for i in range(len(cols)):
        terms.append(gaps[i] * gaps[i] * F.lit(float(inverse[i, i])))
        for j in range(i + 1, len(cols)):
            terms.append(gaps[i] * gaps[j] * F.lit(float(2 * inverse[i, j])))
    return reduce(Column.__add__, terms)


def _chi2_quantile(p: float, k: int) -> float:
    """Wilson-Hilferty approximation of the chi-squared quantile."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * np.sqrt(2 / (9 * k))) ** 3


def elliptic_distances(df: DataFrame, cols: Sequence[str], *, steps: int | None = None) -> DataFrame:
    """Add ``distance``: squared Mahalanobis distance from a minimum-covariance-determinant fit.

    Concentration steps (Rousseeuw and Van Driessen, 1999) over the whole table: keep the half with
    the smallest distances, refit, repeat until the determinant stops falling (it cannot rise, so this
    ends) or after ``steps``; then reweight. A row with a missing value has a null distance.
    """
    present = df.where(reduce(Column.__and__, [number(c).isNotNull() for c in cols]))
    k = len(cols)
    mean, cov, n = _moments(present, cols)
    centre = exact_quantiles(present, cols, (0.5,))
    mean = np.array([centre[c][0] for c in cols])
    share = min(1.0, (n + k + 1) // 2 / max(n, 1))
    last = np.inf
    for _ in count() if steps is None else range(steps):
        measured = present.withColumn("distance", _mahalanobis(cols, mean, cov))
        cut = exact_quantiles(measured, ["distance"], (share,))["distance"][0]
        new_mean, new_cov, _ = _moments(measured.where(F.col("distance") <= F.lit(cut)), cols)
        det = np.linalg.det(new_cov)
        if not np.isfinite(det) or det <= 0:
            break
        mean, cov = new_mean, new_cov
        if last - det <= 1e-9 * abs(last):
            break
        last = det
    measured = present.withColumn("distance", _mahalanobis(cols, mean, cov))
    middle = exact_quantiles(measured, ["distance"], (0.5,))["distance"][0]
    cov = cov * middle / _chi2_quantile(0.5, k)
    measured = present.withColumn("distance", _mahalanobis(cols, mean, cov))
    mean, cov, _ = _moments(measured.where(F.col("distance") < _chi2_quantile(0.975, k)), cols)
    return df.withColumn("distance", _mahalanobis(cols, mean, cov))


def elliptic_envelope(df: DataFrame, cols: Sequence[str] | None = None, *, contamination: float = 0.05) -> DataFrame:
    """Drop the ``contamination`` share of rows farthest from the robust ellipse; rows with a missing value stay."""
    measured = elliptic_distances(df, list(cols or numeric_columns(df)))
    cut = exact_quantiles(measured, ["distance"], (1.0 - contamination,))["distance"][0]
    return measured.where(F.col("distance").isNull() | (F.col("distance") <= F.lit(cut))).drop("distance")


def handle(
    df: DataFrame, method: str, cols: Sequence[str] | None = None, *, mode: str = "drop_rows", key: str | None = None
) -> DataFrame:
    """Apply a rule by name. Only the per-column rules can blank single cells."""
    cols = list(cols or numeric_columns(df, [key] if key else []))
    if not cols:
        return df
    if method == Z_SCORE:
        return zscore(df, cols, mode=mode)
    if method == IQR:
        return iqr(df, cols, mode=mode)
    if method == FOREST:
        if key is None:
            raise ValueError("Isolation Forest needs a key column")
        return isolation_forest(df, key, cols)
    if method == ELLIPSE:
        return elliptic_envelope(df, cols)
    raise ValueError(f"unknown outlier method: {method}")
