"""Reproducible splits and folds of exact size, by seeded hash order."""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.ordering import assign_chunks, seeded_rank


def _share(fraction: float, rows: int) -> int:
    """Rows of the share, rounded up; the fraction is read as its decimal text."""
    return ceil(Fraction(str(fraction)) * rows)


def apportion(counts: dict[str, int], total: int) -> dict[str, int]:
    """Split ``total`` over classes in proportion; what is left goes to the largest remainders."""
    rows = sum(counts.values())
    out = {c: n * total // rows for c, n in counts.items()}
    spare = total - sum(out.values())
    for c in sorted(counts, key=lambda c: (-(counts[c] * total % rows), c))[:spare]:
        out[c] += 1
    return out


def holdout(df: DataFrame, key: str, fraction: float = 0.2, seed: int = 42, *, by: str | None = None) -> DataFrame:
    """Add ``is_test``: exactly the asked share of rows, in proportion per class of ``by`` when given."""

    def plan(counts):
        rows = sum(counts.values())
        test = apportion(counts, _share(fraction, rows)) if rows else {}
        return {c: [test[c], n - test[c]] for c, n in counts.items()}

    return assign_chunks(df, key, seed, plan, by).withColumn("is_test", F.col("chunk") == 0).drop("chunk")


def sample_when_large(
    df: DataFrame, key: str, by: str, *, limit: int = 1000, fraction: float = 0.25, seed: int = 42
) -> DataFrame:
    """A stratified share of a table with more than ``limit`` rows, else the table."""
    if df.limit(limit + 1).count() <= limit:
        return df
    return holdout(df, key, fraction, seed, by=by).where("is_test").drop("is_test")


def k_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``: k runs of the seeded order, the first ones a row longer when sizes cannot be equal."""

    def plan(counts):
        return {c: [n // k + (i < n % k) for i in range(k)] for c, n in counts.items()}

    return assign_chunks(df, key, seed, plan, out="fold").withColumn("fold", F.col("fold").cast("long"))


def stratified_folds(df: DataFrame, key: str, by: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add ``fold``: rows of each class are dealt out in turn, each class going on where the last one stopped."""
    counts = df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("\0")).alias("c")).count().collect()
    start, offsets = 0, []
    for row in sorted(counts, key=lambda x: x["c"]):
        offsets.append((row["c"], start % k))
        start += row["count"]
    table = df.sparkSession.createDataFrame(offsets, "_c string, _start long")
    ranked = seeded_rank(df, key, seed, by, out="_rank")
    joined = ranked.join(table, F.coalesce(F.col(by).cast("string"), F.lit("\0")) == F.col("_c"))
    return joined.withColumn("fold", (F.col("_start") + F.col("_rank") - 1) % k).drop("_c", "_start", "_rank")
