"""Joins between a table and its parents, children and filtered copies; keyed merges; set operations.

Children are reduced to one row per key before they meet their parent, so no join fans out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.stats import number
from lumenframe.operators.boxes import places, range_pairs, repeated


def align(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Put two column sets of the same rows together again."""
    return left.join(right, key)


def align_left(df: DataFrame, part: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Assign columns of a filtered copy back: rows it lacks become null."""
    fresh = part.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in cols])
    joined = df.join(fresh, F.col(key) == F.col("_key"), "left")
    return joined.withColumns({c: F.col(f"_{c}") for c in cols}).select(*df.columns)


def in_keys(df: DataFrame, key: str, keys: DataFrame, other: str) -> DataFrame:
    return df.join(keys.select(F.col(other).alias(key)), key, "left_semi")


def having_any(parents: DataFrame, key: str, children: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Parents with a row in at least one child table."""
    keys = reduce(DataFrame.union, [c.select(F.col(k).alias(key)) for c, k in children]).distinct()
    return parents.join(keys, key, "left_semi")


def count_children(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Children per parent and relation; parents with none at all are left out."""
    out = parents.select(key)
    for name, (child, k) in children.items():
        out = out.join(child.groupBy(F.col(k).alias(key)).agg(F.count("*").alias(name)), key, "left")
    out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in children})
    return out.where(reduce(Column.__or__, [F.col(n) > 0 for n in children]))


def child_flags(parents: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Does each parent have a row in each child table?"""
    out = parents.select(key)
    for name, (child, k) in children.items():
        held = child.select(F.col(k).alias(key)).distinct().withColumn(name, F.lit(True))
        out = out.join(held, key, "left")
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in children})


def follow(df: DataFrame, steps: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Follow foreign keys: each step joins ``(table, key here, key there)``."""
    for table, here, there in steps:
        df = df.join(table, F.col(here) == F.col(there)).drop(there)
    return df


def pairs_within(df: DataFrame, key: str, cols: Sequence[str], radius: float, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pairs of rows (smaller key first) no farther apart than ``radius``; ``shown`` shapes a distance.

    Rows meet only where the boxes of their units come that near; a crowded unit is cut into blocks on both sides. Where many rows
    share a place, places meet, and a distance is computed once for all rows of two places. A row with a
    missing value, or without a key, is in no pair.
    """
    cells = [number(c) for c in cols]
    known = reduce(Column.__and__, [c.isNotNull() for c in cells], F.col(key).isNotNull())
    points = df.where(known).select(F.col(key).alias("key"), F.array(*cells).alias("x"))
    distance = (shown or (lambda c: c))(F.sqrt("square")).alias("distance")
    if not repeated(points):
        found = range_pairs(points, len(cols), radius, radius * radius)
        return found.select(F.col("left").alias("left_key"), F.col("right").alias("right_key"), distance)
    held = places(points)
    # A place meets itself, too: its rows lie together.
    alone = held.select(F.col("key").alias("left"), F.col("key").alias("right"), F.lit(0.0).alias("square"))
    met = range_pairs(held, len(cols), radius, radius * radius).unionByName(alone)
    keys = held.select("key", "keys")
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few short rows become many pairs
    near = met.repartition(spread, "left", "right").join(keys.select(F.col("key").alias("left"), F.col("keys").alias("a")), "left")
    near = near.join(keys.select(F.col("key").alias("right"), F.col("keys").alias("b")), "right")
    near = near.select((F.col("left") == F.col("right")).alias("same"), distance, "a", "b")
    rows = near.select("same", "distance", F.explode("a").alias("a"), "b").select("same", "distance", "a", F.explode("b").alias("b"))
    # Of one place every two rows come in both orders, of two places in one.
    rows = rows.where(F.when(F.col("same"), F.col("a") < F.col("b")).otherwise(F.col("a") != F.col("b")))
    return rows.select(F.least("a", "b").alias("left_key"), F.greatest("a", "b").alias("right_key"), "distance")


def delete_children(children: DataFrame, key: str, deleted: DataFrame, other: str) -> DataFrame:
    """Cascade: children of deleted parents go too."""
    return children.join(deleted.select(F.col(other).alias(key)), key, "left_anti")


def detach_children(children: DataFrame, key: str, deleted: DataFrame, other: str) -> DataFrame:
    """Set null: children of deleted parents stay without a parent."""
    gone = deleted.select(F.col(other).alias("_gone")).distinct()
    joined = children.join(gone, F.col(key) == F.col("_gone"), "left")
    return joined.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone")


def pair_predictions(truth: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    return truth.join(predicted, key)


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Insert or replace: the row with the latest version per key; versions of a busy key combine before the shuffle."""
    both = old.unionByName(new)
    last = F.max_by(F.struct(*[F.col(c) for c in both.columns]), F.struct(version))
    return both.groupBy(key).agg(last.alias("_row")).select(*[F.col("_row")[c].alias(c) for c in both.columns])


def upsert_partial(old: DataFrame, new: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Update only the fields that are present; new keys take defaults for the others."""
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    exprs = [F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key)]
    for c in old.columns:
        if c != key:
            given = [F.col(f"b.{c}")] if c in new.columns else []
            fallback = F.lit(defaults[c]).cast(old.schema[c].dataType) if c in defaults else F.lit(None)
            created = F.when(F.col(f"a.{key}").isNull(), fallback)
            exprs.append(F.coalesce(*given, F.col(f"a.{c}"), created).alias(c))
    return joined.select(*exprs)


def stack_results(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of result tables with different metrics; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def shared_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names found in both lists."""
    return a.intersect(b)


def all_but(df: DataFrame, part: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``part``."""
    return df.join(part.select(key), key, "left_anti")


def latest_events(df: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Apply events in order: per key the last given value of each field.

    An aggregation keeps only one candidate per key and field, so a busy key is combined before the
    shuffle and never gathered.
    """
    place = F.struct(*order)
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in fields]
    return df.groupBy(key).agg(*last, F.count("*").alias("n_events"))
