"""Orders over whole tables without a single-task sort.

A running total or a rank over all rows is split in two: rows are spread over value buckets, each
bucket is ordered on its own, and the totals of the earlier buckets are added. Only the table of
bucket totals is ordered in one place, and its size is bounded by the number of buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 1_000_000


def _number_buckets(df: DataFrame, col: str, buckets: int) -> DataFrame:
    """Add ``_bucket``: about equally many rows in each, in the order of ``col``."""
    grid = [i / buckets for i in range(1, buckets)]
    x = F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))
    cuts = df.agg(F.percentile_approx(x, F.array(*map(F.lit, grid)), max(10_000, 4 * buckets))).first()[0]
    splits = [float("-inf"), *sorted(set(cuts or [0.0])), float("inf")]
    typed = df.withColumn("_x", F.coalesce(x, F.lit(0.0)))
    return Bucketizer(splits=splits, inputCol="_x", outputCol="_bucket").transform(typed).drop("_x")


def running_totals(
    df: DataFrame,
    order: str,
    weights: Sequence[str],
    keys: Sequence[str] = (),
    *,
    descending: bool = False,
    bucket_rows: int | None = None,
) -> DataFrame:
    """Add ``cum_<w>`` for each weight: its total over rows up to and including this one.

    ``order`` is a number that is unique within ``keys``. Null and NaN come after every number, in
    either direction and at every size.
    """
    turn = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    open_ = F.col(order).isNull() | F.isnan(F.col(order).cast("double"))
    limit = bucket_rows or BUCKET_ROWS
    rows = df.count()
    if rows <= limit:
        run = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
        run = run.orderBy(open_, turn(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(w).over(run).alias(f"cum_{w}") for w in weights])
    spread = _number_buckets(df, order, -(-rows // limit))
    last = F.lit(-1.0 if descending else float("inf"))
    spread = spread.withColumn("_bucket", F.when(open_, last).otherwise(F.col("_bucket")))
    totals = spread.groupBy(*keys, "_bucket").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    earlier = (
        Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ).orderBy(turn("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.col("_bucket").alias("_o_bucket"),
        *[F.coalesce(F.sum(f"_t_{w}").over(earlier), F.lit(0)).alias(f"_o_{w}") for w in weights],
    )
    within = Window.partitionBy(*keys, "_bucket").orderBy(open_, turn(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = spread.select("*", *[F.sum(w).over(within).alias(f"_l_{w}") for w in weights])
    same = F.col("_bucket") == F.col("_o_bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    joined = local.join(offsets, same)
    return joined.select(*df.columns, *[(F.col(f"_l_{w}") + F.col(f"_o_{w}")).alias(f"cum_{w}") for w in weights])


def dense_codes(df: DataFrame, col: str, *, bucket_rows: int | None = None) -> tuple[DataFrame, int, int]:
    """``(value, code)``, the 0-based rank of every distinct text value in binary order; how many; their letters.

    Past ``bucket_rows`` distinct values, boundary values are drawn from them (as a range
    partitioner does) and ranks are counted bucket by bucket.
    """
    rows = bucket_rows or BUCKET_ROWS
    values = df.select(F.col(col).cast("string").alias("value")).where("value is not null").distinct()
    distinct, letters = values.agg(F.count("*"), F.coalesce(F.sum(F.length("value")), F.lit(0))).first()
    if distinct <= rows:
        order = Window.partitionBy(F.lit(0)).orderBy("value")
        return values.select("value", (F.row_number().over(order) - 1).cast("long").alias("code")), distinct, letters
    buckets = -(-distinct // rows)
    # A boundary may be any text: the beginnings of drawn values do, and stay short.
    drawn = values.orderBy(F.md5("value")).limit(20 * buckets).select(F.substring("value", 1, 64)).collect()
    drawn = sorted(r[0] for r in drawn)
    cuts = [drawn[len(drawn) * i // buckets] for i in range(1, buckets)]

    @F.pandas_udf("long")
    def bucket_of(s: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, dtype=object), s.to_numpy(dtype=object), side="right"))

    spread = values.withColumn("_bucket", bucket_of("value"))
    totals = spread.groupBy("_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    within = Window.partitionBy("_bucket").orderBy("value")
    ranked = spread.withColumn("_rn", F.row_number().over(within))
    codes = ranked.join(offsets, "_bucket").select("value", (F.col("_rn") - 1 + F.col("_off")).alias("code"))
    return codes, distinct, letters


def seeded_hash(key: str | Column, seed: int) -> Column:
    """Reproducible pseudo-random order of rows: equal on every engine that has MD5."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}")))


def assign_chunks(df: DataFrame, key: str, seed: int, plan, by: str | None = None, out: str = "chunk") -> DataFrame:
    """Cut the seeded order of rows (per class of ``by``) into chunks of exact sizes.

    ``plan`` maps ``{class: rows}`` to ``{class: [chunk sizes]}``. Only the boundary hashes are
    searched for: hash prefixes are counted, the prefixes that hold a boundary are ranked, and the
    rows themselves are labelled by comparing hashes, with no shuffle of the table.
    """
    spark = df.sparkSession
    cls = F.coalesce(F.col(by).cast("string"), F.lit("\0")) if by else F.lit("")
    hashed = df.select(cls.alias("_c"), seeded_hash(key, seed).alias("_h"))
    prefixes = hashed.groupBy("_c", F.substring("_h", 1, 4).alias("_p")).agg(F.count("*").alias("_n"))
    counts = {r["_c"]: r["n"] for r in prefixes.groupBy("_c").agg(F.sum("_n").alias("n")).collect()}
    cuts = []
    for c, sizes in plan(counts).items():
        place = 0
        for i, size in enumerate(sizes[:-1]):
            place += size
            cuts.append((c, i, place))
    # Spark does not know that tables made here are small: without the hint, a join deals the rows by class, each class to one task.
    cut_table = F.broadcast(spark.createDataFrame(cuts or [("", -1, -1)], "_c string, cut int, place long"))
    run = Window.partitionBy("_c").orderBy("_p")
    spans = prefixes.withColumn("_end", F.sum("_n").over(run)).withColumn("_start", F.col("_end") - F.col("_n"))
    # The prefix that holds each boundary: at most one row per class and boundary.
    held = spans.join(cut_table, "_c").where("place > _start and place <= _end")
    held = held.select("_c", "_p", "cut", (F.col("place") - F.col("_start")).alias("_want"))
    held = F.broadcast(spark.createDataFrame(held.collect(), held.schema))
    inside = hashed.join(F.broadcast(held.select("_c", "_p").distinct()), [
        hashed["_c"] == held["_c"], F.substring(hashed["_h"], 1, 4) == held["_p"]
    ], "left_semi")
    order = Window.partitionBy("_c", "_p").orderBy("_h")
    ranked = inside.withColumn("_p", F.substring("_h", 1, 4)).withColumn("_rn", F.row_number().over(order))
    edges = ranked.join(held, ["_c", "_p"]).where("_rn = _want").select("_c", "cut", "_h").collect()
    bounds = {c: {i: "" for i in range(len(sizes) - 1)} for c, sizes in plan(counts).items()}
    for r in edges:
        bounds[r["_c"]][r["cut"]] = r["_h"]
    rows = []
    for c, found in bounds.items():
        filled = [found[i] for i in sorted(found)]
        # An empty chunk ends where the chunk before it ends.
        for i in range(1, len(filled)):
            filled[i] = max(filled[i], filled[i - 1])
        rows.append((c, filled))
    mine = seeded_hash(key, seed)
    if not by:
        label = F.lit(0)
        for h in rows[0][1] if rows else []:
            label = label + (mine > F.lit(h)).cast("int")
        return df.withColumn(out, label)
    table = F.broadcast(spark.createDataFrame(rows, "_cls string, _edges array<string>"))
    joined = df.join(table, cls == F.col("_cls"), "left")
    return joined.withColumn(out, F.size(F.filter("_edges", lambda e: mine > e))).drop("_cls", "_edges")


def seeded_rank(df: DataFrame, key: str, seed: int, by: str | None = None, out: str = "rank") -> DataFrame:
    """1-based place of every row in the seeded order, per class of ``by`` when given.

    Hash prefixes spread the rows of one class over many tasks; prefix totals give the offsets.
    """
    cls = F.coalesce(F.col(by).cast("string"), F.lit("\0")) if by else F.lit("")
    named = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_c", cls).withColumn("_p", F.substring("_h", 1, 4))
    totals = named.groupBy("_c", "_p").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_c").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_c", "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    local = named.withColumn("_rn", F.row_number().over(Window.partitionBy("_c", "_p").orderBy("_h")))
    return local.join(offsets, ["_c", "_p"]).select(*df.columns, (F.col("_rn") + F.col("_off")).alias(out))
