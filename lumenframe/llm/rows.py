"""Row numbers, dealing to buckets and runs of sorted arrays, shared by the packed operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deal(ids, n: int):
    """A bucket for each id; the same arithmetic in numpy and in SQL (:func:`deal_column`)."""
    return ids % 2147483647 * 48271 % 2147483647 % n


def deal_column(ids: Column, n: int) -> Column:
    return F.pmod(F.pmod(F.pmod(ids, F.lit(2147483647)) * 48271, F.lit(2147483647)), F.lit(n)).cast("int")


def runs(values: np.ndarray):
    """``(value, from, to)`` of the runs of a sorted array."""
    if not len(values):
        return
    cut = np.flatnonzero(np.diff(values)) + 1
    for lo, hi in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]])):
        yield int(values[lo]), int(lo), int(hi)


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs(doc_id, text, ...)`` with a number ``uid`` per different row, and a shift: ``uid >> shift`` is the id.

    Where no id repeats, the number is the id itself.
    """
    most = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    if most == 1:
        return docs.withColumn("uid", F.col("doc_id")), 0
    hashed = docs.withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))
    versions = hashed.groupBy("doc_id").agg(F.array_sort(F.collect_set("version")).alias("versions"))
    shift = int(most).bit_length()
    numbers = hashed.join(versions, "doc_id").withColumn(
        "uid", F.col("doc_id") * F.lit(1 << shift) + F.array_position("versions", F.col("version")) - 1
    )
    return numbers.select(*docs.columns, "uid"), shift
