"""Exact top-k inner products by descending norm, with rotated partial sums and Cauchy-Schwarz bounds.

Components become integers, ``floor(scale * x)``, so that scores are exact.

1. The covariance of all vectors (summed per batch) gives a rotation whose first axes hold most of the length.
2. Vectors are dealt into blocks of falling norm. The block of longest vectors gives every query a first k-th score.
3. A query visits a block only while the product of its norm and the block's greatest norm can reach that score.
   Inside a block it takes the rotated partial sum over the first axes and adds the product of the lengths that remain
   (Cauchy-Schwarz); only vectors whose bound reaches the k-th score so far get their exact integer product.

Rotation works in floating point; bounds are widened by more than its error, and scores never depend on it.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of different lengths
are padded with zeros; a query never meets rows with its own id; repeated queries count once, repeated candidates each;
ties go to the smaller id; a null id takes no part. Components must stay under 2**31 after scaling.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm import arrays as A
from lumenframe.session import cut_lineage

SCALE = 1024
#: Axes of the rotated vectors in the first partial sum.
HEAD = 16
#: Vectors of one block, and queries that visit it in one task.
BLOCK = 4096
QUERIES = 512


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as a matrix of int64, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), A.ranges_of(sizes)] = flat
    return out


def _moments(width: int):
    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0), width).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    return run


def _sum(table: pa.Table) -> pa.Table:
    return pa.table({"part": pa.array([sum(np.frombuffer(x) for x in table.column("part").to_pylist()).tobytes()], pa.binary())})


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Axes of falling variance (columns), from a width x width sum that tasks add up first."""
    parts = vectors.select("v").mapInArrow(_moments(width), "part binary")
    parts = parts.withColumn("slot", F.spark_partition_id() % 16).groupBy("slot").applyInArrow(_sum, "part binary")
    total = sum((np.frombuffer(r[0]).reshape(width, width) for r in parts.collect()), np.zeros((width, width)))
    return np.linalg.eigh(total)[1][:, ::-1]


def _search(k: int, width: int, axes: np.ndarray, head: int):
    """Best k of one block for each query that visits it."""

    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if queries.num_rows and block.num_rows:
            ids, exact = block.column("id").to_numpy(), _matrix(block.column("v"), width)
            norm = np.sqrt((exact.astype(float) ** 2).sum(axis=1))
            order = np.lexsort((ids, -norm))
            ids, exact, norm = ids[order], exact[order], norm[order]
            turned = exact @ axes
            front = np.ascontiguousarray(turned[:, :head])
            rest = np.sqrt((turned[:, head:] ** 2).sum(axis=1))
            for q, v, known in zip(queries.column("query").to_pylist(), _matrix(queries.column("qv"), width), queries.column("floor").to_pylist()):
                mine = v @ axes
                length, tail = math.sqrt(float((v.astype(float) ** 2).sum())), math.sqrt(float((mine[head:] ** 2).sum()))
                floor = -math.inf if known is None else known
                best_s, best_v = np.zeros(0, np.int64), np.zeros(0, np.int64)
                at, step = 0, 4 * k
                while at < len(ids):
                    slack = 1 + 1e-9 * length * norm[at]
                    if length * norm[at] + slack < floor:
                        break  # shorter vectors cannot reach the k-th score
                    to = min(len(ids), at + step)
                    bound = front[at:to] @ mine[:head] + rest[at:to] * tail + slack
                    pick = at + np.flatnonzero((bound >= floor) & (ids[at:to] != q))
                    if len(pick):
                        best_s, best_v = np.concatenate([best_s, exact[pick] @ v]), np.concatenate([best_v, ids[pick]])
                        top = np.lexsort((best_v, -best_s))[:k]
                        best_s, best_v = best_s[top], best_v[top]
                        if len(best_s) == k:
                            floor = max(floor, float(best_s[-1]))
                    at, step = to, step * 2
                out_q.append(np.full(len(best_s), q))
                out_v.append(best_v)
                out_s.append(best_s)
        join = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        return pa.table({"query": join(out_q), "id": join(out_v), "score": join(out_s)})

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(df: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
          head: int = HEAD, block: int = BLOCK, per_task: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest inner products of each query row with all other rows."""
    spark = df.sparkSession
    A.small_batches(spark)
    spread = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    fine = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(
        F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    vectors = df.where(fine).select(F.col(key).alias("id"), spread.alias("v"))
    vectors = vectors.withColumn("norm2", F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x))
    facts = vectors.agg(F.max(F.size("v")), F.count("*")).first()
    width, many = max(1, facts[0] or 0), facts[1]
    axes, head = rotation(vectors, width), min(head, width)
    # Blocks of falling norm; ties may split anywhere, a block knows its own greatest norm.
    blocks = max(1, -(-many // block))
    ranked = vectors.repartitionByRange(blocks, F.desc("norm2"), "id").withColumn("block", F.spark_partition_id())
    ranked = cut_lineage(ranked)
    queries = ranked.where(is_query(F.col("id"))).select(F.col("id").alias("query"), F.col("v").alias("qv"), F.col("norm2").alias("q2")).distinct()
    reach = ranked.groupBy("block").agg(F.max("norm2").alias("longest"), F.count("*").alias("held"))
    search = _search(k, width, axes, head)
    schema = "query long, id long, score long"
    deal = F.pmod(F.xxhash64("query"), F.ceil(F.col("asked") / per_task).cast("long"))

    def visit(asked: DataFrame) -> DataFrame:
        """``asked(query, qv, floor, to)``: search block ``to``, at most about ``per_task`` queries in a task."""
        sizes = asked.groupBy("to").agg(F.count("*").alias("asked"))
        left = asked.join(sizes, "to").withColumn("part", deal)
        parts = left.select("to", "part").distinct()
        right = parts.join(ranked.withColumnRenamed("block", "to"), "to").select(F.col("to").alias("b"), F.col("part").alias("p"), "id", "v")
        return left.groupBy("to", "part").cogroup(right.groupBy("b", "p")).applyInArrow(search, schema)

    first = reach.orderBy(F.desc("longest"), "block").limit(1).select(F.col("block").alias("to"))
    none = F.lit(None).cast("double").alias("floor")
    one = cut_lineage(_best(visit(queries.join(F.broadcast(first), F.lit(True)).select("query", "qv", none, "to")), k).drop("rank"))
    floors = one.groupBy("query").agg(F.min("score").cast("double").alias("least"), F.count("*").alias("n"))
    floors = floors.select("query", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    # Block statistics are one row per few thousand vectors; each query keeps the blocks it can still gain from.
    others = reach.join(F.broadcast(first.withColumnRenamed("to", "block")), "block", "left_anti")
    bound = F.sqrt(F.col("q2").cast("double")) * F.sqrt(F.col("longest").cast("double"))
    can = F.col("floor").isNull() | (bound * (1 + 1e-9) + 1 >= F.col("floor"))
    asked = queries.join(floors, "query", "left").join(others, can).select("query", "qv", "floor", F.col("block").alias("to"))
    out = _best(one.union(visit(asked)), k)
    return out.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def oracle(every: int = 100, k: int = 10, scale: int = SCALE) -> str:
    """The same rows in SQL."""
    return f"""
WITH v AS (SELECT vec_id, [floor({scale} * x::double) FOR x IN embedding] AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::bigint AS score
 FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % {every} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
