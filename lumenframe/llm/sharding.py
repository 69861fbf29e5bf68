"""Sharding by weighted rendezvous hashing of stable record keys.

Every shard draws a number from a digest of seed, key and its own place, and the record goes to the shard with the highest
``weight / -ln(draw)`` (Thaler and Ravishankar, 1998; weights as by Schindelhauer and Schomaker, 2005). Key and shards decide
alone: a shard that is added takes records only into itself, in proportion to its weight, and one that goes gives its own
away. Eight shards share one SHA-256 digest of a key, so forty cost five.

Places inside a shard are gapless and follow a digest of the row: equal rows are counted first, rows are dealt by the first digits
of the digest, the totals of those digits are added up, and the rows of one beginning are ordered. No task holds a whole shard.

Which rows of a group of equal texts share a shard is the key's decision; name a digest of the text as the key to keep them
together. Defined cases: null text has the size of an empty one and its checksum 0; a null key counts as the empty text, so all such
records share a shard; rows that share a key share a shard; equal rows take consecutive places; of equal draws the smaller shard
wins; an empty table gives an empty result; other columns are not read (``write`` keeps them).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS = 40
SEED = 13
#: What a record takes besides its text.
OVERHEAD = 16
#: Draws of 32 bits in one digest.
DRAWS = 8
#: Hexadecimal digits that deal the rows of a shard: 4,096 groups.
DIGITS = 3
#: Copies of a row that one row of the result's making stands for.
CHUNK = 4096


def _draws(key: Column, seed: int, n: int) -> Column:
    """One number above 0 and below 1 for each of ``n`` shards."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    blocks = F.sequence(F.lit(0), F.lit((n - 1) // DRAWS))
    digests = F.transform(blocks, lambda b: F.sha2(F.concat(F.lit(f"{seed}:"), text, F.lit(":"), b.cast("string")), 256))
    places = F.sequence(F.lit(0), F.lit(DRAWS - 1))
    numbers = F.transform(digests, lambda d: F.transform(places, lambda i: F.conv(F.substr(d, i * 8 + 1, F.lit(8)), 16, 10)))
    return F.transform(F.flatten(numbers), lambda h: (h.cast("double") + 0.5) / 4294967296.0)


def _highest(draws: Column, weights: Sequence[float]) -> Column:
    """The place of the highest weighted draw, the first of equal ones."""
    heavy = F.array(*[F.lit(float(w)) for w in weights])
    scores = F.zip_with(F.slice(draws, 1, len(weights)), heavy, lambda u, w: w / -F.log(u))
    return F.transform(F.array(scores), lambda s: F.array_position(s, F.array_max(s)) - 1)[0].cast("int")


def shard_of(key: Column, weights: Sequence[float], seed: int = SEED) -> Column:
    """The shard of a key among shards of these weights."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    return F.transform(F.array(_draws(key, seed, len(weights))), lambda d: _highest(d, weights))[0]


def _shards(key: Column, weights: Sequence[float], more: float, seed: int) -> Column:
    """``now, grown``: the shard, and the one with a shard of weight ``more`` added; one set of draws for both."""
    after = [*weights, more]
    draws = F.array(_draws(key, seed, len(after)))
    return F.transform(draws, lambda d: F.struct(_highest(d, weights).alias("now"), _highest(d, after).alias("grown")))[0]


def assign(docs: DataFrame, shards: int = SHARDS, weights: Sequence[float] | None = None, more: float = 1.0, key: str = "doc_id",
           seed: int = SEED) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs(doc_id, text)``.

    ``weights`` are the shares of the shards (equal if not given), ``more`` that of the shard by which they grow.
    """
    weights = list(weights or [1.0] * shards)
    if min(weights, default=0) <= 0 or more <= 0:
        raise ValueError("every shard needs a weight above 0")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.col(key).cast("string").alias("key"),
    )
    same = rows.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("copies"))
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32", "size")
    dealt = same.withColumn("to", _shards(F.col("key"), weights, more, seed)).withColumn("order", F.md5(named)).select(
        "doc_id", "size", "text_crc32", "copies", "order", F.col("to.now").alias("shard"), F.col("to.grown").alias("grown_shard"),
        F.substring("order", 1, DIGITS).alias("part"),
    )
    sums = dealt.groupBy("shard", "part").agg(F.sum("copies").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row for each shard and beginning of a digest, both of them parameters.
    skips = sums.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    within = Window.partitionBy("shard", "part").orderBy("order", "doc_id", "text_crc32", "size", "grown_shard")
    before = F.coalesce(F.sum("copies").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("before", before).join(skips, ["shard", "part"])
    placed = placed.withColumn("first", F.col("skip") + F.col("before"))
    zero, step = F.lit(0).cast("long"), F.lit(CHUNK).cast("long")
    chunks = placed.select("*", F.explode(F.sequence(zero, F.col("copies") - 1, step)).alias("chunk"))
    each = chunks.select("*", F.explode(F.sequence("chunk", F.least(F.col("chunk") + CHUNK - 1, F.col("copies") - 1))).alias("copy"))
    return each.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("copy")).cast("long").alias("slot"),
        "grown_shard",
    )


def write(docs: DataFrame, path: str, shards: int = SHARDS, weights: Sequence[float] | None = None, key: str = "doc_id",
          seed: int = SEED) -> None:
    """Write the rows of ``docs``, with all their columns, into one folder per shard; the rows of a shard come from many tasks."""
    weights = list(weights or [1.0] * shards)
    named = docs.withColumn("shard", shard_of(F.col(key), weights, seed))
    named.write.partitionBy("shard").parquet(path)


def oracle(shards: int = SHARDS, seed: int = SEED) -> str:
    """The query in SQL. CRC-32 of blocks of 128 bytes from the end; a block's state moves over the bytes behind it as its bits do."""
    step = "xor(t[(xor(c, x) & 255) + 1], c >> 8)"
    draws = f"list_transform(range({shards + 1}), lambda j: ('0x' || substr(sha256('{seed}:' || doc_id || ':' || (j // {DRAWS})), (j % {DRAWS}) * 8 + 1, 8))::BIGINT)"
    return f"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) x(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, j, (j + 1) * 256 >= length(h) AS leads, substr(h, greatest(length(h) - (j + 1) * 256, 0) + 1,
  least(256, length(h) - j * 256)) AS h FROM (SELECT *, unnest(range((length(h) + 255) // 256)) AS j FROM texts)),
states AS (SELECT doc_id, j, list_reduce(list_prepend(CASE WHEN leads THEN 4294967295 ELSE 0 END::BIGINT,
  list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)), lambda c, x: {step}) AS s FROM blocks, crc),
moved(j, bit, c) AS (SELECT 0::BIGINT, b, 1::BIGINT << b FROM range(32) x(b) UNION ALL
  SELECT j + 1, bit, list_reduce(list_prepend(moved.c, list_transform(range(128), lambda i: 0::BIGINT)), lambda c, x: {step}) FROM moved, crc
  WHERE j < (SELECT max(length(h)) FROM texts) // 256),
sums AS (SELECT doc_id, xor(bit_xor(coalesce(m.c, 0)), 4294967295) AS crc FROM states LEFT JOIN moved m ON m.j = states.j AND (s >> bit) & 1 = 1 GROUP BY doc_id),
rows_ AS (SELECT doc_id, (length(h) // 2 + {OVERHEAD})::BIGINT AS size, coalesce(crc, 0)::BIGINT AS text_crc32, {draws} AS d FROM texts LEFT JOIN sums USING (doc_id)),
dealt AS (SELECT *, (list_position(d[:{shards}], list_max(d[:{shards}])) - 1)::INTEGER AS shard, (list_position(d, list_max(d)) - 1)::INTEGER AS grown_shard FROM rows_)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id || ':' || text_crc32 || ':' || size), doc_id) - 1 AS slot, grown_shard FROM dealt"""
