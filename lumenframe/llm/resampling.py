"""Importance resampling towards a target text, on hashed word runs (Xie et al., "Data selection for language models via
importance resampling", 2023).

1. Texts are read once. The distinct features (runs of 1 to ``most`` words, joined by one space) of a window of about
   ``WINDOW`` bytes are grouped by their length in bytes into matrices of bytes; a group advances the CRC-32 of all its
   rows column by column, and the buckets are scattered back to every occurrence. Each document is written as its bucket
   numbers, two bytes a feature, to the shared folder.
2. Tasks add up bucket counts of documents and of target texts; a bucket's gain is a whole number made of the four counts.
   The driver sees one number per bucket.
3. A document's weight is the sum of its gains. Its score adds Gumbel noise that hangs on its id alone, so the highest
   scores are a draw without replacement in proportion to the exponentials of the weights.
4. Drawn documents are ranked in ranges of the score with exact counts before them: no task orders all of them.

Equal rows are counted before they are ranked and repeated afterwards, so an id that fills a third of the table is one row
there. Defined cases: null and empty texts have no features and weight 0; a null id draws the noise of the empty key and comes
after all others of its score; equal rows take consecutive ranks; a table without documents of enough features draws none;
an empty target counts as 0 features; a word of any length is one feature; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm import arrays as A
from lumenframe.llm.rows import runs
from lumenframe.session import cut_lineage

BUCKETS = 10_000
SEED = 2024
PERCENT, LEAST = 10, 20
#: Bytes of text whose features are grouped together.
WINDOW = 1 << 20
#: Features of more bytes are rare and of many lengths: each goes through zlib's CRC-32 on its own, with the same result.
LONG = 64
#: Rows of one matrix; bounds its index.
ROWS = 1 << 16

#: Bytes that stand in no word, after A-Z became a-z: all below 0x80 but 0-9 and a-z.
GAP = np.zeros(256, bool)
GAP[:0x80] = True
GAP[0x30:0x3A] = False
GAP[0x61:0x7B] = False


def _crc_table() -> np.ndarray:
    """The table of the reflected polynomial 0xEDB88320, one entry per byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CRC = _crc_table()


def column_crc(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a matrix of bytes, all rows a column at a time."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = CRC[(crc ^ column) & 255] ^ (crc >> 8)
    return ~crc


def distinct_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(first, inverse)`` of the distinct rows of a matrix of bytes; hashes group them, bytes are compared."""
    n, length = matrix.shape
    wide = np.zeros((n, -(-length // 8) * 8), np.uint8)
    wide[:, :length] = matrix
    parts = wide.view(np.uint64)
    key = parts[:, 0]
    for k in range(1, parts.shape[1]):
        key = A.mix(key * np.uint64(A.BASE_A) + parts[:, k])
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    if parts.shape[1] > 1 and not (parts == parts[first][inverse]).all():
        _, first, inverse = np.unique(parts, axis=0, return_index=True, return_inverse=True)
    return first, inverse.reshape(-1)


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of every slice ``data[start:end]``."""
    out = np.zeros(len(start), np.uint32)
    length = end - start
    order = np.argsort(length, kind="stable")
    for size, lo, hi in runs(length[order]):
        if size > LONG:
            for i in order[lo:]:
                out[i] = zlib.crc32(data[start[i] : end[i]])
            break
        for at in range(lo, hi, ROWS):
            mine = order[at : min(at + ROWS, hi)]
            matrix = data[start[mine][:, None] + np.arange(size)]
            first, inverse = distinct_rows(matrix)
            out[mine] = column_crc(matrix[first])[inverse]
    return out


def _windows(low: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of bytes of about ``WINDOW`` that cut no word."""
    a = 0
    while a < len(low):
        b = min(a + WINDOW, len(low))
        if b < len(low):
            row_end = int(offsets[np.searchsorted(offsets, b)])
            at = b
            while at < row_end:  # a piece at a time: the next gap is near
                gap = np.flatnonzero(GAP[low[at : min(at + 4096, row_end)]])
                if len(gap):
                    at += int(gap[0])
                    break
                at = min(at + 4096, row_end)
            b = at
        yield a, b
        a = b


def _joined(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one space apart: ``(bytes, start, end)``."""
    length = end - start
    to = np.cumsum(length + 1) - length - 1
    out = np.full(int((length + 1).sum()), 0x20, np.uint8)
    place = A.ranges_of(length)
    out[np.repeat(to, length) + place] = low[np.repeat(start, length) + place]
    return out, to, to + length


def buckets_of(data: np.ndarray, offsets: np.ndarray, most: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, bucket)`` of every feature, in the order of rows."""
    low = A.LOWER[data]
    rows, codes, before = [], [], np.zeros(0, np.int64)
    for a, b in _windows(low, offsets):
        # With longer runs, the last words of the window before are read again; a run counts where it ends.
        base = int(before[0]) if len(before) else a
        cut = np.unique(np.clip(offsets, base, b)) - base
        start, end, _ = A.words(low[base:b], np.concatenate([[0], cut[(cut > 0) & (cut < b - base)], [b - base]]), GAP)
        start, end = start + base, end + base
        row = np.searchsorted(offsets, start, side="right") - 1
        text, begin, stop = (low, start, end) if most == 1 else _joined(low, start, end)
        for k in range(min(most, len(start))):
            last = np.arange(k, len(start))
            last = last[(row[last - k] == row[last]) & (start[last] >= a)]
            rows.append(row[last].astype(np.int32))
            codes.append((crcs(text, begin[last - k], stop[last]) % np.uint32(buckets)).astype(np.uint16))
        before = start[len(start) - most + 1 :] if most > 1 else before
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.uint16)
    row, code = np.concatenate(rows), np.concatenate(codes)
    order = np.argsort(row, kind="stable")
    return row[order], code[order]


def _hasher(most: int, buckets: int):
    def run(batches):
        for batch in batches:
            data, offsets = A.utf8(batch.column(1))
            row, code = buckets_of(data, offsets, most, buckets)
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            blobs = pa.array([code[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(cut)), blobs], names=["doc_id", "n_features", "buckets"])
            A.release()

    return run


def hashed(docs: DataFrame, most: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_features, buckets`` (unsigned 16-bit numbers) of ``docs(doc_id, text)``."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError(f"{buckets} buckets: a bucket number takes 16 bits")
    A.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_hasher(most, buckets), "doc_id long, n_features long, buckets binary")


def totals(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket: every task sends one row per bucket that it met, the driver gets one per bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(blob, np.uint16), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    found = features.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of target to source, per bucket, rounded down."""
    size = len(source)
    ratio = ((target + 1.0) * (source.sum() + size)) / ((source + 1.0) * (target.sum() + size))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weigher(gain: np.ndarray):
    def run(batches):
        for batch in batches:
            weight = [int(gain[np.frombuffer(blob, np.uint16)].sum()) for blob in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weight, pa.int64())], names=["doc_id", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise, rounded down, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(u))).cast("long")


def ranked(scored: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """``scored(doc_id, n_features, weight, score)`` with the ``rank`` of drawn rows; the others keep null.

    Of the rows with at least ``least`` features, ``percent`` in a hundred are drawn, rounded down.
    """
    spark = scored.sparkSession
    parts = 4 * A.buckets(spark)
    fit = F.coalesce(F.col("n_features") >= least, F.lit(False))
    eligible = scored.where(fit)
    # Bounds of the ranges are approximate, at most one per range; what follows counts exactly.
    cuts = sorted(set(eligible.approxQuantile("score", [k / parts for k in range(1, parts)], 0.25 / parts)), reverse=True)
    part = F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c > F.col("score")))
    counts = dict(eligible.groupBy(part.alias("part")).count().collect())  # at most ``parts`` rows
    drawn = sum(counts.values()) * percent // 100
    starts, seen = {}, 0
    for p in sorted(counts):
        if seen < drawn:
            starts[p] = seen
        seen += counts[p]
    empty = scored.withColumn("rank", F.lit(None).cast("long"))
    if not starts:
        return empty
    last = max(starts)
    # Equal rows are one row with a count until they are ranked.
    once = eligible.where(part <= last).groupBy(*scored.columns).agg(F.count("*").alias("copies")).withColumn("part", part)
    order = Window.partitionBy("part").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight")
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])
    placed = once.withColumn("first", F.element_at(start, F.col("part")) + before)
    chunks = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(4096).cast("long"))).alias("chunk"))
    each = chunks.select("*", F.explode(F.sequence("chunk", F.least(F.col("chunk") + 4095, F.col("copies") - 1))).alias("copy"))
    rank = (F.col("first") + F.col("copy") + 1).cast("long")
    top = each.select(*scored.columns, F.when(rank <= drawn, rank).alias("rank"))
    return top.unionByName(empty.where(~fit | (part > last)))


def resample(docs: DataFrame, target: DataFrame, most: int = 1, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST,
             percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for each row of ``docs(doc_id, text)``; ``target(text)`` is the distribution sought."""
    features = cut_lineage(hashed(docs, most, buckets))
    wanted = hashed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), most, buckets)
    gain = gains(totals(features, buckets), totals(wanted, buckets))
    weighed = features.mapInArrow(_weigher(gain), "doc_id long, n_features long, weight long")
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(cut_lineage(scored), least, percent)


def oracle() -> str:
    """The draw with the defaults in SQL; the table of CRC-32 is made from its polynomial."""
    return r"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) x(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (SELECT true AS sought, item_id AS id, text FROM benchmark UNION ALL SELECT false, doc_id, text FROM documents),
words AS (SELECT sought, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
spelled AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
placed AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
  lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS b FROM spelled, crc),
found AS (SELECT sought, id, b FROM words JOIN placed USING (w)),
counts AS (SELECT b, count(*) FILTER (NOT sought) AS s, count(*) FILTER (sought) AS t FROM found GROUP BY b),
sums AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM counts),
gains AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (s_all + 10000)) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM counts, sums),
weights AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS weight FROM found JOIN gains USING (b) WHERE NOT sought GROUP BY id),
noise AS (SELECT doc_id, floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS g FROM documents),
scored AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + g)::BIGINT AS score
  FROM noise LEFT JOIN weights ON id = doc_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, (SELECT count(*) FROM scored WHERE n_features >= 20) AS fit FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= fit * 10 // 100 THEN place END AS rank FROM numbered"""
