"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into short paragraphs: lines, their sentences, and long runs of words at content-defined places. Each
paragraph (and the number of earlier equal ones) gives a digest, and a digest adds one to the count, itself to the sum
and its checksum to the check sum of one cell in each of three tables (Goodrich and Mitzenmacher, "Invertible Bloom
lookup tables", 2011). Sketches of two versions are subtracted cell by cell; cells that hold a single digest are peeled until
none is left, which recovers the paragraphs that differ. Where peeling stops early, both versions are sketched again
with four times the cells. The likeness of two versions is shared paragraphs over all paragraphs of either.

The fingerprint is the sketch of the first size, in base 64: equal texts have equal fingerprints.

Neighbouring documents meet without a global sort: ids are dealt into ranges of about equal size, and the first document of the
next range is added to each range. Defined cases: null text is empty; two texts without paragraphs have likeness 1; a
null id comes last in the falling order; rows with equal ids are ordered by the hash of their text, falling; one document alone is its own
successor. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import arrays as A

#: Cells of each of the three tables at first.
CELLS = 8
TABLES = 3
#: A word whose hash is divisible by this ends a paragraph, so that none grows long.
SPAN = 24
SLICE = 1 << 20
#: Cells held at a time while peeling.
ROOM = 1 << 20
LOWEST = -(1 << 63)
SALT = np.uint64(A.BASE_B)

STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?"]] = True


def paragraphs(data, offsets) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of every paragraph; equal paragraphs of a row have different keys, the same in every text."""
    start, end, row = A.words(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = A.word_hashes(data, start, end)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.ones(len(start), bool)
    last[:-1] = (row[1:] != row[:-1]) | (lines[start[1:]] != lines[end[:-1]])
    last |= STOP[data[end - 1]] | (word % np.uint64(SPAN) == 0)
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    size = np.diff(np.append(first, len(start)))
    place = A.ranges_of(size).astype(np.uint64)
    code = A.mix(np.add.reduceat(A.mix(word + place * SALT), first) + size.astype(np.uint64))
    owner = row[first]
    order = np.lexsort((code, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(owner[order]) != 0) | (np.diff(code[order]) != 0)
    begin = np.flatnonzero(fresh)
    times = A.ranges_of(np.diff(np.append(begin, len(order)))).astype(np.uint64)
    return owner[order], A.mix(code[order] + times * np.uint64(A.BASE_A))


def _check(key: np.ndarray) -> np.ndarray:
    return (A.mix(key ^ SALT) >> np.uint64(32)).astype(np.uint32)


def _cells(key: np.ndarray, cells: int):
    """The cell of each key in each table."""
    return [(A.mix(key + np.uint64((t + 1) * A.BASE_B % (1 << 64))) % np.uint64(cells)).astype(np.int64) + t * cells for t in range(TABLES)]


class Sketches:
    """One sketch per row: counts, sums of keys and of checksums (modulo 2**64 and 2**32)."""

    def __init__(self, rows: int, cells: int):
        self.rows, self.cells, self.width = rows, cells, TABLES * cells
        self.count = np.zeros(rows * self.width, np.int32)
        self.key = np.zeros(rows * self.width, np.uint64)
        self.check = np.zeros(rows * self.width, np.uint32)

    def add(self, row: np.ndarray, key: np.ndarray, sign) -> None:
        """Add (sign 1) or take away (-1) keys of rows."""
        sign = np.broadcast_to(np.asarray(sign, np.int64), key.shape)
        signed, checks = key * sign.astype(np.uint64), _check(key) * sign.astype(np.uint32)
        for cell in _cells(key, self.cells):
            at = row * self.width + cell
            np.add.at(self.count, at, sign.astype(np.int32))
            np.add.at(self.key, at, signed)
            np.add.at(self.check, at, checks)

    def text(self, row: int) -> str:
        a, b = row * self.width, (row + 1) * self.width
        return base64.b64encode(self.count[a:b].tobytes() + self.key[a:b].tobytes() + self.check[a:b].tobytes()).decode()

    def peel(self):
        """``(left, right, done)`` per row: keys only in the first and only in the second version; whether all came out."""
        left, right = np.zeros(self.rows, np.int64), np.zeros(self.rows, np.int64)
        while True:
            at = np.flatnonzero(np.abs(self.count) == 1)
            sign = self.count[at].astype(np.int64)
            key = self.key[at] * sign.astype(np.uint64)
            pure = self.check[at] * sign.astype(np.uint32) == _check(key)
            at, sign, key = at[pure], sign[pure], key[pure]
            if not len(at):
                break
            row = at // self.width
            order = np.lexsort((key, row))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (np.diff(row[order]) != 0) | (np.diff(key[order]) != 0)
            row, sign, key = row[order][fresh], sign[order][fresh], key[order][fresh]
            left += np.bincount(row[sign > 0], minlength=self.rows)
            right += np.bincount(row[sign < 0], minlength=self.rows)
            self.add(row, key, -sign)
        rest = (self.count != 0) | (self.key != 0) | (self.check != 0)
        return left, right, ~rest.reshape(self.rows, self.width).any(axis=1)


def likeness(a, b, n: int, cells: int = CELLS) -> np.ndarray:
    """Likeness of ``n`` pairs of versions, each given as rising ``(row, key)`` of its paragraphs."""
    size_a, size_b = np.bincount(a[0], minlength=n), np.bincount(b[0], minlength=n)
    differ = np.zeros(n, np.int64)
    todo = np.arange(n)
    while len(todo):
        step, failed = max(1, ROOM // (TABLES * cells)), []
        for lo in range(0, len(todo), step):
            mine = todo[lo : lo + step]
            place = np.full(n, -1)
            place[mine] = np.arange(len(mine))
            sketch = Sketches(len(mine), cells)
            for (row, key), sign in ((a, 1), (b, -1)):
                here = place[row]
                sketch.add(here[here >= 0], key[here >= 0], sign)
            left, right, done = sketch.peel()
            differ[mine[done]] = (left + right)[done]
            failed.append(mine[~done])
        todo, cells = np.concatenate(failed), cells * 4
    shared = (size_a + size_b - differ) / 2
    total = shared + differ
    return np.where(total > 0, shared / np.maximum(total, 1), 1.0)


def _prints(row: np.ndarray, key: np.ndarray, n: int, cells: int = CELLS) -> list[str]:
    sketch = Sketches(n, cells)
    sketch.add(row, key, 1)
    return [sketch.text(k) for k in range(n)]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _compare(edit):
    """Fingerprints of the documents of one range and of their edited texts; the last row is the next range's first."""

    def run(table: pa.Table) -> pa.Table:
        frame = table.select(["doc_id", "place", "h", "guest", "text"])
        guest = frame.column("guest").to_numpy(zero_copy_only=False).astype(bool)
        place, h = frame.column("place").to_numpy(), frame.column("h").to_numpy()
        order = np.lexsort((~h, ~place, guest))  # ~x falls as x rises, without overflow
        own = int((~guest).sum())
        order = np.append(order[:own], order[own] if guest.any() else order[0])
        texts = [t or "" for t in frame.column("text").take(pa.array(order)).to_pylist()]
        out = {"n_chars": [], "sha": [], "print": [], "edited": [], "near": [], "next": []}
        sizes = np.array([len(t) for t in texts])
        at = 0
        while at < own:
            to = at + 1
            total = sizes[at]
            while to < own and total + sizes[to] <= SLICE:
                total += sizes[to]
                to += 1
            mine, changed = texts[at : to + 1], [edit(texts[k], texts[k + 1]) for k in range(at, to)]
            n = to - at
            row, key = paragraphs(*A.utf8(pa.array(mine, pa.large_string())))
            erow, ekey = paragraphs(*A.utf8(pa.array(changed, pa.large_string())))
            inner = row < n
            out["n_chars"] += sizes[at:to].tolist()
            out["sha"] += [hashlib.sha256(c.encode()).hexdigest() for c in changed]
            out["print"] += _prints(row[inner], key[inner], n)
            out["edited"] += _prints(erow, ekey, n)
            out["near"] += likeness((row[inner], key[inner]), (erow, ekey), n).tolist()
            out["next"] += likeness((row[inner], key[inner]), (row[row > 0] - 1, key[row > 0]), n).tolist()
            at = to
        ids = frame.column("doc_id").take(pa.array(order[:own]))
        return pa.table({
            "doc_id": ids, "n_chars": pa.array(out["n_chars"], pa.int64()), "edited_sha256": pa.array(out["sha"], pa.string()),
            "fingerprint": pa.array(out["print"], pa.string()), "edited_fingerprint": pa.array(out["edited"], pa.string()),
            "near_edited": pa.array(out["near"], pa.float64()), "near_next": pa.array(out["next"], pa.float64()),
        })

    return run


def last_third_from_next(text: str, following: str) -> str:
    """The text with its last third (in code points) replaced by as much of the next text's beginning."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def versions(docs: DataFrame, edit=last_third_from_next) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)``, of their edited texts (``edit(text, next text)``), and likenesses.

    The next document has the next smaller id; after the last comes the first.
    """
    spark = docs.sparkSession
    A.small_batches(spark)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("place"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text",
    )
    n = 4 * A.buckets(spark)
    # At most one bound per range; ids in between are exact whole numbers, only the choice of bounds is approximate.
    bounds = np.unique(np.array(rows.approxQuantile("place", [k / n for k in range(1, n)], 0.25 / n), float))
    bounds = np.clip(bounds, -(2.0**62), 2.0**62).astype(np.int64)

    @F.pandas_udf("int")
    def range_of(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, place.to_numpy()).astype(np.int32))

    dealt = rows.withColumn("range", range_of("place"))
    # The first document of each range (at most ``n`` rows) is also the successor of the range above.
    heads = rows.select("place", "h").withColumn("range", range_of("place")).groupBy("range")
    heads = heads.agg(F.max(F.struct("place", "h")).alias("m"))
    found = sorted((r["range"], r["m"]["place"], r["m"]["h"]) for r in heads.collect())
    above = {r: found[(k + 1) % len(found)][0] for k, (r, _, _) in enumerate(found)}
    table = spark.createDataFrame([(p, h, above[r]) for r, p, h in found], "place long, h long, range int") if len(found) > 1 else None
    all_ = dealt.withColumn("guest", F.lit(False))
    if table is not None:
        guests = rows.join(F.broadcast(table), ["place", "h"]).select(*dealt.columns).withColumn("guest", F.lit(True))
        all_ = all_.union(guests)
    return all_.groupBy("range").applyInArrow(_compare(edit), RESULT)
