"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic texts are taken as labelled; every other text is unlabelled, and the classifier minimises
``prior * E+[loss(f, 1)] + max(0, Eu[loss(f, -1)] - prior * E+[loss(f, -1)])`` (Kiryo et al., "Positive-unlabeled
learning with non-negative risk estimator", 2017) with the logistic loss, so its output estimates a probability.

Features are the words of a text, the beginnings of its words and the pieces of ``GRAM`` bytes of them, hashed, present or not; a
beginning gathers the forms of a word that are each too rare to be learned. Those that are much more frequent in toxic than in
unlabelled texts are selected by counts that tasks add up first. Fitting reads a bounded sample (``POSITIVES`` and
``UNLABELLED`` documents by the hash of their text, repeated texts once); scoring reads every whole text.

Labels are read only from rows whose ``crc32(doc_id as text) % 3`` is not 1. Labels, language, source and id are no
inputs of a score. Defined cases: null and empty texts have no features and get the score of the bias; without a
confirmed toxic text every score is 0; a null id counts as an empty text in the checksum; rows that share an id are
scored each; a label row without a document or with a null label is not used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import arrays as A

BITS = 20
GRAM = 5
#: Bytes of the beginnings of longer words.
BEGINNINGS = (4, 5, 6, 7, 8)
POSITIVES, UNLABELLED = 20_000, 40_000
#: A feature is used when toxic texts have it this many times as often, and this many standard deviations above.
LIFT, DEVIATIONS, MOST = 5.0, 6.0, 4096
SLICE = 1 << 19
THRESHOLD = 0.7

GAP = np.ones(256, bool)
GAP[65:91] = GAP[97:123] = False
GAP[128:] = False


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def features(data, offsets, wanted: np.ndarray | None = None):
    """``(row, feature)`` of the distinct features of every row; only ``wanted`` ones (a table of flags) if given."""
    low = A.LOWER[data]
    start, end, row = A.words(low, offsets, GAP)
    hashes = A.PrefixHash(low, A.BASE_A)
    mask = np.uint64((1 << BITS) - 1)
    code = [(A.mix(hashes.ranges(start, end) + (end - start).astype(np.uint64)) & mask).astype(np.int64)]
    rows = [row]
    for k in BEGINNINGS:
        long = np.flatnonzero(end - start > k)
        code.append((A.mix(hashes.ranges(start[long], start[long] + k) + np.uint64(k * A.BASE_B % (1 << 64))) & mask).astype(np.int64))
        rows.append(row[long])
    words_end = len(code)
    grams = hashes.windows(GRAM)
    if len(grams):
        inside = np.concatenate([[0], np.cumsum(GAP[low])])
        edges = np.zeros(len(low) + 1, np.int32)
        edges[offsets[1:-1]] = 1
        edge = np.cumsum(edges)
        n = len(grams)
        fine = (inside[GRAM : GRAM + n] == inside[:n]) & (edge[GRAM - 1 : GRAM - 1 + n] == edge[:n])
        at = np.flatnonzero(fine)
        gram = (A.mix(grams[at] ^ np.uint64(A.BASE_B)) & mask).astype(np.int64)
        if wanted is not None:
            hit = wanted[gram]
            at, gram = at[hit], gram[hit]
        code.append(gram)
        rows.append(np.searchsorted(offsets, at, side="right") - 1)
    if wanted is not None:
        for i in range(words_end):
            hit = wanted[code[i]]
            code[i], rows[i] = code[i][hit], rows[i][hit]
    both = np.unique((np.concatenate(rows) << BITS) + np.concatenate(code))
    return both >> BITS, both & ((1 << BITS) - 1)


def _counter(batches):
    """Documents per feature, toxic (first half) and unlabelled, of one task."""
    total = np.zeros(2 << BITS, np.int32)
    many = np.zeros(2, np.int64)
    for batch in batches:
        data, offsets = A.utf8(batch.column(0))
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        many += [toxic.sum(), (~toxic).sum()]
        for lo, hi in A.slices(offsets, SLICE):
            base = offsets[lo]
            row, code = features(data[base : offsets[hi]], offsets[lo : hi + 1] - base)
            total += np.bincount(np.where(toxic[row + lo], code, code + (1 << BITS)), minlength=2 << BITS).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array([A.pack(total)], pa.binary()), pa.array([A.pack(many)], pa.binary())], names=["counts", "rows"])


def _add(table: pa.Table) -> pa.Table:
    counts = sum(A.unpack(x, np.int32) for x in table.column("counts").to_pylist())
    many = sum(A.unpack(x, np.int64) for x in table.column("rows").to_pylist())
    return pa.table({"counts": pa.array([A.pack(counts)], pa.binary()), "rows": pa.array([A.pack(many)], pa.binary())})


@dataclass(frozen=True)
class Model:
    """Selected features (rising), their weights and the bias; ``bias`` None: nothing was learned."""

    chosen: np.ndarray
    weights: np.ndarray
    bias: float | None


def select(counts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Features that lift toxicity, the most significant first, at most ``MOST``; returned in rising order."""
    pos, unl = counts[: 1 << BITS].astype(float), counts[1 << BITS :].astype(float)
    p, u = (pos + 0.5) / (many[0] + 1), (unl + 0.5) / (many[1] + 1)
    z = (p - u) / np.sqrt(u * (1 - np.minimum(u, 0.999)) / max(1, many[0]) + 1e-12)
    fit = np.flatnonzero((p >= LIFT * u) & (z >= DEVIATIONS) & (pos >= 3))
    return np.sort(fit[np.argsort(-z[fit], kind="stable")[:MOST]])


def fit_nnpu(indices: np.ndarray, starts: np.ndarray, toxic: np.ndarray, width: int, prior: float, epochs: int = 300,
             rate: float = 0.1, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk.

    Row i has the features ``indices[starts[i]:starts[i + 1]]``, present once each.
    """
    n = len(starts) - 1
    row = np.repeat(np.arange(n), np.diff(starts))
    w, b = np.zeros(width), np.log(prior / (1 - prior))
    m1, m2 = np.zeros(width + 1), np.zeros(width + 1)
    pos, unl = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    for t in range(1, epochs + 1):
        f = np.bincount(row, weights=w[indices], minlength=n) + b
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        softplus = np.logaddexp(0, f)
        negative = softplus[unl].mean() - prior * softplus[pos].mean()
        g = np.zeros(n)
        g[pos] = prior * (s[pos] - 1) / len(pos)
        if negative >= 0:
            g[unl] += s[unl] / len(unl)
            g[pos] -= prior * s[pos] / len(pos)
        else:  # the estimate of the negative part went below zero: step back on that part
            g[:] = 0
            g[unl] -= s[unl] / len(unl)
            g[pos] += prior * s[pos] / len(pos)
        grad = np.append(np.bincount(indices, weights=g[row], minlength=width) + penalty * w, g.sum())
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad * grad
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _chosen_features(chosen: np.ndarray):
    def run(batches):
        wanted = np.zeros(1 << BITS, bool)
        wanted[chosen] = True
        for batch in batches:
            data, offsets = A.utf8(batch.column(0))
            rows = []
            for lo, hi in A.slices(offsets, SLICE):
                base = offsets[lo]
                row, code = features(data[base : offsets[hi]], offsets[lo : hi + 1] - base, wanted)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                place = np.searchsorted(chosen, code).astype(np.uint16)
                rows += [place[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], names=["places", "toxic"])
            A.release()

    return run


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, the rows that are not held out."""
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), None)
    A.small_batches(docs.sparkSession)
    train = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", F.xxhash64("text").alias("h"))
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    stats = known.agg(F.avg("toxic"), F.sum("toxic")).first()
    many = train.count()
    if not stats[1] or not many:
        return nothing
    prior = min(0.95, max(0.001, stats[0]))
    # Hash thresholds give bounded samples; equal texts have equal hashes and are then taken once.
    part = lambda most, n: F.pmod(F.col("h"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / n))
    toxic = known.where("toxic = 1").select("doc_id")
    pos = train.where(part(positives, stats[1])).join(toxic, "doc_id", "left_semi").withColumn("toxic", F.lit(True))
    unl = train.where(part(unlabelled, many)).withColumn("toxic", F.lit(False))
    keys = pos.select("h", "toxic", "doc_id").union(unl.select("h", "toxic", "doc_id")).groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id"))
    # At most about ``positives + unlabelled`` short rows: the texts stay where they are.
    sample = train.select("doc_id", "text", "h").join(F.broadcast(keys), ["doc_id", "h"]).select("text", "toxic")
    packed = sample.mapInArrow(_counter, "counts binary, rows binary").withColumn("slot", F.spark_partition_id() % 8)
    sums = packed.groupBy("slot").applyInArrow(_add, "counts binary, rows binary").collect()
    counts, seen = sum(A.unpack(r[0], np.int32) for r in sums), sum(A.unpack(r[1], np.int64) for r in sums)
    chosen = select(counts, seen)
    if not len(chosen) or not seen.all():
        return nothing
    rows = sample.mapInArrow(_chosen_features(chosen), "places binary, toxic boolean").collect()  # bounded by the sample
    places = [np.frombuffer(r[0], np.uint16) for r in rows]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in places])])
    weights, bias = fit_nnpu(np.concatenate(places).astype(np.int64), starts, np.array([r[1] for r in rows]), len(chosen), prior)
    return Model(chosen, weights, bias)


def _scores(model: Model, column, tables) -> np.ndarray:
    """Score of each text of an Arrow column."""
    wanted, weight = tables
    score = np.zeros(len(column))
    if model.bias is None or not len(column):
        return score
    data, offsets = A.utf8(column)
    for lo, hi in A.slices(offsets, SLICE):
        base = offsets[lo]
        row, code = features(data[base : offsets[hi]], offsets[lo : hi + 1] - base, wanted)
        f = np.bincount(row, weights=weight[code], minlength=hi - lo) + model.bias
        score[lo:hi] = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    return score


def _tables(model: Model) -> tuple[np.ndarray, np.ndarray]:
    wanted, weight = np.zeros(1 << BITS, bool), np.zeros(1 << BITS)
    wanted[model.chosen], weight[model.chosen] = True, model.weights
    return wanted, weight


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs(doc_id, text)``."""
    A.small_batches(docs.sparkSession)

    def run(batches):
        tables = _tables(model)
        for batch in batches:
            scores = pa.array(_scores(model, batch.column(2), tables))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], names=["doc_id", "held_out", "score"])
            A.release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, as they are."""
    A.small_batches(docs.sparkSession)

    def run(batches):
        tables = _tables(model)
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column("text"), tables) < threshold))
            A.release()

    return docs.mapInArrow(run, docs.schema)
