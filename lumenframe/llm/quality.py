"""Quality scores by co-training a content view and a metadata view.

The content view sees only the text (shape, symbols, case, repetition, lines); the metadata view sees only source,
language and length. Each is a logistic model over binned features. In every round each view labels the unlabelled
documents it is most certain of, for the other view to learn from (Blum and Mitchell, "Combining labeled and unlabeled
data with co-training", 1998). Last, each view is calibrated on labelled rows that trained neither, the calibrated
log-odds are combined, and all documents are scored.

Fitting reads a bounded sample (``LABELLED`` and ``UNLABELLED`` documents, by the hash of their text, repeated texts
once); scoring reads every whole text. Labels are read only from rows whose ``crc32(doc_id as text) % 3`` is not 1, so
the rest measures the result. Defined cases: null and empty texts are documents without words; null metadata is a value
of its own; without labelled rows of both kinds every score is 1 (nothing is rejected); rows that share an id are
scored each; a null label is not used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import arrays as A
from lumenframe.llm.toxicity import held_out

LABELLED, UNLABELLED = 20_000, 20_000
ROUNDS, CONFIDENT, SHARE = 4, 0.97, 0.1
BINS = 16
#: Slots of hashed metadata values.
HASHED = 256
SLICE = 1 << 19
KEEP = 0.5

CONTENT = 20
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_{|}~"]] = True


def content(data, offsets) -> np.ndarray:
    """``CONTENT`` numbers for each text: counts relative to its bytes, words or lines."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, CONTENT))
    start, end, row = A.words(data, offsets)
    count = np.bincount(row, minlength=n)
    some, many = np.maximum(size, 1), np.maximum(count, 1)

    def share(flags) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / some

    out[:, 0] = np.log1p(count)
    out[:, 1] = np.bincount(row, weights=end - start, minlength=n) / many
    for k, flags in enumerate((LETTER[data], UPPER[data], SYMBOL[data], data == ord("!"), data == ord("|"), (data >= 48) & (data < 58),
                               data == ord("."), data == ord(","), data == 10, data >= 128), 2):
        out[:, k] = share(flags)
    if not len(start):
        return out
    by_word = lambda flags: np.bincount(row, weights=flags, minlength=n) / many
    word = A.word_hashes(A.LOWER[data], start, end)
    order = np.lexsort((word, row))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(row[order]) != 0) | (np.diff(word[order]) != 0)
    out[:, 12] = np.bincount(row[order], weights=fresh, minlength=n) / many
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    out[:, 13] = by_word(again)
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[data] | (data == ord("!")))])
    out[:, 14] = by_word(symbols[end] > symbols[start])
    upper, letter = np.concatenate([[0], np.cumsum(UPPER[data])]), np.concatenate([[0], np.cumsum(LETTER[data] & (data < 128))])
    held = letter[end] - letter[start]
    out[:, 15] = by_word((held > 1) & (upper[end] - upper[start] == held))
    out[:, 16] = by_word(held == 0)
    out[:, 17] = by_word(end - start <= 3)
    # Lines: words of a line are runs between line feeds.
    gap = np.zeros(256, bool)
    gap[10] = True
    ls, le, lrow = A.words(data, offsets, gap)
    line = A.word_hashes(data, ls, le)
    order = np.lexsort((line, lrow))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (np.diff(lrow[order]) != 0) | (np.diff(line[order]) != 0)
    lines = np.maximum(np.bincount(lrow, minlength=n), 1)
    out[:, 18] = np.bincount(lrow[order], weights=fresh, minlength=n) / lines
    out[:, 19] = np.log1p(np.bincount(lrow, weights=le - ls, minlength=n) / lines)
    return out


def _content_rows(batches):
    """Replace the text by its content numbers."""
    for batch in batches:
        data, offsets = A.utf8(batch.column("text"))
        rows = []
        for lo, hi in A.slices(offsets, SLICE):
            base = offsets[lo]
            rows += [r.tobytes() for r in content(data[base : offsets[hi]], offsets[lo : hi + 1] - base)]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows, pa.binary())], names=[*names, "content"])
        A.release()


def _edges(x: np.ndarray) -> np.ndarray:
    """Inner quantile edges of each column, one row per column."""
    return np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Feature numbers (one per column) of each row."""
    return np.stack([k * BINS + np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1)


def _fit(features: np.ndarray, y: np.ndarray, weight: np.ndarray, width: int, epochs: int = 200, rate: float = 0.1, penalty: float = 1e-3):
    """Logistic regression over rows of feature numbers; the last weight is the bias."""
    w, m1, m2 = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    total = weight.sum()
    for t in range(1, epochs + 1):
        s = 1 / (1 + np.exp(-np.clip(w[features].sum(axis=1) + w[-1], -30, 30)))
        g = (s - y) * weight / total
        grad = np.bincount(features.ravel(), weights=np.repeat(g, features.shape[1]), minlength=width + 1) + penalty * w
        grad[-1] = g.sum()
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        w = w - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return w


def _logit(w: np.ndarray, features: np.ndarray) -> np.ndarray:
    return np.clip(w[features].sum(axis=1) + w[-1], -15, 15)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _platt(columns: np.ndarray, y: np.ndarray, epochs: int = 100, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression on a few real columns by Newton steps; the last weight is the bias.

    The penalty keeps weights finite where the classes are separable, as one good view alone makes them.
    """
    x = np.column_stack([columns, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    ridge = np.append(np.full(x.shape[1] - 1, penalty), 1e-3)
    for _ in range(epochs):
        s = _sigmoid(np.clip(x @ w, -30, 30))
        hess = (x * (s * (1 - s))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, x.T @ (s - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass(frozen=True)
class Model:
    edges: np.ndarray
    meta_edges: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    both: np.ndarray


def _meta_features(values: np.ndarray, length: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Hashed source and language (two columns of slots) and the binned length."""
    return np.column_stack([values[:, 0] % HASHED, HASHED + values[:, 1] % HASHED, 2 * HASHED + np.searchsorted(edges, length, side="right")])


META_WIDTH = 2 * HASHED + BINS
TEXT_WIDTH = CONTENT * BINS


def co_train(x: np.ndarray, values: np.ndarray, length: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Model | None:
    """Fit both views; ``y`` is 1, 0 or -1 (unlabelled)."""
    rng = np.random.default_rng(0)
    known = np.flatnonzero(y >= 0)
    if len(np.unique(y[known])) < 2:
        return None
    edges, meta_edges = _edges(x), np.quantile(length, np.arange(1, BINS) / BINS)
    views = (_binned(x, edges), _meta_features(values, length, meta_edges))
    widths = (TEXT_WIDTH, META_WIDTH)
    calibrate = rng.random(len(known)) < 0.25
    if len(np.unique(y[known[calibrate]])) < 2 or len(np.unique(y[known[~calibrate]])) < 2:
        calibrate[:] = True  # too few to hold any back
        train = known
    else:
        train = known[~calibrate]
    check = known[calibrate]
    base = y[train].mean()
    taught = [np.full(len(y), -1), np.full(len(y), -1)]
    for t in taught:
        t[train] = y[train]
    free = y < 0
    models = [None, None]
    for r in range(rounds + 1):
        logits = []
        for k in (0, 1):
            use = np.flatnonzero(taught[k] >= 0)
            weight = np.where(free[use], 0.5, 1.0)
            models[k] = _fit(views[k][use], taught[k][use].astype(float), weight, widths[k])
            logits.append(_logit(models[k], views[k]))
        if r == rounds:
            break
        for k in (0, 1):
            scale = _platt(logits[k][check][:, None], y[check])
            p = _sigmoid(scale[0] * logits[k] + scale[1])
            other = taught[1 - k]
            open_ = np.flatnonzero(free & (other < 0))
            most = int(SHARE * free.sum())
            for label, sure, part in ((1, p, base), (0, 1 - p, 1 - base)):
                best = open_[np.argsort(-sure[open_], kind="stable")[: max(1, int(most * part))]]
                other[best[sure[best] >= CONFIDENT]] = label
    scales = [_platt(logits[k][check][:, None], y[check]) for k in (0, 1)]
    both = _platt(np.column_stack([scales[k][0] * logits[k][check] + scales[k][1] for k in (0, 1)]), y[check])
    return Model(edges, meta_edges, models[0], models[1], scales[0], scales[1], both)


def _rows(docs: DataFrame, *extra) -> DataFrame:
    slot = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), F.lit(1 << 30))
    length = F.log1p(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *extra, slot("source").alias("source"), slot("lang").alias("lang"), length.alias("chars"), "text")


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED, rounds: int = ROUNDS) -> Model | None:
    """Learn from ``docs(doc_id, text, lang, source, n_chars)`` and ``labels(doc_id, quality)``, the rows that are not held out."""
    A.small_batches(docs.sparkSession)
    train = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "source", "lang", "n_chars", F.xxhash64("text").alias("h"))
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marked, many = known.count(), train.count()
    if not marked or not many:
        return None
    part = lambda most, n: F.pmod(F.col("h"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / n))
    # Keys are chosen without the texts: at most about ``labelled + unlabelled`` rows, which then fetch them.
    keys = train.select("doc_id", "h")
    taught = keys.where(part(labelled, marked)).join(known, "doc_id").select("doc_id", "h", F.col("quality").cast("int").alias("y"))
    free = keys.where(part(unlabelled, many)).join(known, "doc_id", "left_anti").select("doc_id", "h", F.lit(-1).alias("y"))
    chosen = taught.union(free).groupBy("h", "y").agg(F.min("doc_id").alias("doc_id"))
    sample = _rows(train.join(F.broadcast(chosen), ["doc_id", "h"]), "y").drop("doc_id").distinct()
    rows = sample.mapInArrow(_content_rows, "y int, source long, lang long, chars double, content binary").collect()  # bounded by the sample
    if not rows:
        return None
    rows.sort(key=tuple)
    x = np.frombuffer(b"".join(r[4] for r in rows)).reshape(-1, CONTENT)
    return co_train(x, np.array([[r[1], r[2]] for r in rows]), np.array([r[3] for r in rows]), np.array([r[0] for r in rows]), rounds)


def _scores(model: Model | None, batch: pa.RecordBatch):
    """``(score, content score, metadata score)`` of rows with content numbers."""
    n = batch.num_rows
    if model is None or not n:
        return (np.ones(n),) * 3
    x = np.frombuffer(b"".join(batch.column("content").to_pylist())).reshape(-1, CONTENT)
    values = np.column_stack([batch.column("source").to_numpy(), batch.column("lang").to_numpy()])
    t = model.text_scale[0] * _logit(model.text, _binned(x, model.edges)) + model.text_scale[1]
    m = model.meta_scale[0] * _logit(model.meta, _meta_features(values, batch.column("chars").to_numpy(), model.meta_edges)) + model.meta_scale[1]
    return _sigmoid(np.clip(np.column_stack([t, m, np.ones(n)]) @ model.both, -30, 30)), _sigmoid(t), _sigmoid(m)


def _scorer(model: Model | None):
    def run(batches):
        for batch in _content_rows(batches):
            score, text, meta = _scores(model, batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array(text), pa.array(meta)],
                names=["doc_id", "held_out", "score", "content_score", "metadata_score"],
            )

    return run


def score(docs: DataFrame, model: Model | None, keep: float = KEEP) -> DataFrame:
    """``doc_id, held_out, score, content_score, metadata_score, keep`` for each row of ``docs``; ``keep`` is 1 or 0."""
    A.small_batches(docs.sparkSession)
    rows = _rows(docs, held_out(F.col("doc_id")).alias("held_out"))
    schema = "doc_id long, held_out boolean, score double, content_score double, metadata_score double"
    return rows.mapInArrow(_scorer(model), schema).withColumn("keep", (F.col("score") >= keep).cast("int"))


def keep(docs: DataFrame, model: Model | None, least: float = KEEP) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang, source, n_chars)`` that score at least ``least``, as they are."""
    A.small_batches(docs.sparkSession)
    slots = _rows(docs, F.struct("lang", "source", "n_chars").alias("row"))

    def run(batches):
        for batch in batches:
            scored = next(_content_rows([batch]))
            fine = pa.array(_scores(model, scored)[0] >= least)
            row = batch.column("row")
            columns = [batch.column("doc_id"), batch.column("text"), *(row.field(k) for k in range(3))]
            yield pa.RecordBatch.from_arrays([c.filter(fine) for c in columns], names=["doc_id", "text", "lang", "source", "n_chars"])

    return slots.mapInArrow(run, "doc_id long, text string, lang string, source string, n_chars long")
