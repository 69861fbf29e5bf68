"""Fill-in-the-middle transformation of texts that are stored as seekable compressed frames.

``store`` writes each text as zstandard frames with running counts (:mod:`lumenframe.llm.frames`). ``transform`` draws two cuts
between units from a digest of seed and id, opens the two frames that hold them, and reads the three parts frame by
frame in the order of the form: ``psm`` is prefix, suffix, middle; ``spm`` suffix, prefix, middle, each behind its mark. The output is a
row of frames too; its digest streams them, and the text is rebuilt from output and form alone: its marks are found, and the parts
between them are streamed in the text's own order.

Defined cases: null and empty texts are plain and have no units; a text that holds a mark is plain, since its output could
not be told apart; a null id draws from the empty key; rows that share an id draw the same numbers; a unit longer than a frame is one
frame; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import arrays as A
from lumenframe.llm.frames import FRAME, Frames

SEED = 42
#: Of a hundred texts so many are transformed, and of a hundred of those so many are ``spm``.
RATE, SPM = 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

STORED = "doc_id long, marked boolean, units array<long>, chars array<long>, sizes array<long>, frames array<binary>"
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def _has_mark(data: np.ndarray) -> bool:
    """Whether a mark stands in the bytes; looked for a part at a time."""
    step = 1 << 20
    for a in range(0, len(data), step):
        part = data[a : a + step + 2].tobytes()
        if PREFIX in part or SUFFIX in part or MIDDLE in part:
            return True
    return False


def _storer(frame: int):
    def run(batches):
        for batch in batches:
            data, offsets = A.utf8(batch.column(1))
            marked, kept = [], []
            for a, b in zip(offsets[:-1], offsets[1:]):
                marked.append(_has_mark(data[a:b]))
                kept.append(Frames.of_text(data[a:b], frame))
            longs = [pa.array([getattr(f, name) for f in kept], pa.list_(pa.int64())) for name in ("units", "chars", "sizes")]
            blobs = pa.array([f.blobs for f in kept], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(marked, pa.bool_()), *longs, blobs], names=["doc_id", "marked", "units", "chars", "sizes", "frames"]
            )
            A.release()

    return run


def store(docs: DataFrame, frame: int = FRAME) -> DataFrame:
    """``doc_id, marked, units, chars, sizes, frames`` for each row of ``docs(doc_id, text)``."""
    A.small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_storer(frame), STORED)


def stored_rows(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bool, Frames]]:
    """Id, mark and frames of each row of a stored batch."""
    for row in zip(*(batch.column(name).to_pylist() for name in ("doc_id", "marked", "units", "chars", "sizes", "frames"))):
        yield row[0], row[1], Frames(*row[2:])


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from a digest of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


def select(doc_id: int | None, marked: bool, text: Frames, seed: int, rate: int, spm: int) -> tuple[str, int, int]:
    """``(form, units before the middle, units before the suffix)``."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    n = text.n_units
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "plain" if marked or not text.size or h3 % 100 >= rate else "spm" if h4 % 100 < spm else "psm"
    return form, a, b


def output(text: Frames, form: str, a: int, b: int) -> Iterator[bytes]:
    """The output in pieces; a and b are the bytes before the middle and before the suffix."""
    if form == "plain":
        yield from text.read(0, text.size)
        return
    prefix, suffix, middle = (PREFIX, 0, a), (SUFFIX, b, text.size), (MIDDLE, a, b)
    for mark, lo, hi in (prefix, suffix, middle) if form == "psm" else (suffix, prefix, middle):
        yield mark
        yield from text.read(lo, hi)


def restored(made: Frames, form: str) -> Iterator[bytes]:
    """The text in pieces, from its output and form."""
    if form == "plain":
        yield from made.read(0, made.size)
        return
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    between = made.find(second, len(first))
    last = made.find(MIDDLE, between + len(second))
    parts = {first: (len(first), between), second: (between + len(second), last), MIDDLE: (last + len(MIDDLE), made.size)}
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from made.read(*parts[mark])


def _digest(chunks) -> str:
    sha = hashlib.sha256()
    for chunk in chunks:
        sha.update(chunk)
    return sha.hexdigest()


def _transformer(frame: int, seed: int, rate: int, spm: int, keep: bool):
    def run(batches):
        for batch in batches:
            out = {name: [] for name in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output")}
            for doc_id, marked, text in stored_rows(batch):
                form, a, b = select(doc_id, marked, text, seed, rate, spm)
                (lo, before), (hi, until) = (text.cut(a), text.cut(b)) if form != "plain" else ((0, 0), (0, 0))
                made = Frames.of_chunks(output(text, form, lo, hi), frame)
                out["doc_id"].append(doc_id)
                out["n"].append(text.n_units)
                out["form"].append(form)
                out["prefix_chars"].append(None if form == "plain" else before)
                out["middle_chars"].append(None if form == "plain" else until - before)
                out["output_sha256"].append(_digest(made.read(0, made.size)))
                out["restored_sha256"].append(_digest(restored(made, form)))
                if keep:
                    out["output"].append(b"".join(made.read(0, made.size)).decode())
            kinds = dict.fromkeys(out, pa.string()) | dict.fromkeys(("doc_id", "n", "prefix_chars", "middle_chars"), pa.int64())
            names = [name for name in out if keep or name != "output"]
            yield pa.RecordBatch.from_arrays([pa.array(out[name], kinds[name]) for name in names], names=names)
            A.release()

    return run


def transform(stored: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, frame: int = FRAME, keep: bool = False) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of stored texts; with ``keep`` the ``output`` too."""
    A.small_batches(stored.sparkSession)
    schema = DIGESTS + (", output string" if keep else "")
    return stored.mapInArrow(_transformer(frame, seed, rate, spm, keep), schema)


def oracle(seed: int = SEED, rate: int = RATE, spm: int = SPM) -> str:
    """The query in SQL; the text is rebuilt from the marks of the output."""
    return rf"""
WITH units AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  list_transform(range(4), lambda i: ('0x' || substr(sha256('{seed}:' || doc_id), i * 8 + 1, 8))::BIGINT) AS h FROM documents),
cuts AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= {rate} THEN 'plain'
    WHEN h[4] % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM units),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cuts),
outputs AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM parts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars, sha256(o) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN substr(o, 4, strpos(o, '<S>') - 4) || substr(o, strpos(o, '<M>') + 3) ||
    substr(o, strpos(o, '<S>') + 3, strpos(o, '<M>') - strpos(o, '<S>') - 3)
    ELSE substr(o, strpos(o, '<P>') + 3, strpos(o, '<M>') - strpos(o, '<P>') - 3) || substr(o, strpos(o, '<M>') + 3) || substr(o, 4, strpos(o, '<P>') - 4) END) AS restored_sha256
FROM outputs"""
