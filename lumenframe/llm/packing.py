"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

1. Documents are tokenised in Arrow batches; longer ones than a sequence are cut, the first piece takes the odd rest.
2. Pieces of one length are interchangeable, so the packing is planned on the number of pieces of each length (at most
   ``limit`` numbers, whatever the size of the corpus). Best fit, longest first, fills bins in bulk: bins of equal
   content are one class with a count.
3. Local search on underfull classes: move one document, exchange one for one, or two for one, always so that the sum
   of squared fills grows, and empty the bins of least fill. It ends when no bin can be saved any more (the free
   space of all bins is less than a sequence), when nothing improves, or after ``effort`` compared pairs of classes.
4. Each piece takes a place of its length by rank. Ranks come from counts per (length, salt) and row numbers inside a
   salt, so a length that a third of all pieces share is spread over many tasks.

Strings of special tokens in a text get the ids that the tokenizer file gives them. Defined cases: null and empty texts are the end token alone;
repeated rows are packed each; a null id is kept as it is; an empty table gives no sequence; other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.llm import arrays as A
from lumenframe.session import cut_lineage

LIMIT = 1024
END = 2
#: Pairs of classes that the local search compares at most.
EFFORT = 200_000

_ENCODERS: dict[tuple[str, str], object] = {}


class Encoder:
    """Token ids of a byte-level BPE, by its rank file; texts it cannot split, or that spell a special token, go through the tokenizer file.

    Both files hold the same vocabulary and give the same ids to all else.
    """

    def __init__(self, ranks: str, tokenizer: str):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        with open(tokenizer, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.file, self.slow = tokenizer, None

    def _by_file(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.file)
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self._by_file(text)
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # the splitter gives up on very long runs of white space
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return self._by_file(text)


def encoder(ranks: str, tokenizer: str) -> Encoder:
    """The encoder of a worker process, loaded once."""
    key = (ranks, tokenizer)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cutter(files: tuple[str, str], limit: int, end: int, keep_ids: bool):
    def run(batches):
        code = encoder(*files)
        for batch in batches:
            docs, piece, start, length, crc, ids = [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = np.array([*code.ids(text or ""), end], "<u4")
                cuts = [0, *range((len(mine) - 1) % limit + 1, len(mine) + 1, limit)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    docs.append(doc)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(mine[a:b].tobytes()))
                    if keep_ids:
                        ids.append(mine[a:b].astype(np.int32))
            columns = [pa.array(docs, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


class Bins:
    """Classes of bins of equal content: ``parts`` (lengths, falling) to the number of such bins."""

    def __init__(self, limit: int):
        self.limit, self.count = limit, defaultdict(int)

    def add(self, parts: tuple[int, ...], n: int) -> None:
        if n and parts:
            self.count[parts] += n

    def take(self, parts: tuple[int, ...], n: int) -> None:
        self.count[parts] -= n
        if not self.count[parts]:
            del self.count[parts]

    def free(self) -> int:
        return sum((self.limit - sum(p)) * n for p, n in self.count.items())


def best_fit(lengths: dict[int, int], limit: int) -> Bins:
    """Best fit, longest first; all pieces of a length at once."""
    bins, open_ = Bins(limit), defaultdict(list)  # free space -> classes with that much
    spaces: list[int] = []

    def put(parts: tuple[int, ...], n: int) -> None:
        bins.add(parts, n)
        free = limit - sum(parts)
        if n and free:
            if not open_[free]:
                bisect.insort(spaces, free)
            if parts not in open_[free]:
                open_[free].append(parts)

    for size in sorted(lengths, reverse=True):
        left = lengths[size]
        while left:
            at = bisect.bisect_left(spaces, size)
            if at == len(spaces):
                break
            free = spaces[at]
            parts = open_[free][-1]
            n = min(left, bins.count[parts])
            bins.take(parts, n)
            if parts not in bins.count:
                open_[free].pop()
                if not open_[free]:
                    spaces.pop(at)
            put((*parts, size), n)
            left -= n
        each = limit // size
        put((size,) * each, left // each)
        put((size,) * (left % each), 1 if left % each else 0)
    return bins


def _exchange(full: tuple[int, ...], low: tuple[int, ...], space: int):
    """``(gain, out of full, out of low)``: what makes ``full`` fullest at the cost of ``low``."""
    best = (0, (), ())
    pairs = lambda p: {(a, b) for i, a in enumerate(p) for b in p[i + 1 :]}
    singles_f, singles_l, pairs_f, pairs_l = set(full), set(low), pairs(full), pairs(low)
    for give in ([()], [(a,) for a in singles_f], list(pairs_f)):
        for get in ([(b,) for b in singles_l], list(pairs_l)):
            if give and len(give[0]) + len(get[0] if get else ()) > 3:
                continue
            for g in give:
                if not g and get and len(get[0]) == 2:
                    continue
                for h in get:
                    gain = sum(h) - sum(g)
                    if best[0] < gain <= space:
                        best = (gain, g, h)
                        if gain == space:
                            return best
    return best


def _without(parts: tuple[int, ...], out: tuple[int, ...], into: tuple[int, ...]) -> tuple[int, ...]:
    left = list(parts)
    for x in out:
        left.remove(x)
    return tuple(sorted((*left, *into), reverse=True))


def local_search(bins: Bins, effort: int) -> Bins:
    """Exchange documents between underfull classes while the sum of squared fills grows."""
    limit = bins.limit
    while effort > 0 and bins.free() >= limit:
        under = sorted((p for p in bins.count if sum(p) < limit), key=lambda p: (sum(p), p))
        moved = False
        for low in under:  # the emptiest first
            for full in reversed(under):
                effort -= 1
                if effort <= 0:
                    break
                if low not in bins.count or full not in bins.count or sum(full) < sum(low):
                    continue
                n = bins.count[low] // 2 if low == full else min(bins.count[low], bins.count[full])
                if not n:
                    continue
                gain, give, get = _exchange(full, low, limit - sum(full))
                if not gain:
                    continue
                bins.take(low, n)
                bins.take(full, n)
                bins.add(_without(full, give, get), n)
                bins.add(_without(low, get, give), n)
                moved = True
                if low not in bins.count:
                    break
            if moved or effort <= 0:
                break
        if not moved:
            break
    return bins


def plan(lengths: dict[int, int], limit: int = LIMIT, effort: int = EFFORT) -> Bins:
    return local_search(best_fit(lengths, limit), effort)


def _places(bins: Bins):
    """Sorted ``length * 2**40 + first rank`` of each run of places, with its first sequence and its offset."""
    used, runs, sequence = defaultdict(int), [], 0
    for parts in sorted(bins.count, reverse=True):
        n, offset = bins.count[parts], 0
        for size in parts:
            runs.append(((size << 40) + used[size], sequence, offset))
            used[size] += n
            offset += size
        sequence += n
    runs.sort()
    return tuple(np.array(x, np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3


def _placer(places):
    first, sequence, offset = places

    def run(batches):
        for batch in batches:
            rank, length = batch.column("rank").to_numpy(), batch.column("length").to_numpy()
            key = (length << 40) + rank
            at = np.searchsorted(first, key, side="right") - 1
            names = [n for n in batch.schema.names if n not in ("rank", "salt", "skip")]
            columns = [batch.column(n) for n in names]
            columns += [pa.array(sequence[at] + key - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, limit: int = LIMIT, end: int = END, files: tuple[str, str] | None = None, keep_ids: bool = False,
         effort: int = EFFORT) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset`` for every piece of ``docs(doc_id, text)``.

    ``files`` are the rank file and the tokenizer file of one vocabulary.
    """
    spark = docs.sparkSession
    A.small_batches(spark)
    schema = PIECES + (", ids array<int>" if keep_ids else "")
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = cut_lineage(pieces.mapInArrow(_cutter(files or default_files(), limit, end, keep_ids), schema))
    # One row per length: at most ``limit`` rows.
    lengths = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    places = _places(plan(lengths, limit, effort))
    salts = A.buckets(spark)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    skips = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("row", F.row_number().over(within)).join(skips, ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("skip") + F.col("row") - 1).cast("long").alias("rank"))
    return ranked.mapInArrow(_placer(places), schema + ", sequence_id long, offset long")
