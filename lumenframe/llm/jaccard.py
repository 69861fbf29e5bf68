"""Exact Jaccard join of documents on word n-grams, by token-combination prefixes, and its components.

A document's set holds its distinct shingles of ``size`` words; two documents link when ``100 * common`` is at
least ``percent`` times the size of their union.

1. *Counts.* Hashed shingles go to buckets, packed per batch; each bucket counts the documents of a shingle. A
   shingle of one document can match nothing, so only the others come back, with their frequency.
2. *Prefixes.* A set's shingles are ordered from rare to frequent. If n is its size and o the least overlap a partner
   must have, at most n - o shingles may be missing from the partner. Rare shingles are indexed alone. Frequent ones
   are dealt into classes and indexed by pairs within a class; the prefix is extended by one shingle for each class it
   uses, so that a partner that shares less than one rare shingle and less than two of every class misses too many.
   The number of classes follows the size of the set, which keeps the pairs linear in the length of a document.
3. *Verification.* Sets that share an index entry meet at the entry's smallest document, its hub. A document is first
   compared with its smallest hub, then with other hubs that are not yet in its component, and last, where it still
   differs from a hub, with the members of that hub in blocks. Pairs inside a component are never needed, so no group
   is spelled out as pairs, and no link between components is lost.

Defined cases: words are ASCII-lowered runs between ASCII white space; fewer words than ``size`` make one shingle of
all words; without words or text the set is empty and links with nothing; equal sets are one class from the start;
rows that share an id link like any others; a null id is counted but has no component. An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import arrays as A
from lumenframe.llm.rows import deal, numbered, runs
from lumenframe.operators.graph import connected_components
from lumenframe.session import cut_lineage

SIZE = 5
PERCENT = 75
#: Documents of a shingle from which it counts as frequent and is indexed by pairs.
FREQUENT = 64
#: Members of a hub compared with one document at a time.
BLOCK = 128
#: Bytes of text whose hashes are in memory at a time.
SLICE = 1 << 19
TIERS = 8  # steps per doubling of the frequency

PACKED = "kind int, bucket int, ids binary, a binary, b binary, c binary"
FIELDS = ("ids", "a", "b", "c")


def shingles(data, offsets, size: int):
    """``(row, hash)`` of the distinct shingles of every row, ordered by row and hash."""
    start, end, row = A.words(data, offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = A.word_hashes(A.LOWER[data], start, end)
    count = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    pieces = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(count)), pieces)
    at = first[owner] + A.ranges_of(pieces)
    long = count[owner] >= size
    code = np.zeros(len(owner), np.uint64)
    step = np.uint64(A.BASE_B)
    for k in range(size):
        more = long | (k < count[owner])
        code = np.where(more, A.mix(code * step + word[np.where(more, at + k, 0)] + np.uint64(1)), code)
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    fresh = np.ones(len(code), bool)
    fresh[1:] = (np.diff(owner) != 0) | (np.diff(code) != 0)
    return owner[fresh], code[fresh]


def _table(rows) -> pa.RecordBatch:
    kind, bucket, *blobs = zip(*rows) if rows else ((),) * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)],
        names=["kind", "bucket", *FIELDS],
    )


def _columns(table: pa.Table, kind: int) -> dict[str, list]:
    picked = table.filter(pa.array(table.column("kind").to_numpy() == kind))
    return {f: picked.column(f).to_pylist() for f in FIELDS}


def _marker(n: int, size: int):
    """Map side: shingles of a batch by bucket (kind 1), and the digest of every set by its own bucket (kind 0)."""

    def one(batch):
        ids = batch.column(0).to_numpy()
        if not len(ids):
            return _table([])
        data, offsets = A.utf8(batch.column(1))
        rows_, codes = [], []
        for lo, hi in A.slices(offsets, SLICE):
            base = offsets[lo]
            row, code = shingles(data[base : offsets[hi]], offsets[lo : hi + 1] - base, size)
            rows_.append(row + lo)
            codes.append(code)
        row, code = np.concatenate(rows_), np.concatenate(codes)
        count = np.bincount(row, minlength=len(ids))
        digest = np.zeros(len(ids), np.uint64)
        np.add.at(digest, row, A.mix(code ^ np.uint64(A.BASE_B)))
        digest = A.mix(digest + count.astype(np.uint64))
        empty = count == 0
        digest[empty] = A.mix(ids[empty].astype(np.uint64))
        rows = []
        bucket = (digest >> np.uint64(33)).astype(np.int64) % n
        order = np.lexsort((ids, digest, bucket))
        for b, i, j in runs(bucket[order]):
            x = order[i:j]
            rows.append((0, b, A.pack(ids[x]), A.pack(digest[x]), A.pack(count[x].astype(np.uint32)), b""))
        # Equal sets of a batch are sent once.
        order = np.lexsort((ids, digest))
        first = np.ones(len(order), bool)
        first[1:] = np.diff(digest[order]) != 0
        alone = np.zeros(len(ids), bool)
        alone[order[first]] = True
        keep = alone[row]
        doc, code = ids[row[keep]], code[keep]
        bucket = ((code >> np.uint64(48)) % np.uint64(n)).astype(np.int64)
        order = np.lexsort((doc, bucket))
        doc, code, bucket = doc[order], code[order], bucket[order]
        for b, i, j in runs(bucket):
            fresh = np.flatnonzero(np.concatenate([[True], np.diff(doc[i:j]) != 0]))
            sizes = np.diff(np.append(fresh, j - i)).astype(np.uint32)
            rows.append((1, b, A.pack_rising(doc[i:j][fresh]), A.pack(sizes), A.six_bytes(code[i:j]), b""))
        return _table(rows)

    return A.each(one)


def _counter(n: int):
    """Reduce side of a bucket: classes of equal sets, and the shingles that several documents have."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        cols = _columns(table, 0)
        if cols["ids"]:
            ids = np.concatenate([A.unpack(x, np.int64) for x in cols["ids"]])
            digest = np.concatenate([A.unpack(x, np.uint64) for x in cols["a"]])
            count = np.concatenate([A.unpack(x, np.uint32) for x in cols["b"]])
            order = np.lexsort((ids, digest))
            first = np.ones(len(order), bool)
            first[1:] = np.diff(digest[order]) != 0
            least = ids[order][first][np.cumsum(first) - 1]
            ids, count = ids[order], count[order]
            bucket = deal(ids, n)
            by = np.lexsort((ids, bucket))
            for b, i, j in runs(bucket[by]):
                x = by[i:j]
                rows.append((0, b, A.pack_rising(ids[x]), A.pack(count[x]), A.pack(ids[x] - least[x]), b""))
        cols = _columns(table, 1)
        if cols["ids"]:
            mine = np.uint64(table.column("bucket")[0].as_py()) << np.uint64(48)
            doc = np.concatenate([np.repeat(A.unpack_rising(x), A.unpack(s, np.uint32)) for x, s in zip(cols["ids"], cols["a"])])
            code = A.from_six_bytes(b"".join(cols["b"]))
            # A repeated row sends its shingles from each batch that holds it: they count once.
            order = np.lexsort((doc, code))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (np.diff(code[order]) != 0) | (np.diff(doc[order]) != 0)
            order = order[fresh]
            same = np.concatenate([[0], np.cumsum(np.diff(code[order]) != 0)])
            held = np.bincount(same)[same]
            order, held = order[held > 1], held[held > 1]
            doc, code = doc[order], code[order]
            tier = np.minimum(255, TIERS * np.log2(held)).astype(np.uint8)
            bucket = deal(doc, n)
            by = np.lexsort((code, doc, bucket))
            doc, code, tier, bucket = doc[by], code[by], tier[by], bucket[by]
            for b, i, j in runs(bucket):
                rows.append((1, b, A.pack_rising(doc[i:j]), A.pack(tier[i:j]), A.pack(np.array([mine])), A.six_bytes(code[i:j])))
        return pa.Table.from_batches([_table(rows)])

    return A.group(run)


LIVE = "id long, n int, shared int, codes binary, tiers binary, first long"


def _gather(percent: int):
    """Per bucket of documents: class and size of each, and the shared shingles of those that can have a partner.

    Rows: every document with the first id of its class (``codes`` null), and every first document that may link.
    """

    def run(table: pa.Table) -> pa.Table:
        cols = _columns(table, 0)
        ids = np.concatenate([A.unpack_rising(x) for x in cols["ids"]])
        n = np.concatenate([A.unpack(x, np.uint32) for x in cols["a"]]).astype(np.int64)
        first = ids - np.concatenate([A.unpack(x, np.int64) for x in cols["b"]])
        order = np.argsort(ids, kind="stable")
        ids, n, first = ids[order], n[order], first[order]
        out = {"id": [pa.array(ids)], "n": [pa.array(n, pa.int32())], "shared": [pa.nulls(len(ids), pa.int32())],
               "codes": [pa.nulls(len(ids), pa.binary())], "tiers": [pa.nulls(len(ids), pa.binary())], "first": [pa.array(first)]}
        cols = _columns(table, 1)
        if cols["ids"]:
            parts = [A.unpack_rising(x) for x in cols["ids"]]
            doc = np.concatenate(parts)
            tier = np.concatenate([A.unpack(x, np.uint8) for x in cols["a"]])
            code = A.from_six_bytes(b"".join(cols["c"]))
            code |= np.concatenate([np.full(len(p), A.unpack(x, np.uint64)[0], np.uint64) for p, x in zip(parts, cols["b"])])
            at = np.searchsorted(ids, doc)
            share = np.bincount(at, minlength=len(ids))
            live = (first == ids) & (100 * share >= percent * n) & (n > 0)
            keep = live[at]
            at, tier, code = at[keep], tier[keep], code[keep]
            order = np.lexsort((code, tier, at))
            at, tier, code = at[order], tier[order], code[order]
            who = np.flatnonzero(live)
            edge = np.searchsorted(at, np.append(who, len(ids)))
            for name, values in (("id", ids[who]), ("n", n[who]), ("shared", share[who]), ("first", first[who])):
                out[name].append(pa.array(values, pa.int64() if name in ("id", "first") else pa.int32()))
            raw, flat = code.tobytes(), tier.tobytes()
            out["codes"].append(pa.array([raw[8 * a : 8 * b] for a, b in zip(edge[:-1], edge[1:])], pa.binary()))
            out["tiers"].append(pa.array([flat[a:b] for a, b in zip(edge[:-1], edge[1:])], pa.binary()))
        return pa.table({k: pa.chunked_array(v) for k, v in out.items()})

    return A.group(run)


def least_overlap(n, percent: int):
    """The overlap that any partner of a set of n must have with it."""
    return -(-n * percent // 100)


def levels(n: int, percent: int) -> tuple[int, int]:
    """Two size levels: sets whose sizes may link have one in common. A level spans a factor of 100 / percent."""
    level = int(np.floor(np.log(n) / np.log(100 / percent) + 1e-9))
    return level, level + 1


def classes(level: int, percent: int) -> int:
    """Classes of frequent shingles at a size level: about eight prefix shingles in each; none for tiny sets."""
    prefix = (100 / percent) ** level * (1 - percent / 100)
    return 0 if prefix < 2 else max(1, int(prefix / 8))


def signatures(n: int, codes: np.ndarray, tiers: np.ndarray, percent: int, frequent: int) -> np.ndarray:
    """Index entries of a set: its shared shingles come ordered from rare to frequent."""
    need = n - least_overlap(n, percent) + 1 - (n - len(codes))
    limit = min(255, int(TIERS * np.log2(frequent)))
    rare = int(np.searchsorted(tiers, limit))
    if rare >= need:
        return A.mix(codes[:need])
    parts = [A.mix(codes[:rare])]
    rest, need = codes[rare:], need - rare
    spread = A.mix(rest ^ np.uint64(A.BASE_A))
    for level in levels(n, percent):
        tag = np.uint64((level + 1) * A.BASE_B % (1 << 64))
        m = classes(level, percent)
        if m == 0:
            parts.append(A.mix(rest[:need] + tag))
            continue
        group = (spread % np.uint64(m)).astype(np.int64)
        seen = np.zeros(len(group), bool)
        seen[np.unique(group, return_index=True)[1]] = True
        length = int(np.searchsorted(np.cumsum(~seen), need)) + 1  # each class pays its first shingle
        order = np.argsort(group[:length], kind="stable")
        g, c = group[order], rest[order]
        for gap in range(1, int(np.bincount(g).max())):
            pair = np.flatnonzero(g[gap:] == g[:-gap])
            a, b = c[pair], c[pair + gap]
            parts.append(A.mix(A.mix(np.minimum(a, b) + tag) + np.maximum(a, b)))
    return np.concatenate(parts)


def _indexer(n: int, percent: int, frequent: int):
    """Map side of the index: entries of each live document, packed by bucket."""

    def one(batch):
        ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(ids):
            return _table([])
        entries = [
            signatures(int(k), np.frombuffer(c, np.uint64), np.frombuffer(t, np.uint8), percent, frequent)
            for k, c, t in zip(sizes, batch.column(2).to_pylist(), batch.column(3).to_pylist())
        ]
        doc, entry = np.repeat(ids, [len(e) for e in entries]), np.concatenate(entries)
        bucket = ((entry >> np.uint64(48)) % np.uint64(n)).astype(np.int64)
        order = np.lexsort((doc, bucket))
        return _table([(1, b, A.pack_rising(doc[order[i:j]]), A.six_bytes(entry[order[i:j]]), b"", b"") for b, i, j in runs(bucket[order])])

    return A.each(one)


def _hubs(n: int):
    """Reduce side of the index: each document of an entry with the entry's smallest document."""

    def run(table: pa.Table) -> pa.Table:
        cols = _columns(table, 1)
        doc = np.concatenate([A.unpack_rising(x) for x in cols["ids"]])
        entry = A.from_six_bytes(b"".join(cols["a"]))
        order = np.lexsort((doc, entry))
        first = np.ones(len(order), bool)
        first[1:] = np.diff(entry[order]) != 0
        doc = doc[order]
        hub = doc[first][np.cumsum(first) - 1]
        doc, hub = doc[doc != hub], hub[doc != hub]
        return pa.Table.from_batches([_table(_pair_rows(doc, hub, n))])

    return A.group(run)


def _pair_rows(doc, hub, n: int):
    bucket = deal(doc, n)
    order = np.lexsort((hub, doc, bucket))
    doc, hub, bucket = doc[order], hub[order], bucket[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (np.diff(doc) != 0) | (np.diff(hub) != 0)
    doc, hub, bucket = doc[fresh], hub[fresh], bucket[fresh]
    return [(1, b, A.pack_rising(doc[i:j]), A.pack(hub[i:j]), b"", b"") for b, i, j in runs(bucket)]


def _unique_pairs(table: pa.Table) -> pa.Table:
    cols = _columns(table, 1)
    pairs = np.stack([np.concatenate([A.unpack_rising(x) for x in cols["ids"]]), np.concatenate([A.unpack(x, np.int64) for x in cols["a"]])])
    pairs = np.unique(pairs, axis=1)
    return pa.table({"id": pa.array(pairs[0]), "hub": pa.array(pairs[1])})


def _verifier(percent: int):
    """Links between the documents asked about and the members of one block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            ids, sizes = right.column("member").to_numpy(), right.column("n").to_numpy().astype(np.int64)
            code = [np.frombuffer(c, np.uint64) for c in right.column("codes").to_pylist()]
            owner = np.repeat(np.arange(len(ids)), [len(c) for c in code])
            code = np.concatenate(code)
            order = np.argsort(code, kind="stable")
            code, owner = code[order], owner[order]
            for x, n, c in zip(left.column("id").to_pylist(), left.column("n").to_pylist(), left.column("codes").to_pylist()):
                mine = np.frombuffer(c, np.uint64)
                lo, hi = np.searchsorted(code, mine), np.searchsorted(code, mine, side="right")
                hits = np.repeat(lo, hi - lo) + A.ranges_of(hi - lo)
                both = np.bincount(owner[hits], minlength=len(ids))
                linked = ids[100 * both >= percent * (n + sizes - both)]
                found += [(x, int(y)) for y in linked if y != x]
        src, dst = zip(*found) if found else ((), ())
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return A.cogroup(run)


def _verify(asked: DataFrame, members: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """``(src, dst)`` links for ``asked(id, block)`` against ``members(block, member)``."""
    sets = live.select("id", "n", "codes")
    left = asked.join(sets, "id").select(F.col("block").alias("asked"), "id", "n", "codes")
    right = members.join(sets.withColumnRenamed("id", "member"), "member").select(F.col("block").alias("held"), "member", "n", "codes")
    return left.groupBy("asked").cogroup(right.groupBy("held")).applyInArrow(_verifier(percent), "src long, dst long")


def _possible(a: str, b: str, percent: int):
    """Whether sizes and numbers of shared shingles leave room for a link."""
    most = F.least(F.col(f"{a}.shared"), F.col(f"{b}.shared"))
    return F.lit(100 + percent) * most >= F.lit(percent) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _links(live: DataFrame, percent: int, frequent: int, block: int, n: int) -> DataFrame:
    """``(src, dst)``: links that connect what the join connects."""
    index = live.select("id", "n", "codes", "tiers").mapInArrow(_indexer(n, percent, frequent), PACKED)
    packed = index.groupBy("bucket").applyInArrow(_hubs(n), PACKED)
    pairs = cut_lineage(packed.groupBy("bucket").applyInArrow(A.group(_unique_pairs), "id long, hub long"))
    facts = live.select("id", "n", "shared")
    a = facts.alias("a")
    b = facts.withColumnRenamed("id", "hub").alias("b")
    able = pairs.join(a, "id").join(b, "hub").where(_possible("a", "b", percent)).select("id", "hub")
    # Round 1: the smallest hub of each document.
    nearest = able.groupBy("id").agg(F.min("hub").alias("hub"))

    def ask(wanted: DataFrame) -> DataFrame:
        """Compare documents with their hubs; the many documents of a hot hub are dealt over several blocks."""
        size = wanted.groupBy("hub").agg(F.count("*").alias("many"))
        part = F.pmod(F.xxhash64("id"), F.ceil(F.col("many") / block).cast("long"))
        dealt = wanted.join(size, "hub").select("id", "hub", F.xxhash64("hub", part).alias("block"))
        return _verify(dealt.select("id", "block"), dealt.select("block", F.col("hub").alias("member")).distinct(), live, percent)

    one = cut_lineage(ask(nearest))
    label = one.select(F.col("src").alias("node"), F.col("dst").alias("label"))
    # Round 2: other hubs, where the first ones do not show that they are connected already.
    mine = label.select(F.col("node").alias("id"), F.col("label").alias("mine"))
    theirs = label.select(F.col("node").alias("hub"), F.col("label").alias("theirs"))
    apart = F.coalesce("mine", "id") != F.coalesce("theirs", "hub")
    open_ = able.join(nearest, ["id", "hub"], "left_anti").join(mine, "id", "left").join(theirs, "hub", "left").where(apart)
    two = cut_lineage(one.union(ask(open_.select("id", "hub"))))
    # Round 3: a document apart from a hub meets the hub's members.
    part = cut_lineage(connected_components(live.select(F.col("id").alias("node")), two))
    of = part.select(F.col("node").alias("id"), F.col("component").alias("mine"))
    hub_of = part.select(F.col("node").alias("hub"), F.col("component").alias("theirs"))
    all_ = pairs.join(of, "id").join(hub_of, "hub")
    lost = cut_lineage(all_.where("mine <> theirs").select("id", "hub", "mine"))
    crowd = pairs.join(lost.select("hub").distinct(), "hub", "left_semi").join(of, "id").join(facts, "id")
    crowd = crowd.select("hub", F.col("id").alias("member"), F.col("mine").alias("other"), F.col("n"), "shared")
    # Blocks hold members of one size level, so that a document skips the blocks of other sizes.
    level = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9)
    dealt = F.pmod(F.xxhash64("member"), F.ceil(F.col("many") / block).cast("long"))
    sizes = crowd.withColumn("level", level)
    many = sizes.groupBy("hub", "level").agg(F.count("*").alias("many"))
    placed = cut_lineage(sizes.join(many, ["hub", "level"]).withColumn("block", F.xxhash64("hub", "level", dealt)))
    blocks = placed.groupBy("hub", "level", "block").agg(
        F.min("other").alias("low"), F.max("other").alias("high"), F.max("shared").alias("most"), F.min("n").alias("least")
    )
    mine = lost.join(facts, "id").withColumn("own", level)
    fits = (F.abs(F.col("level") - F.col("own")) <= 1) & ((F.col("low") != F.col("mine")) | (F.col("high") != F.col("mine")))
    room = F.lit(100 + percent) * F.least("shared", "most") >= F.lit(percent) * (F.col("n") + F.col("least"))
    asked = mine.join(blocks, "hub").where(fits & room).select("id", "block").distinct()
    three = _verify(asked, placed.select("block", "member"), live, percent)
    return two.union(three)


def components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``."""
    known, shift = numbered(docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    row_id = lambda c: F.shiftright(c, shift) if shift else F.col(c)
    out = components_of_rows(known, size, percent, frequent, block).select(
        row_id("uid").alias("doc_id"), "n_shingles", row_id("component").alias("component_id")
    )
    return out.union(_unnamed(docs, size))


def components_of_rows(known: DataFrame, size: int = SIZE, percent: int = PERCENT, frequent: int = FREQUENT, block: int = BLOCK) -> DataFrame:
    """``uid, n_shingles, component`` (its smallest uid) for each row of ``known(uid, text)`` as :func:`numbered` gives it."""
    spark = known.sparkSession
    A.small_batches(spark)
    n = A.buckets(spark)
    marked = known.select("uid", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_marker(n, size), PACKED)
    counted = marked.groupBy("bucket").applyInArrow(_counter(n), PACKED)
    gathered = cut_lineage(counted.groupBy("bucket").applyInArrow(_gather(percent), LIVE))
    live = gathered.where("codes is not null")
    links = cut_lineage(_links(live, percent, frequent, block, n))
    part = connected_components(live.select(F.col("id").alias("node")), links)
    info = gathered.where("codes is null").select("id", F.col("n").cast("long").alias("n_shingles"), "first")
    joined = info.join(part.select(F.col("node").alias("first"), "component"), "first", "left")
    return joined.select(F.col("id").alias("uid"), "n_shingles", F.coalesce("component", "first").alias("component"))


def _unnamed(docs: DataFrame, size: int) -> DataFrame:
    """Rows without an id: their set is counted, but they have no component."""

    def run(batches):
        for batch in batches:
            data, offsets = A.utf8(batch.column(0))
            row, _ = shingles(data, offsets, size)
            n = len(offsets) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.array(np.bincount(row, minlength=n), pa.int64()), pa.nulls(n, pa.int64())],
                names=["doc_id", "n_shingles", "component_id"],
            )

    return docs.where("doc_id is null").select("text").mapInArrow(run, "doc_id long, n_shingles long, component_id long")
