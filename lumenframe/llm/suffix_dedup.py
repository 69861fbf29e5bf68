"""Removal of passages that repeat across documents, by hash-compared suffix sorting.

A passage is any string of ``length`` bytes (50). Byte i of a document goes when it lies in such a string that
also starts in a document with a smaller id; overlaps count and strings are judged on the input.

How the suffixes of a whole corpus meet without sending them all:

1. *Anchors.* In every window of ``length`` bytes the ``gram`` bytes with the smallest hash are its anchor (winnowing):
   equal windows have equal anchors, and about one position in fourteen is one. Each anchor goes with the hash of its
   segment, the stretch of all windows that hold it. Segments equal within a batch are combined before the shuffle.
2. *Equal segments.* Anchors meet by hash. A segment that a smaller document has too is settled: all of its windows go.
   Equality of segments means equality of two independent polynomial hashes (96 bits, and the bucket number).
3. *Suffix sort.* Where one anchor has several segments, their bytes are sent and their suffixes sorted: a mergesort
   whose comparisons find the common extension of two suffixes by binary search over prefix polynomial hashes
   (a logarithmic number of steps). Equal neighbours are verified on bytes; a collision falls back to sorting bytes.
   An anchor with very many segments is cut into single windows, which spread by their own hash after the equal
   ones of a task were combined, so no anchor gathers in one task.

Defined cases: null text is empty; documents under ``length`` bytes lose nothing; equal documents: the smallest id
stays, the others go whole (if long enough); rows that share an id are never compared with each other; a null id
removes nothing and loses nothing. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import arrays as A
from lumenframe.llm.rows import deal, deal_column, numbered, runs
from lumenframe.session import cut_lineage

LENGTH = 50
GRAM = 24
#: Bytes of text whose hashes are in memory at a time.
SLICE = 1 << 19
#: Segments of one anchor beyond which its windows are dealt out by their own hash.
CROWD = 256
#: Bytes of a suffix that are compared as one number before its hashes.
HEAD = 8
#: Suffixes sorted at a time.
SORT_ENTRIES = 300_000
POSITION_BITS = np.uint64(26)

PACKED = "kind int, bucket int, ids binary, a binary, b binary, c binary, d binary, e binary"
FIELDS = ("ids", "a", "b", "c", "d", "e")


def anchors(data, offsets, length: int = LENGTH, gram: int = GRAM):
    """``(position, row, left, right, anchor hash, segment hash)`` of every anchor of a slice of rows.

    ``left`` and ``right`` are the bytes of the segment before and after the anchor's first byte.
    """
    n, w = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    grams = A.mix(A.PrefixHash(data, A.BASE_A).windows(gram))
    mask = np.uint64((1 << int(POSITION_BITS)) - 1)
    ranked = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64)  # ties go to the leftmost
    low, reach = ranked, 1
    while reach * 2 <= w:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    count = n - length + 1
    low = np.minimum(low[:count], low[w - reach : w - reach + count])
    valid = np.zeros(n + 1, np.int8)
    size = np.diff(offsets)
    long = size >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - length + 1, -1)
    chosen = np.zeros(n, bool)
    chosen[(low[np.cumsum(valid[:count]) > 0] & mask).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    row = np.searchsorted(offsets, at, side="right") - 1
    start = np.maximum(offsets[row], at - (w - 1))
    end = np.minimum(offsets[row + 1], at + length)
    segment = A.PrefixHash(data, A.BASE_B).ranges(start, end)
    segment = A.mix(segment + (at - start).astype(np.uint64) * np.uint64(1 << 32) + (end - at).astype(np.uint64))
    return at - offsets[row], row, at - start, end - at, grams[at], segment


def _table(rows) -> pa.RecordBatch:
    kind, bucket, *blobs = zip(*rows) if rows else ((),) * 8
    arrays = [pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "bucket", *FIELDS])


def _flag_rows(ids, start, stop, m: int):
    """Packed rows of flagged window starts ``[start, stop)``, dealt out by document."""
    bucket = deal(ids, m)
    order = np.lexsort((start, ids, bucket))
    bucket, ids, start, stop = bucket[order], ids[order], start[order], stop[order]
    return [
        (0, b, A.pack_rising(ids[i:j]), A.pack(start[i:j].astype(np.uint32)), A.pack((stop - start)[i:j].astype(np.uint32)), b"", b"", b"")
        for b, i, j in runs(bucket)
    ]


def _merge(ids, start, stop):
    """Unions of overlapping or touching ranges of the same document."""
    if not len(ids):
        return ids, start, stop
    order = np.lexsort((start, ids))
    ids, start, stop = ids[order], start[order], stop[order]
    far = int(stop.max()) + 1
    rank = np.cumsum(np.concatenate([[0], np.diff(ids) != 0])) * far
    reach = np.maximum.accumulate(stop + rank)
    fresh = np.concatenate([[True], (start + rank)[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(ids) - 1]])
    return ids[fresh], start[fresh], (reach - rank)[last]


def _marker(n: int, m: int, shift: int, length: int, gram: int):
    """Map side: anchors of a batch, equal segments combined, packed by bucket of the anchor."""

    def one(batch):
        ids = batch.column(0).to_numpy()
        data, offsets = A.utf8(batch.column(1))
        parts = []
        for lo, hi in A.slices(offsets, SLICE):
            base = offsets[lo]
            pos, row, left, right, anchor, segment = anchors(data[base : offsets[hi]], offsets[lo : hi + 1] - base, length, gram)
            parts.append((ids[row + lo], pos, left.astype(np.uint8), right.astype(np.uint8), anchor, segment))
        if not parts:
            return _table([])
        doc, pos, left, right, anchor, segment = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((doc, segment, anchor))
        first = np.ones(len(order), bool)
        first[1:] = (np.diff(anchor[order]) != 0) | (np.diff(segment[order]) != 0)
        group = np.cumsum(first) - 1
        least = (doc[order][first] >> shift)[group]
        settled = order[(doc[order] >> shift) > least]
        kept = order[(doc[order] >> shift) == least]
        rows = []
        if len(settled):
            start = pos[settled] - left[settled]
            rows += _flag_rows(*_merge(doc[settled], start, pos[settled] + right[settled] - length + 1), m)
        bucket = ((anchor[kept] >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
        kept = kept[np.lexsort((pos[kept], doc[kept], bucket))]
        bucket = ((anchor[kept] >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
        for b, i, j in runs(bucket):
            k = kept[i:j]
            rows.append((1, b, A.pack_rising(doc[k]), A.pack(pos[k].astype(np.uint32)), A.pack(left[k]), A.pack(right[k]),
                         A.six_bytes(anchor[k]), A.six_bytes(segment[k])))
        return _table(rows)

    return A.each(one)


def _shared(values: np.ndarray) -> np.ndarray:
    """Whether each value occurs more than once."""
    ordered = np.sort(values)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(values), bool)
    return twice[np.minimum(np.searchsorted(twice, values), len(twice) - 1)] == values


def _settler(m: int, shift: int, length: int, crowd: int):
    """Reduce side of a bucket of anchors: settle equal segments, pass on those that need their bytes."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        done = table.filter(pa.array(kind == 0))
        rows = [(0, b, *blobs) for b, *blobs in zip(done.column("bucket").to_pylist(), *(done.column(f).to_pylist() for f in FIELDS))]
        cols = {f: table.filter(pa.array(kind == 1)).column(f).to_pylist() for f in FIELDS}
        if cols["ids"]:
            doc = np.concatenate([A.unpack_rising(x) for x in cols["ids"]])
            pos = np.concatenate([A.unpack(x, np.uint32) for x in cols["a"]])
            left = np.concatenate([A.unpack(x, np.uint8) for x in cols["b"]])
            right = np.concatenate([A.unpack(x, np.uint8) for x in cols["c"]])
            anchor = A.from_six_bytes(b"".join(cols["d"]))
            segment = A.from_six_bytes(b"".join(cols["e"]))
            cols.clear()
            # Most anchors occur once: only the others go on, as whole numbers.
            more = np.flatnonzero(_shared(anchor))
            doc, anchor, segment = doc[more], anchor[more], segment[more]
            pos, left, right = (v[more].astype(np.int64) for v in (pos, left, right))
            order = np.argsort(anchor, kind="stable")
            same = np.concatenate([[0], np.cumsum(np.diff(anchor[order]) != 0)]) if len(order) else order
            order = order[np.lexsort((doc[order], segment[order], same))]
            if len(order):
                same = np.concatenate([[0], np.cumsum(np.diff(anchor[order]) != 0)])
                first = np.ones(len(order), bool)
                first[1:] = (np.diff(same) != 0) | (np.diff(segment[order]) != 0)
                level = doc[order] >> shift
                least = level[first][np.cumsum(first) - 1]
                hit = order[level > least]
                rows += _flag_rows(*_merge(doc[hit], (pos - left)[hit], (pos + right)[hit] - length + 1), m)
                open_ = level == least
                variants = np.bincount(same, weights=first)[same]
                edge = np.flatnonzero(np.concatenate([[True], np.diff(same) != 0]))
                low, high = np.minimum.reduceat(level, edge)[same], np.maximum.reduceat(level, edge)[same]
                check = open_ & (variants > 1) & (low < high)
                k, crowded = order[check], variants[check] > crowd
                bucket = deal(doc[k], m)
                by = np.lexsort((pos[k], doc[k], bucket))
                k, crowded, bucket = k[by], crowded[by], bucket[by]
                for b, i, j in runs(bucket):
                    x = k[i:j]
                    rows.append((1, b, A.pack_rising(doc[x]), A.pack(pos[x].astype(np.uint32)), A.pack(left[x].astype(np.uint8)),
                                 A.pack(right[x].astype(np.uint8)), A.pack(anchor[x]), A.pack(crowded[i:j])))
        return pa.Table.from_batches([_table(rows)])

    return A.group(run)


class _Documents:
    """Texts of one group of documents, with the settled window starts and the open segments of each."""

    def __init__(self, texts: pa.Table, found: pa.Table, length: int):
        self.length = length
        uid = texts.column("uid").to_numpy()
        self.uid, first, self.of = np.unique(uid, return_index=True, return_inverse=True)
        self.data, self.offsets = A.utf8(texts.column("text").take(pa.array(first)) if len(uid) else texts.column("text"))
        kinds, columns = found.column("kind").to_numpy(), {f: found.column(f).to_pylist() for f in FIELDS}
        flags = [[np.zeros(0, np.int64)] * 3] + [
            (A.unpack_rising(columns["ids"][k]), A.unpack(columns["a"][k], np.uint32), A.unpack(columns["b"][k], np.uint32))
            for k in np.flatnonzero(kinds == 0)
        ]
        self.flags = self._by_row(flags)
        checks = [[np.zeros(0, np.int64)] * 6] + [
            (A.unpack_rising(columns["ids"][k]), *(A.unpack(columns[f][k], t) for f, t in zip("abcde", (np.uint32, np.uint8, np.uint8, np.uint64, np.bool_))))
            for k in np.flatnonzero(kinds == 1)
        ]
        self.checks = self._by_row(checks)

    def _by_row(self, parts):
        """Columns of all parts, ordered by the row of the document in their first column."""
        first, *rest = (np.concatenate(x) for x in zip(*parts))
        row = np.searchsorted(self.uid, first)
        order = np.argsort(row, kind="stable")
        return [row[order], *(x[order] for x in rest)]

    def parts(self):
        """A bounded number of bytes at a time: ``(first row, data, offsets, delta, checks)``.

        The running sum of ``delta`` is positive where the window that starts at a byte is settled.
        """
        for lo, hi in A.slices(self.offsets, SLICE):
            base = self.offsets[lo]
            data, offsets = self.data[base : self.offsets[hi]], self.offsets[lo : hi + 1] - base
            delta = np.zeros(len(data) + 1, np.int32)
            i, j = np.searchsorted(self.flags[0], (lo, hi))
            row, start, size = (x[i:j] for x in self.flags)
            at = offsets[row - lo] + start.astype(np.int64)
            np.add.at(delta, at, 1)
            np.add.at(delta, at + size.astype(np.int64), -1)
            i, j = np.searchsorted(self.checks[0], (lo, hi))
            yield lo, data, offsets, delta, [x[i:j] for x in self.checks]


def _cutter(n: int, m: int, shift: int, length: int):
    """Cut the segments that need comparing out of the texts; crowded ones into windows."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        docs = _Documents(texts, found, length)
        keys, ids, starts, lefts, pieces, flagged_rows = [], [], [], [], [], []
        for first, data, offsets, delta, (row, pos, left, right, anchor, crowded) in docs.parts():
            if not len(row):
                continue
            doc, base = docs.uid[row], offsets[row - first]
            crowded = crowded.astype(bool)
            at = base + pos.astype(np.int64)
            flagged = np.cumsum(delta[:-1]) > 0
            settled = np.concatenate([[0], np.cumsum(flagged)])
            lo, hi = at - left.astype(np.int64), at + right.astype(np.int64) - length + 1  # window starts
            live = settled[hi] - settled[lo] < hi - lo
            doc, base, at, lo, hi, anchor, crowded = (x[live] for x in (doc, base, at, lo, hi, anchor, crowded))
            if not len(doc):
                continue
            free = np.flatnonzero(~flagged)
            lo = free[np.searchsorted(free, lo)]
            hi = free[np.searchsorted(free, hi) - 1] + 1
            raw = data.tobytes()
            plain = np.flatnonzero(~crowded)
            keys.append(anchor[plain].astype(np.int64))
            ids.append(doc[plain])
            starts.append((lo - base)[plain])
            lefts.append((at - lo)[plain])
            pieces += [raw[a : b + length - 1] for a, b in zip(lo[plain].tolist(), hi[plain].tolist())]
            hot = np.flatnonzero(crowded)
            if len(hot):
                size = (hi - lo)[hot]
                w = np.repeat(lo[hot], size) + A.ranges_of(size)
                wdoc, wbase = np.repeat(doc[hot], size), np.repeat(base[hot], size)
                w, pick = np.unique(w, return_index=True)
                wdoc, wbase = wdoc[pick], wbase[pick]
                keep = ~flagged[w]
                w, wdoc, wbase = w[keep], wdoc[keep], wbase[keep]
                h = A.mix(A.PrefixHash(data, A.BASE_B).ranges(w, w + length))
                order = np.lexsort((wdoc, h))
                fresh = np.ones(len(order), bool)
                fresh[1:] = np.diff(h[order]) != 0
                head = order[fresh][np.cumsum(fresh) - 1]
                byte = np.arange(length)
                same = (data[w[order][:, None] + byte] == data[w[head][:, None] + byte]).all(axis=1)
                later = ((wdoc[order] >> shift) > (wdoc[head] >> shift)) & same
                x = order[later]
                flagged_rows.append((wdoc[x], (w - wbase)[x]))
                x = order[~later]
                keys.append((h[x] & np.uint64((1 << 48) - 1)).astype(np.int64))
                ids.append(wdoc[x])
                starts.append((w - wbase)[x])
                lefts.append(np.zeros(len(x), np.int64))
                pieces += [raw[a : a + length] for a in w[x].tolist()]
        rows = []
        if flagged_rows:
            doc, start = (np.concatenate(x) for x in zip(*flagged_rows))
            rows += _flag_rows(*_merge(doc, start, start + 1), m)
        if pieces:
            key, doc, start, left = (np.concatenate(x) for x in (keys, ids, starts, lefts))
            bucket = key % n
            order = np.lexsort((doc, bucket))
            for b, i, j in runs(bucket[order]):
                x = order[i:j]
                mine = [pieces[k] for k in x.tolist()]
                rows.append((1, b, A.pack_rising(doc[x]), A.pack(key[x]), A.pack(start[x].astype(np.uint32)), A.pack(left[x].astype(np.uint8)),
                             A.pack(np.array([len(p) for p in mine], np.uint32)), A.pack(np.frombuffer(b"".join(mine), np.uint8))))
        return pa.Table.from_batches([_table(rows)])

    return A.cogroup(run)


def common_extension(hashes: A.PrefixHash, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Length of the longest common prefix of suffixes x and y, up to ``most``: binary search over prefix hashes."""
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), most, np.int64)
    while True:
        wide = lo < hi
        if not wide.any():
            return lo
        mid = (lo + hi + 1) >> 1
        same = hashes.ranges(x, x + mid) == hashes.ranges(y, y + mid)
        lo = np.where(same & wide, mid, lo)
        hi = np.where(same | ~wide, hi, mid - 1)


def sort_suffixes(data: np.ndarray, suffix: np.ndarray, group: np.ndarray, length: int, hashes: A.PrefixHash | None = None) -> np.ndarray:
    """Order of suffixes by group and then by their first ``length`` bytes: a mergesort of all groups at once.

    ``group`` rises. Runs of a group double in each round; a suffix finds its place in the sister run by binary
    search. A comparison looks at the first ``HEAD`` bytes as one number; where they are equal, it finds the common extension of two
    suffixes by hashes and then looks at one byte.
    """
    hashes = hashes or A.PrefixHash(data, A.BASE_A)
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    head = np.zeros(len(suffix), np.uint64)
    for k in range(min(HEAD, length)):
        head = (head << np.uint64(8)) | data[suffix + k]
    order = np.arange(len(suffix))
    begin = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(group)))
    start_of, size_of = np.repeat(begin, size), np.repeat(size, size)
    width = 1
    while len(size) and width < size.max():
        act = np.flatnonzero(size_of > width)
        inner = act - start_of[act]
        run = inner // width
        other = start_of[act] + (run ^ 1) * width
        end = np.minimum(other + width, start_of[act] + size_of[act])
        paired = other < start_of[act] + size_of[act]
        act, inner, run, other, end = (v[paired] for v in (act, inner, run, other, end))
        lo, hi = other.copy(), end.copy()
        mine, mine_head = suffix[order[act]], head[order[act]]
        right = (run & 1) == 1
        while True:
            wide = np.flatnonzero(lo < hi)
            if not len(wide):
                break
            mid = (lo[wide] + hi[wide]) >> 1
            head_x, head_y = mine_head[wide], head[order[mid]]
            smaller = head_y < head_x
            open_ = np.flatnonzero(head_x == head_y)
            x, y = mine[wide[open_]], suffix[order[mid[open_]]]
            same = common_extension(hashes, x, y, length)
            tie = same == length
            smaller[open_] = np.where(tie, right[wide[open_]], padded[np.where(tie, 0, y + same)] < padded[np.where(tie, 0, x + same)])
            lo[wide] = np.where(smaller, mid + 1, lo[wide])
            hi[wide] = np.where(smaller, hi[wide], mid)
        pair = start_of[act] + (run >> 1) * (2 * width)
        place = pair + (inner - run * width) + (lo - other)
        order[place] = order[act].copy()
        width *= 2
    return order


def repeated(data, suffix, group, level, length: int) -> np.ndarray:
    """Which suffixes have an equal one (in the same group, over ``length`` bytes) of a smaller level."""
    hashes = A.PrefixHash(data, A.BASE_A)
    order = sort_suffixes(data, suffix, group, length, hashes)
    flags = np.zeros(len(suffix), bool)
    if len(order) < 2:
        return flags
    byte = np.arange(length)
    a, b = suffix[order[:-1]], suffix[order[1:]]
    equal = (group[order[:-1]] == group[order[1:]]) & (hashes.ranges(a, a + length) == hashes.ranges(b, b + length))
    k = np.flatnonzero(equal)
    if not (data[a[k][:, None] + byte] == data[b[k][:, None] + byte]).all():
        # A collision: sort the bytes themselves.
        texts = np.ascontiguousarray(data[suffix[:, None] + byte]).view(f"V{length}").ravel()
        ranks = np.unique(texts, return_inverse=True)[1]
        order = np.lexsort((ranks, group))
        equal = (np.diff(group[order]) == 0) & (np.diff(ranks[order]) == 0)
    run = np.concatenate([[0], np.cumsum(~equal)])
    edge = np.flatnonzero(np.concatenate([[True], ~equal]))
    flags[order] = level[order] > np.minimum.reduceat(level[order], edge)[run]
    return flags


def _sorter(m: int, shift: int, length: int, entries: int):
    """Suffix-sort the segments of a bucket and flag windows that a smaller document has."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        done = table.filter(pa.array(kind == 0))
        rows = [(0, b, *blobs) for b, *blobs in zip(done.column("bucket").to_pylist(), *(done.column(f).to_pylist() for f in FIELDS))]
        cols = {f: table.filter(pa.array(kind == 1)).column(f).to_pylist() for f in FIELDS}
        if cols["ids"]:
            doc = np.concatenate([A.unpack_rising(x) for x in cols["ids"]])
            key = np.concatenate([A.unpack(x, np.int64) for x in cols["a"]])
            start = np.concatenate([A.unpack(x, np.uint32) for x in cols["b"]]).astype(np.int64)
            left = np.concatenate([A.unpack(x, np.uint8) for x in cols["c"]]).astype(np.int64)
            size = np.concatenate([A.unpack(x, np.uint32) for x in cols["d"]]).astype(np.int64)
            data = np.concatenate([A.unpack(x, np.uint8) for x in cols["e"]])
            base = np.cumsum(size) - size
            order = np.argsort(key, kind="stable")
            windows = (size - length + 1)[order]
            fresh = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) != 0]))
            total = np.append(np.cumsum(windows) - windows, windows.sum())
            at, found = 0, []
            while at < len(order):  # whole keys, a bounded number of suffixes at a time
                nxt = fresh[np.searchsorted(fresh, at, side="right") :]
                fit = nxt[total[nxt] <= total[at] + entries]
                stop = int(fit[-1]) if len(fit) else (int(nxt[0]) if len(nxt) else len(order))
                if total[-1] <= total[at] + entries:
                    stop = len(order)
                x, w = order[at:stop], windows[at:stop]
                at = stop
                step = A.ranges_of(w)
                owner = np.repeat(x, w)
                by = np.lexsort((left[owner] - step, key[owner]))
                owner, step = owner[by], step[by]
                change = (np.diff(key[owner]) != 0) | (np.diff(left[owner] - step) != 0)
                group = np.concatenate([[0], np.cumsum(change)])
                # The bytes of these segments alone, side by side.
                mine = data[np.repeat(base[x], size[x]) + A.ranges_of(size[x])]
                at_x = np.zeros(len(base), np.int64)
                at_x[x] = np.cumsum(size[x]) - size[x]
                hit = repeated(mine, at_x[owner] + step, group, doc[owner] >> shift, length)
                found.append((doc[owner[hit]], start[owner[hit]] + step[hit]))
            ids, first = (np.concatenate(v) for v in zip(*found))
            rows += _flag_rows(*_merge(ids, first, first + 1), m)
        return pa.Table.from_batches([_table(rows)])

    return A.group(run)


RESULT = "uid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _finisher(length: int):
    """Remove what the settled windows of each document cover."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        docs = _Documents(texts, found, length)
        n = len(docs.uid)
        size, removed, runs_, kept = np.diff(docs.offsets), np.zeros(n, np.int64), np.zeros(n, np.int64), []
        for first, data, offsets, delta, _ in docs.parts():
            cover = np.zeros(len(data) + 1, np.int32)
            start = np.flatnonzero(np.cumsum(delta[:-1]) > 0)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + length, -1)
            gone = np.cumsum(cover[:-1]) > 0
            sums = np.concatenate([[0], np.cumsum(gone)])
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            head = offsets[:-1][np.diff(offsets) > 0]
            opens[head] = gone[head]  # a run never continues from the document before
            spans = np.concatenate([[0], np.cumsum(opens)])
            rows = slice(first, first + len(offsets) - 1)
            removed[rows], runs_[rows] = np.diff(sums[offsets]), np.diff(spans[offsets])
            left = data[~gone].tobytes()
            edge = (offsets - sums[offsets]).tolist()
            kept += [left[a:b] for a, b in zip(edge[:-1], edge[1:])]
        of = docs.of
        return pa.table({
            "uid": texts.column("uid"), "doc_id": texts.column("doc_id"), "n_bytes": pa.array(size[of]),
            "n_removed": pa.array(removed[of]), "n_spans": pa.array(runs_[of]),
            "kept": pa.array([kept[i] for i in of.tolist()], pa.binary()),
        })

    return A.cogroup(run)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, entries: int = SORT_ENTRIES,
                   numbers: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) for each row of ``docs(doc_id, text)``.

    With ``numbers`` also the ``uid`` that :func:`numbered` gives the row, null where the id is.
    """
    spark = docs.sparkSession
    A.small_batches(spark)
    n = m = A.buckets(spark)  # of anchors, and of documents
    known = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known, shift = numbered(known)
    marked = known.select("uid", "text").mapInArrow(_marker(n, m, shift, length, gram), PACKED)
    found = cut_lineage(marked.groupBy("bucket").applyInArrow(_settler(m, shift, length, crowd), PACKED))
    dealt = known.select(deal_column(F.col("uid"), m).alias("bucket"), "uid", "doc_id", "text").repartition(F.col("bucket"))
    segments = dealt.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(_cutter(n, m, shift, length), PACKED)
    sorted_ = segments.groupBy("bucket").applyInArrow(_sorter(m, shift, length, entries), PACKED)
    flags = found.where("kind = 0").union(sorted_)
    done = dealt.groupBy("bucket").cogroup(flags.groupBy("bucket")).applyInArrow(_finisher(length), RESULT)
    unnamed = docs.where("doc_id is null").select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("kept"),
    )
    if numbers:
        return done.select(*unnamed.columns, "uid").union(unnamed.withColumn("uid", F.lit(None).cast("long")))
    return done.drop("uid").union(unnamed)


def text_of(removed: DataFrame) -> DataFrame:
    """``doc_id, n_removed, text[, uid]``: what remains, as text; bytes of a character that was cut apart go too."""
    more = ["uid"] if "uid" in removed.columns else []

    def run(batches):
        for batch in batches:
            text = [b.decode("utf-8", "ignore") for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), *batch.columns[3:]], names=["doc_id", "n_removed", "text", *more])

    return removed.select("doc_id", "n_removed", "kept", *more).mapInArrow(run, "doc_id long, n_removed long, text string" + ", uid long" * len(more))
