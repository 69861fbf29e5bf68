"""Passage removal and the Jaccard join against brute force, on tables and on odd rows."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import jaccard, queries
from lumenframe.llm.jaccard import components, signatures
from lumenframe.llm.suffix_dedup import remove_repeats, repeated, sort_suffixes, text_of


def removed(df, **options):
    rows = remove_repeats(df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    return sorted(tuple(r) for r in rows)


def joined(df, **options):
    return sorted(tuple(r) for r in components(df, **options).collect())


def test_tables(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op1_suffix_dedup(spark, folder)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == brute.remove_repeats(rows)
    got = queries.op3_ngram_jaccard(spark, folder)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(tuple(r) for r in got.collect()) == brute.components(rows)


def test_odd_rows(make, odd_rows):
    df = make(odd_rows)
    assert removed(df) == brute.remove_repeats(odd_rows)
    assert joined(df) == brute.components(odd_rows)


def test_empty_and_null_ids(make):
    assert removed(make([])) == [] and joined(make([])) == []
    text = "one passage of words that is certainly longer than fifty bytes in all"
    df = make([(None, text), (None, None), (3, text)])
    assert sorted((r[0] or 0, r[1], r[2]) for r in remove_repeats(df).select("doc_id", "n_bytes", "n_removed").collect()) == [
        (0, 0, 0), (0, len(text), 0), (3, len(text), 0)]
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in components(df).collect()} == {(None, 9, None), (None, 0, None), (3, 9, 3)}


@pytest.mark.parametrize("crowd, entries", [(256, 300_000), (1, 50)])
def test_crowded_anchors(make, crowd, entries):
    """A passage that many documents continue differently, once by anchors and once by single windows."""
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    passage = word(90)
    rows = [(i, word(rng.randint(0, 40)) + passage[rng.randint(0, 40) :] + word(rng.randint(0, 60))) for i in range(60)]
    rows += [(100 + i, rows[i][1][10:80] + rows[59 - i][1][5:90]) for i in range(20)]
    assert removed(make(rows), crowd=crowd, entries=entries) == brute.remove_repeats(rows)


def test_suffix_sort():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    suffix = rng.integers(0, 3900, 1500)
    group = np.sort(rng.integers(0, 7, 1500))
    order = sort_suffixes(data, suffix, group, 50)
    keys = [(g, data[s : s + 50].tobytes()) for g, s in zip(group[order], suffix[order])]
    assert keys == sorted(keys)
    level = rng.integers(0, 30, 1500)
    least = {}
    for s, g, v in zip(suffix, group, level):
        k = (g, data[s : s + 50].tobytes())
        least[k] = min(v, least.get(k, v))
    want = [v > least[g, data[s : s + 50].tobytes()] for s, g, v in zip(suffix, group, level)]
    assert repeated(data, suffix, group, level, 50).tolist() == want


def test_text_drops_cut_characters(make):
    shared = "ö" * 40
    rows = {r.doc_id: r.text for r in text_of(remove_repeats(make([(1, "a" + shared), (2, "b" + shared + "end")]))).collect()}
    assert rows == {1: "a" + shared, 2: "bend"}


@pytest.mark.parametrize("frequent", [2, 64])
def test_near_copies(make, frequent):
    """A large group of near copies and a passage that many other documents hold, with and without pair entries."""
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    for i in range(60):
        rows.append((200 + i, " ".join(base[:20] + [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 40))])))
    rows += [(300 + i, rows[i][1]) for i in range(10)]
    assert joined(make(rows), frequent=frequent, block=16) == brute.components(rows)


@pytest.mark.parametrize("copies", [2, 10])
def test_repeated_rows_in_several_batches(spark, monkeypatch, copies):
    """Unlike documents with common boilerplate, each row repeated in several partitions, stay apart; near copies still link."""
    rng = random.Random(4)
    own = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    boilerplate, near = own(46), own(100)
    rows = [(i, f"{boilerplate} {own(58)}") for i in range(6)] + [(10, near), (11, near + " end")]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows * copies, copies), "doc_id long, text string")
    monkeypatch.setattr(jaccard, "numbered", lambda docs: (docs.withColumn("uid", F.col("doc_id")), 0))  # copies stay in their partitions
    assert joined(df) == brute.components(rows * copies)


def test_prefixes_share_an_entry():
    """Any two sets that link have an index entry in common."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(3, 200))
        codes = np.unique(rng.integers(1, 2**62, n).astype(np.uint64))
        tiers = (codes % np.uint64(120)).astype(np.uint8)
        drop = rng.random(len(codes)) < rng.random() * 0.2
        other, more = codes[~drop], np.unique(rng.integers(1, 2**62, int(drop.sum() * rng.random())).astype(np.uint64))
        other = np.unique(np.concatenate([other, more]))
        both = len(np.intersect1d(codes, other))
        if 100 * both < 75 * (len(codes) + len(other) - both):
            continue
        entries = []
        for c in (codes, other):
            t = (c % np.uint64(120)).astype(np.uint8)
            o = np.lexsort((c, t))
            entries.append(set(signatures(len(c), c[o], t[o], 75, 64).tolist()))
        assert entries[0] & entries[1]
    assert len(tiers)


def test_suffixes_with_equal_heads_are_sorted_by_hashes():
    """Groups of segments that share their middle: the order is that of the bytes, equal ones in the order they came."""
    rng = np.random.default_rng(9)
    pieces = []
    for _ in range(40):
        base = rng.integers(97, 100, 74).astype(np.uint8)
        for _ in range(int(rng.integers(1, 6))):
            other = base.copy()
            other[: rng.integers(0, 20)] = 120
            other[rng.integers(40, 74) :] = 121
            pieces.append(other)
    data = np.concatenate(pieces)
    suffix = np.concatenate([np.arange(25) + 74 * i for i in range(len(pieces))])
    group = np.repeat(np.arange(len(pieces)) // 4, 25)
    order = sort_suffixes(data, suffix, group, 50)
    text = [data[s : s + 50].tobytes() for s in suffix]
    assert order.tolist() == sorted(range(len(suffix)), key=lambda i: (group[i], text[i], i))
