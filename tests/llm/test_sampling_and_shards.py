"""Importance resampling, fill-in-the-middle frames and rendezvous shards against plain versions."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import arrays, fim, frames, queries, resampling, sharding

MANY = [(None, None), (None, "text of a row without an id"), (2**61 + 5, "large id"), (2**61 + 5, "large id, other text"), (-3, "one <P> mark")]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs(text, most):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def draw(docs, target, most=1, buckets=10_000, seed=2024, least=20, percent=10):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    found = [[place(f) for f in runs(t, most)] for _, t in docs]
    s, t = collections.Counter(b for f in found for b in f), collections.Counter(place(f) for x in target for f in runs(x, most))
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1.0) * (S + buckets)) / ((s[b] + 1.0) * (T + buckets)))) for b in s}
    rows = []
    for (d, _), f in zip(docs, found):
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = fit[: len(fit) * percent // 100]
    rest = fit[len(drawn) :] + [r for r in rows if r[1] < least]
    return sorted([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in rest], key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("most", [1, 3])
def test_draw_equals_brute_force(spark, make, odd_rows, most, monkeypatch):
    monkeypatch.setattr(resampling, "WINDOW", 700)  # of the driver; workers keep their own
    rng = np.random.default_rng(1)
    docs = [(k, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 60)) % 500)) for k in range(300)]
    docs += [(1000, " ".join(["Same WORDS again"] * 9))] * 40 + odd_rows + MANY
    target = ["w1 w2 w3 w2 w1 again", None, "", "日本語のテキスト"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resampling.resample(make(docs), bench, most=most, buckets=1000, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == draw(docs, target, most, 1000, percent=30)


def test_features_do_not_depend_on_windows(monkeypatch):
    texts = ["Aa bb, cc-dd " * 300, "", None, "x" * 3000 + " y", "日本語 " * 500, ",", "end"]
    data, offsets = arrays.utf8(pa.array(texts))
    whole = [resampling.buckets_of(data, offsets, most, 997) for most in (1, 4)]
    monkeypatch.setattr(resampling, "WINDOW", 50)
    for most, (row, code) in zip((1, 4), whole):
        got_row, got = resampling.buckets_of(data, offsets, most, 997)
        assert sorted(zip(row, code)) == sorted(zip(got_row, got))
        want = [(i, zlib.crc32(f.encode()) % 997) for i, t in enumerate(texts) for f in runs(t, most)]
        assert sorted(zip(row, code)) == sorted(want)


def test_rows_of_a_matrix_are_compared_by_bytes(monkeypatch):
    rng = np.random.default_rng(0)
    matrix = rng.integers(97, 100, (500, 11)).astype(np.uint8)
    monkeypatch.setattr(arrays, "mix", lambda x: x & np.uint64(3))  # nearly all hashes collide
    first, inverse = resampling.distinct_rows(matrix)
    assert (matrix[first][inverse] == matrix).all() and len(first) == len(np.unique(matrix, axis=0))
    assert resampling.column_crc(matrix).tolist() == [zlib.crc32(r.tobytes()) for r in matrix]


def test_draw_of_nothing(spark, make):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(make([]), bench).count() == 0
    got = resampling.resample(make([(1, None), (2, "few words")]), bench).collect()
    assert [(r.doc_id, r.n_features, r.rank) for r in sorted(got)] == [(1, 0, None), (2, 2, None)]


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middle(d, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return d, n, "plain", None, None, text, text
    form = "spm" if h4 % 100 < spm else "psm"
    made = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return d, n, form, len(p), len(m), made, text


@pytest.mark.parametrize("frame", [40, frames.FRAME])
def test_middle_equals_brute_force(spark, make, odd_rows, frame):
    rng = np.random.default_rng(2)
    docs = [(k, "".join(rng.choice(list("ab\n\t <é日>PSM"), int(rng.integers(0, 400))))) for k in range(400)] + odd_rows + MANY
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = fim.transform(fim.store(make(docs), frame), frame=frame, keep=True)
    want = [middle(*row) for row in docs]
    assert rows_of(got) == sorted([(*w[:5], sha(w[5]), sha(w[6]), w[5]) for w in want], key=str)
    assert {w[2] for w in want} == {"plain", "spm", "psm"}
    assert fim.transform(fim.store(make([]))).count() == 0
    assert fim.transform(fim.store(make(docs)), rate=0).where("form <> 'plain'").count() == 0


def test_frames_open_only_what_is_read():
    text = (" ".join(f"word{k}" for k in range(5000)) + " \n").encode()
    kept = frames.Frames.of_text(np.frombuffer(text, np.uint8), 1000)
    units = UNIT.findall(text.decode())
    assert kept.n_units == len(units) and kept.size == len(text) and len(kept.blobs) > 30
    opened = []
    part = kept.part
    kept.part = lambda k: opened.append(k) or part(k)
    for n in (0, 1, 777, len(units) - 1, len(units)):
        opened.clear()
        assert kept.cut(n)[0] == len("".join(units[:n]).encode()) and len(opened) <= 1
    opened.clear()
    assert b"".join(kept.read(2500, 2600)) == text[2500:2600] and len(opened) <= 2
    pieces = frames.Frames.of_chunks([b"ab<", b"", b"M", b">cd<M>"], 2)
    assert pieces.find(b"<M>") == 2 and pieces.find(b"<M>", 3) == 7 and pieces.find(b"<S>") == -1


def shard(key, weights, seed=13):
    draws = []
    for j in range(len(weights)):
        h = hashlib.sha256(f"{seed}:{'' if key is None else key}:{j // 8}".encode()).hexdigest()
        draws.append((int(h[j % 8 * 8 : j % 8 * 8 + 8], 16) + 0.5) / 2**32)
    return int(np.argmax([w / -math.log(u) for w, u in zip(weights, draws)]))


@pytest.mark.parametrize("weights", [[1.0] * 40, [1.0, 5.0, 2.0]])
def test_shards_equal_brute_force(spark, make, odd_rows, weights):
    docs = odd_rows + MANY + [(5, "copy")] * 300 + [(k, f"text {k % 7}") for k in range(100, 400)]
    got = sharding.assign(make(docs), len(weights), weights).collect()
    want = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", shard(d, weights), shard(d, [*weights, 1.0])) for d, t in docs]
    assert sorted(((*r[:5], r[6]) for r in got), key=str) == sorted(want, key=str)
    for k in range(len(weights)):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(w[4] == k for w in want)))
    assert all(r.grown_shard in (r.shard, len(weights)) for r in got)
    assert sharding.assign(make([])).count() == 0


def test_shards_follow_their_weights_and_move_little(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"))
    rows = sharding.assign(df, 3, [1.0, 2.0, 1.0], more=1.0).groupBy("shard", "grown_shard").count().collect()
    share = collections.Counter()
    for r in rows:
        share[r.shard] += r["count"]
    assert abs(share[1] / 20_000 - 0.5) < 0.02 and abs(share[0] / 20_000 - 0.25) < 0.02
    assert abs(sum(r["count"] for r in rows if r.grown_shard == 3) / 20_000 - 0.2) < 0.02
    with pytest.raises(ValueError):
        sharding.assign(df, 2, [1.0, 0.0])


def test_written_shards_and_groups(spark, make, odd_rows, tmp_path):
    docs = make(odd_rows).withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    sharding.write(docs, f"{tmp_path}/shards", 4, key="digest")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert rows_of(back.select("doc_id", "text")) == sorted(odd_rows, key=str)
    assert back.groupBy("digest").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    assert rows_of(sharding.assign(docs, 4, key="digest").select("doc_id", "shard")) == rows_of(back.select("doc_id", F.col("shard").cast("int")))


def test_contracts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    types = {
        "op11_importance_resampling": "bigint bigint bigint bigint bigint", "op12_fill_in_middle": "bigint bigint string bigint bigint string string",
        "op13_sharding": "bigint bigint bigint string int bigint int",
    }
    for name, kinds in types.items():
        out = queries.QUERIES[name](spark, folder)
        assert [k for _, k in out.dtypes] == kinds.split() and out.count() == docs
