"""Top-k search and perspective rotation against SQL and by hand."""

import duckdb
import pandas as pd
import pytest

from check import compare
from lumenframe.llm import chat, queries, topk

VECTORS = "vec_id long, embedding array<float>, label int, id string, v string"


def sql_of(rows, oracle):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [(r[0], r[1]) for r in rows])
    return sorted(con.execute(oracle).fetchall())


@pytest.mark.parametrize("name", ["op4_exact_topk", "op7_perspectives"])
def test_tables(spark, con, folder, name):
    assert compare(con, queries.QUERIES[name](spark, folder), queries.ORACLES[name]) is None


def test_small_blocks(spark, con, folder):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    assert compare(con, topk.top_k(df, lambda c: c % 100 == 0, block=40, per_task=2, head=3), queries.ORACLES["op4_exact_topk"]) is None


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-1.0, 0.5]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (100, [0.0, 0.0]), (8, [3.5, -0.001])]
    df = spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows] + [(None, [1.0, 1.0], 1, "a", "b")], VECTORS)
    got = topk.top_k(df, lambda c: c % 100 == 0, k=3)
    assert sorted(tuple(r) for r in got.collect()) == sql_of(rows, topk.oracle(k=3))
    lengths = spark.createDataFrame([(0, [1.0], 1, "a", "b"), (1, [2.0, 5.0], 1, "a", "b"), (2, [], 1, "a", "b")], VECTORS)
    assert [tuple(r) for r in topk.top_k(lengths, lambda c: c == 0).orderBy("rank").collect()] == [(0, 1, 1, 2 * 1024 * 1024), (0, 2, 2, 0)]
    assert topk.top_k(df.limit(0), lambda c: c == 0).collect() == []


CONVERSATIONS = "conv_id long, turn long, role string, text string, name string, start string, size int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "n", "s", 0) for r in rows], CONVERSATIONS)


def test_dialogue_by_hand(spark):
    df = turns(spark, [(1, 0, "system", "Be brief."), (1, 1, "Ann B", "Hi"), (1, 2, "Bob", "Hello"), (1, 3, "Ann B", None)])
    rows = chat.perspectives(df, chunk=2).orderBy("perspective", "position").collect()
    for who, text in (("Ann B", "<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n"
                                "<|im_start|>user name=Bob\nHello<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"),
                      ("Bob", "<|im_start|>system\nBe brief.<|im_end|>\n<|im_start|>user name=Ann_B\nHi<|im_end|>\n"
                              "<|im_start|>assistant\nHello<|im_end|>\n<|im_start|>user name=Ann_B\n<|im_end|>\n")):
        mine = [r for r in rows if r.perspective == who]
        assert "".join(r.rendered for r in mine) == text
        assert all(text[r.start : r.end] == r.rendered for r in mine)
        trained = [text[r.mask_start : r.mask_end] for r in mine if r.mask_start is not None]
        assert trained == (["Hi<|im_end|>\n", "<|im_end|>\n"] if who == "Ann B" else ["Hello<|im_end|>\n"])


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_odd_turns(spark, chunk):
    rows = [(1, 0, "a", "x"), (1, 0, "a", "x"), (1, None, None, None), (1, 5, "b", ""), (None, 1, "a", "lone"), (2, 1, "system", "only"),
            (3, 1, "b", "é" * 50_000), (3, -7, "c", "early"), (1, 5, "a", "tie")]
    df = turns(spark, rows)
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", frame)
    assert compare(con, chat.perspectives(df, chunk=chunk), chat.oracle()) is None
    assert chat.perspectives(df.limit(0)).collect() == []


def test_only_dataframe_functions(spark, folder):
    plan = queries.op7_perspectives(spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
