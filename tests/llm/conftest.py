import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, bucket int, h string, score string"


@pytest.fixture
def folder():
    return FOLDER


@pytest.fixture
def make(spark):
    """Documents from (id, text) rows, with further columns whose names operators use themselves."""

    def build(rows):
        return spark.createDataFrame(
            [(d, t, "en" if d and d % 2 else None, f"s{(d or 0) % 3}", len(t or ""), "x", 1, "y", "z") for d, t in rows], DOCS
        )

    return build


@pytest.fixture
def odd_rows():
    """Nulls, empty and blank texts, copies, a repeated row, a long text, one long word, other scripts."""
    words = [f"w{i * i % 97}" for i in range(3000)]
    long_text = " ".join(words)
    return [
        (1, "A plain sentence of more than fifty bytes, so that it holds a passage to find."), (2, None), (3, ""), (4, " \n\t "), (5, "short"),
        (6, "A plain sentence of more than fifty bytes, so that it holds a passage to find."), (7, long_text), (7, long_text),
        (8, "x" * 5000), (9, long_text + " and an end"), (10, "日本語のテキスト " * 20), (11, "日本語のテキスト " * 20 + "終"),
        (12, "Start. A plain sentence of more than fifty bytes, so that it holds a passage to find. End."), (13, "\0\x01 odd   bytes"),
    ]
