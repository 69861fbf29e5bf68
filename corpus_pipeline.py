"""From raw documents to packed training sequences.

Each stage gets what the one before kept, decides on all of it, and returns the columns of ``documents``; the last one
returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import packing, quality, toxicity
from lumenframe.llm.jaccard import components_of_rows
from lumenframe.llm.rows import numbered
from lumenframe.llm.suffix_dedup import remove_repeats, text_of
from lumenframe.session import prepare, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    docs = _columns(docs)
    model = quality.fit(docs, _labels(spark, sf_dir))
    return _columns(quality.keep(docs, model))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.

    The model is fitted on all documents, also those that went before: their labels count for the prior, and toxic texts are rare.
    """
    docs = _columns(docs)
    model = toxicity.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), _labels(spark, sf_dir))
    return _columns(toxicity.clean(docs, model))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest id of each component of near copies; of rows of one component that share it, one.

    Rows that only share an id are different documents. Rows without an id or without words are in no component and stay.
    """
    docs = _columns(docs)
    known, shift = numbered(docs.where("doc_id is not null"))
    found = components_of_rows(known)
    first = found.where("uid = component").groupBy("uid").agg(F.max("n_shingles").alias("words"))
    kept = known.join(first, "uid")
    if shift:
        once = kept.where("words > 0").groupBy("uid").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
        kept = once.union(_columns(kept.where("words = 0")))
    return _columns(kept).union(_columns(docs.where("doc_id is null")))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller id has too; a character that was cut apart goes whole.

    A document of which nothing remains stays with an empty text.
    """
    docs = _columns(docs)
    kept = text_of(remove_repeats(docs, numbers=True)).where("doc_id is not null")
    known, shift = numbered(docs.where("doc_id is not null"))
    if shift:
        kept = kept.dropDuplicates(["uid"])  # equal rows have equal remains, each row meets them with its own columns
    named = kept.join(known.select("uid", "lang", "source"), "uid")
    rows = named.select("doc_id", "text", "lang", "source").union(docs.where("doc_id is null").select("doc_id", "text", "lang", "source"))
    return _columns(rows.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document in sequences of at most 1024 tokens."""
    return packing.pack(_columns(docs))


STAGES = [
    ("quality classifier", quality_filter),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("best-fit packing", packed),
]

#: The classifiers, the searches and the packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"stage{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
