"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import chat, fim, fingerprints, html, packing, pieces, quality, resampling, sharding, topk, toxicity
from lumenframe.llm.jaccard import components
from lumenframe.llm.suffix_dedup import remove_repeats
from lumenframe.session import prepare


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes that remain of every document after passages of smaller documents are removed."""
    out = remove_repeats(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose five-word shingle sets reach a Jaccard similarity of 0.75."""
    return components(table(spark, folder, "documents"))


def op4_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten highest inner products of every hundredth vector with all others."""
    return topk.top_k(table(spark, folder, "embeddings"), lambda key: key % 100 == 0)


def op7_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation from the perspective of each of its speakers."""
    return chat.perspectives(table(spark, folder, "conversations"))


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return packing.pack(table(spark, folder, "documents"))


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and the digest of the text that they spell."""
    spelled = pieces.decode(pieces.encode(table(spark, folder, "documents")))
    return spelled.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score for every document, learned from confirmed toxic and unlabelled texts."""
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its text with the last third from the next one, and their likeness."""
    return fingerprints.versions(table(spark, folder, "documents"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """A quality score for every document, from two co-trained views."""
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, folder, "labels")))


def op10_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html.main_text(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Weight, score and rank of every document in a draw towards the benchmark's distribution of words."""
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Form, cuts and digests of the fill-in-the-middle output of every document."""
    return fim.transform(fim.store(table(spark, folder, "documents")))


def op13_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in one of forty shards, and the shard it takes when there is one more."""
    return sharding.assign(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_best_fit_packing, op3_ngram_jaccard, op4_exact_topk, op5_sentencepiece, op6_toxicity, op7_perspectives,
        op8_fingerprints, op9_quality, op10_html_main_text, op11_importance_resampling, op12_fill_in_middle, op13_sharding,
    )
}

ORACLES: dict[str, str] = {
    "op4_exact_topk": topk.oracle(), "op7_perspectives": chat.oracle(), "op11_importance_resampling": resampling.oracle(),
    "op12_fill_in_middle": fim.oracle(), "op13_sharding": sharding.oracle(),
}
