"""Text to numbers: label, ordinal, one-hot and category codes; term counts and TF-IDF. De-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.ordering import dense_codes
from lumenframe.functions.stats import string_columns
from lumenframe.session import cut_lineage

# Names of the encoders.
LABEL = "Label Encoder"
ONE_HOT = "One-Hot Encoder"
ORDINAL = "Ordinal Encoder"
COUNTS = "Count Vectorizer"
TFIDF = "TF-IDF Vectorizer"
METHODS = (LABEL, ONE_HOT, ORDINAL, COUNTS, TFIDF)

# A code table up to this many rows and letters is shipped to every task.
SHIP_CODES = 200_000
SHIP_LETTERS = 50_000_000
# So is a table of terms with the number of their texts.
SHIP_TERMS = 500_000
# Runs of two or more letters, digits or underscores, in any script.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def drop_duplicates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(cols)) if cols else df.dropDuplicates()


def _coded(df: DataFrame, col: str, source: Column, bucket_rows: int | None = None) -> DataFrame:
    """Replace ``col`` by the code of ``source``; null where ``source`` is null."""
    named = df.withColumn("_text", source)
    codes, distinct, letters = dense_codes(named, "_text", bucket_rows=bucket_rows)
    codes = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    if distinct <= SHIP_CODES and letters <= SHIP_LETTERS:
        codes = F.broadcast(codes)
    joined = named.join(codes, F.col("_text") == F.col("_value"), "left")
    return joined.withColumn(col, F.col("_code")).select(*df.columns)


def label(df: DataFrame, cols: Sequence[str] | None = None, *, bucket_rows: int | None = None) -> DataFrame:
    """Sorted distinct values become 0..n-1; a null counts as the text ``nan``."""
    for c in cols if cols is not None else string_columns(df):
        df = _coded(df, c, F.coalesce(F.col(c).cast("string"), F.lit("nan")), bucket_rows)
    return df


def label_target(df: DataFrame, target: str) -> DataFrame:
    """Label codes for a text target; any other target stays."""
    return label(df, [target]) if target in string_columns(df) else df


def ordinal(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols if cols is not None else string_columns(df))
    for c in cols:
        df = _coded(df, c, F.col(c).cast("string"))
    return df.withColumns({c: F.col(c).cast("double") for c in cols}) if cols else df


def category_codes(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """As ``label``, but a null is -1 and takes no code."""
    cols = list(cols if cols is not None else string_columns(df))
    for c in cols:
        df = _coded(df, c, F.col(c).cast("string"))
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(-1)).cast("long") for c in cols}) if cols else df


def one_hot(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 column per category, named ``<column>_<category>``.

    A flat table needs a column per category; for wide vocabularies use :func:`one_hot_vectors`.
    """
    cols = list(cols if cols is not None else string_columns(df))
    out = df.drop(*cols)
    exprs = [F.col(c) for c in out.columns]
    for c in cols:
        for row in df.select(c).distinct().orderBy(c).collect():
            v = row[0]
            if v is None:
                exprs.append(F.col(c).isNull().cast("int").alias(f"{c}_nan"))
            else:
                exprs.append(F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}"))
    return df.select(*exprs)


def one_hot_vectors(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sparse one-hot vectors in ``<column>_vec``, for any number of categories."""
    index = StringIndexer(
        inputCols=list(cols), outputCols=[f"_{c}" for c in cols], stringOrderType="alphabetAsc", handleInvalid="keep"
    )
    hot = OneHotEncoder(inputCols=[f"_{c}" for c in cols], outputCols=[f"{c}_vec" for c in cols], dropLast=False)
    return Pipeline(stages=[index, hot]).fit(df).transform(df).drop(*[f"_{c}" for c in cols])


def term_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, n)``: how often each lower-case token occurs in each text."""
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0))
    return df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def tf_idf(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, weight)`` with smoothed document frequency, scaled to unit length per text."""
    # Texts are sent once, by key: what follows keeps that order, and only the table of terms is shuffled again.
    counts = term_counts(df.select(key, text).repartition(key), key, text)
    docs = df.select(F.count("*")).first()[0]
    spread = cut_lineage(counts.groupBy("term").agg(F.count("*").alias("df")))
    terms, letters = spread.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if terms <= SHIP_TERMS and letters <= SHIP_LETTERS:
        spread = F.broadcast(spread)
    weight = F.col("n") * (F.log((1.0 + F.lit(docs)) / (1.0 + F.col("df"))) + 1.0)
    weighted = counts.join(spread, "term").select(key, "term", weight.alias("w"))
    # One group holds the distinct terms of one text.
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("w") / norm).alias("weight"))


def handle(df: DataFrame, method: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Encode the text columns of a table by the name of a per-row encoder."""
    if method == LABEL:
        return label(df, cols)
    if method == ORDINAL:
        return ordinal(df, cols)
    if method == ONE_HOT:
        return one_hot(df, cols)
    if method in (COUNTS, TFIDF):
        raise ValueError(f"{method} changes the grain of a table: use term_counts or tf_idf")
    raise ValueError(f"unknown encoder: {method}")
