"""Readers for the supported file kinds and for SQL sources, all read in parallel by Spark itself.

Workbooks and binary array files have no Spark reader: sheets come as CSV exports, matrices as delimited numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.text import file_extension

# Extensions accepted at upload, and those the reader knows.
UPLOAD_KINDS = ("csv", "xlsx", "json")
EXCEL_KINDS = ("xlsx", "xls", "xlsm", "xlsb", "xltx", "xltm")
READER_KINDS = ("csv", "json", "xml", "sql", *EXCEL_KINDS)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header row. Without a schema the types are inferred, which costs a pass."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.csv(path, inferSchema=True)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, *, lines: bool = False) -> DataFrame:
    """JSON arrays of records, one array per file; with ``lines`` one record per line, which can be split."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=not lines)


def read_xml(spark: SparkSession, path: str, row_tag: str = "row", schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.xml(path, rowTag=row_tag)


def read_sheet(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Sheets as spreadsheet programs export them: CSV with quoted cells, doubled quotes and a UTF-8 mark."""
    return spark.read.schema(schema).csv(path, header=True, escape='"', enforceSchema=True)


def read_matrix(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Rows of a matrix written as delimited numbers, as columns ``0 .. width-1``; other widths are an error."""
    schema = T.StructType([T.StructField(str(i), T.DoubleType()) for i in range(width)])
    return spark.read.schema(schema).csv(path, header=False, mode="FAILFAST")


def read_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame] | None = None, **connection) -> DataFrame:
    """A SQL query: over a JDBC connection when one is given, else over the named tables."""
    if connection:
        return spark.read.format("jdbc").options(**connection).option("query", query).load()
    return spark.sql(query, **(tables or {}))


def load(spark: SparkSession, path: str, kind: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read a table by kind, as named by the file extension."""
    kind = kind.lower()
    if kind == "csv":
        return read_csv(spark, path, schema)
    if kind == "json":
        return read_json(spark, path, schema)
    if kind == "xml":
        return read_xml(spark, path, schema=schema)
    if kind in EXCEL_KINDS:
        raise ValueError(f"{kind} files have no parallel reader: export the sheet as CSV and use read_sheet")
    raise ValueError(f"unsupported file kind: {kind}")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, kind, size_kb)`` of the files under a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", file_extension(F.col("path")).alias("kind"), F.col("length").alias("bytes"))


def allowed(files: DataFrame, kinds: Sequence[str] = UPLOAD_KINDS) -> DataFrame:
    return files.where(F.col("kind").isin(list(kinds)))


def small_enough(files: DataFrame, limit_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """Files up to the limit, with their size in KB."""
    return files.where(F.col("bytes") <= limit_bytes).withColumn("size_kb", F.round(F.col("bytes") / 1024, 2))
