"""Writers: every partition writes its own file in parallel."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """One record per line, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_xml(df: DataFrame, path: str, row_tag: str = "row") -> None:
    df.write.mode("overwrite").xml(path, rowTag=row_tag, rootTag="data")


def write_excel(df: DataFrame, path: str) -> None:
    """CSV that spreadsheet programs open as it is: all cells quoted, quotes doubled, marked as UTF-8."""
    first = df.columns[0]
    marked = df.withColumnRenamed(first, "﻿" + first)
    marked.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Long metric rows as JSON."""
    metrics.write.mode("overwrite").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Lines of a report in order, as text; a report is small, so it is one file."""
    lines.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)


def write(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Write a table by kind."""
    writers = {"csv": write_csv, "json": write_json, "xml": write_xml, "excel": write_excel}
    if kind not in writers:
        raise ValueError(f"unsupported output kind: {kind}")
    writers[kind](df, path)


def _newest(spark: SparkSession, path: str) -> int:
    """Number of the newest complete version of a stored table; files of a failed write are not listed."""
    found = re.findall(r"/version=(\d+)/", "\n".join(spark.read.parquet(path).inputFiles()))
    return max(map(int, found), default=0)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a stored table."""
    return spark.read.parquet(f"{path}/version={_newest(spark, path)}")


def store(df: DataFrame, path: str) -> None:
    """Start a stored table: a folder of versions, of which readers take the newest."""
    df.write.parquet(f"{path}/version=0")


def update_stored(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """Write ``change`` of the newest version as the next one; it counts once its files are committed."""
    n = _newest(spark, path)
    change(spark.read.parquet(f"{path}/version={n}")).write.parquet(f"{path}/version={n + 1}")
