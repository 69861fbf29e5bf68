"""Registration of queries and the small helpers their definitions share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Parquet tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` as query ``name``."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(prepare(spark), folder))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r(c: Column | str, places: int = 6) -> Column:
    """Rounded double; adding zero turns a negative zero into zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), places) + F.lit(0.0)


def sr(expr: str, places: int = 6) -> str:
    """The same rounding in SQL."""
    return f"(round(({expr})::double, {places}) + 0.0)"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column."""
    return df.select(
        *[
            r(f.name, places).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema
        ]
    )


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)
