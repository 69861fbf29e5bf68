"""Session helpers: settings the library relies on, and durable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session time zone, so timestamps print the same everywhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster such a folder would
    live on one machine and be lost with it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="lumenframe-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one written table inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Write a table to the shared folder and go on from its files.

    The new plan is a plain scan: it survives a lost executor, and loops do not carry the
    expressions of earlier rounds along. ``replaces`` is the table of the round before, if nothing
    else reads it: its files go once the new ones are there.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._step_path = path
    if replaces is not None:
        old = spark._jvm.org.apache.hadoop.fs.Path(replaces._step_path)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return out
