"""Cutting the lineage of iterative plans with reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a plain local session makes one of its own."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="threadloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_shared(spark).rstrip('/')}/threadloom/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, name: str = "step") -> DataFrame:
    """The table written to the shared folder and read back. Unlike a checkpoint it has a size, by which Spark picks the joins that follow."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
