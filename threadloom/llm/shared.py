"""The folder that the driver and all executors share, and tables kept there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch, and Spark's own setting of them.
BATCH_BYTES, _BATCH_KEY, _BATCH_DEFAULT = "8m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a plain local session (tests, one machine) gets a folder of its own
    when the setting is missing; a cluster without it is an error, since a
    machine-local folder would be invisible to the other executors.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="threadloom-")
    spark.conf.set("spark.threadloom.local.dir", made)
    return made


def _own_dir(spark: SparkSession) -> str:
    return spark.conf.get("spark.threadloom.local.dir", None) or shared_dir(spark)


def bound_batches(spark: SparkSession) -> None:
    """Hold what goes to Python at once to ``BATCH_BYTES``, unless the session has a size of its own.

    Texts go over whole; buffers of 64 MB on either side of every task would be most of an executor's memory outside its heap.
    """
    if spark.conf.get(_BATCH_KEY, None) in (None, _BATCH_DEFAULT):
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)


def row_of(df: DataFrame) -> Column:
    """All columns of a table as one struct, whatever characters their names hold."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


class Kept:
    """A table written to the shared folder: it survives lost executors and cuts the lineage."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{_own_dir(self.spark)}/threadloom/{name}-{uuid.uuid4().hex}"
        bound_batches(self.spark)
        df.write.parquet(self.path)
        self._schema = self.spark.read.parquet(self.path).schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files, once nothing that is still to run reads them."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table that reads it back."""
    return Kept(df, name).df
