"""Writers: edge tables and metrics as CSV or Parquet by snapshot, comments as JSON lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_edges(edges: DataFrame, path: str, form: str = "parquet") -> None:
    """Edges of positive weight, one folder per method and snapshot, so later reads prune by both."""
    rows = edges.filter("weight > 0")
    keys = [k for k in ("method", "snapshot") if k in edges.columns]
    if form == "csv":
        rows = rows.withColumnsRenamed({"src": "subreddit_a", "dst": "subreddit_b"})
    writer = rows.repartition(*keys).write.mode("overwrite").partitionBy(*keys) if keys else rows.write.mode("overwrite")
    (writer.option("header", True).csv if form == "csv" else writer.parquet)(path)


def write_json_lines(rows: DataFrame, path: str, by: Sequence[str] = (), codec: str | None = None, append: bool = False, spread: bool = False) -> None:
    """JSON lines, replacing what was there or appended to it; null fields are written. One folder per value of ``by``.

    With ``spread`` the rows are dealt over tasks of like size, in no order: to compress them takes longer, and a table may lie in one task.
    """
    writer = (rows.hint("rebalance") if spread else rows).write.mode("append" if append else "overwrite").option("ignoreNullFields", False)
    if codec:
        writer = writer.option("compression", codec)
    (writer.partitionBy(*by) if by else writer).json(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """A table that grows with its input as CSV with headers, a file per task."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_metrics(rows: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """A small result table as one CSV with a header."""
    (rows.orderBy(*order) if order else rows).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def tidy(record: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """keys, metric, value: the table behind a plot of metrics over time."""
    return record.unpivot(list(keys), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
