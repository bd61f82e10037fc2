"""Interaction graphs from a stream of comments.

Comments are summed per tumbling window, author and community with a watermark,
so state is dropped once a window is past. Closed windows are appended to a
table; the pairs of communities of a window are then a batch query over its rows,
which all lie in the window's folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.columns import adjusted_score, sentiment_label
from ..operators.interactions import DELETED, pair_up


def windowed_sentiment(stream: DataFrame, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """snapshot (start of the window), author, community and score measures, from comments with a time ``ts``."""
    s = adjusted_score(F.col("score"))
    kept = stream.filter(F.col("author").isNotNull() & (F.col("author") != DELETED)).withWatermark("ts", late)
    sums = kept.groupBy(F.window("ts", window).alias("w"), "author", "community").agg(
        F.sum(F.when(s > 0, 1).otherwise(0)).alias("num_pos"),
        F.sum(F.when(s < 0, 1).otherwise(0)).alias("num_neg"),
        F.sum(F.greatest(s, F.lit(0))).alias("sum_pos_scores"),
        F.sum(F.greatest(-s, F.lit(0))).alias("sum_neg_scores"),
    )
    label = sentiment_label(*(F.col(c) for c in ("num_pos", "num_neg", "sum_pos_scores", "sum_neg_scores")))
    return sums.select(F.col("w.start").alias("snapshot"), "author", "community", label.alias("sentiment"))


def append_windows(stream: DataFrame, path: str, checkpoint: str, window: str = "7 days", late: str = "1 day") -> StreamingQuery:
    """Start a query that appends each closed window to ``path`` and ends when the source has no more."""
    rows = windowed_sentiment(stream, window, late).filter("sentiment <> 'Neutral'")
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_open_windows(rows: DataFrame, comments: DataFrame, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """The appended windows and, from the finite table ``comments``, those that the watermark never closed."""
    whole = windowed_sentiment(comments, window, late).filter("sentiment <> 'Neutral'")
    return rows.unionByName(whole.join(rows.select("snapshot").distinct(), "snapshot", "left_anti").select(*rows.columns))


def edges_of_windows(rows: DataFrame) -> DataFrame:
    """snapshot, src, dst, weight of the appended windows."""
    return pair_up(rows, ["snapshot", "author", "sentiment"])
