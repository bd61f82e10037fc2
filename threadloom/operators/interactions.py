"""Interaction graphs from comments: who is active in two communities, and with the same leaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import adjusted_score, sentiment_label
from ..functions.lineage import kept

DELETED = "[deleted]"


def clean_comments(comments: DataFrame, bots: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Comments without deleted, missing and bot authors, optionally of allowed communities only.

    The bot list and the allow-list are joined as they are; Spark broadcasts them while they are small.
    """
    kept = comments.filter(F.col("author").isNotNull() & (F.col("author") != DELETED))
    if bots is not None:
        kept = kept.join(bots.select(F.col("author").cast("string").alias("author")), "author", "left_anti")
    if allowed is not None:
        kept = kept.join(allowed.select("community"), "community", "left_semi")
    return kept.select(*comments.columns)


def activity(comments: DataFrame, threshold: int = 1) -> DataFrame:
    """snapshot, author, community, n: comments per author and community, from ``threshold`` on."""
    return comments.groupBy("snapshot", "author", "community").agg(F.count("*").alias("n")).filter(F.col("n") >= threshold)


def sentiment_summary(comments: DataFrame) -> DataFrame:
    """Score measures and leaning of each author in each community."""
    s = adjusted_score(F.col("score"))
    sums = comments.groupBy("snapshot", "author", "community").agg(
        F.sum(F.when(s > 0, 1).otherwise(0)).alias("num_pos"),
        F.sum(F.when(s < 0, 1).otherwise(0)).alias("num_neg"),
        F.sum(F.greatest(s, F.lit(0))).alias("sum_pos_scores"),
        F.sum(F.greatest(-s, F.lit(0))).alias("sum_neg_scores"),
        F.count("*").alias("total_comments"),
    )
    return sums.withColumn("sentiment", sentiment_label(*(F.col(c) for c in ("num_pos", "num_neg", "sum_pos_scores", "sum_neg_scores"))))


def pair_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    """snapshot, src, dst, weight: the number of key values that two communities share.

    One self-join whose condition holds src < dst; both sides reuse one exchange.
    """
    a = rows.select(*keys, F.col("community").alias("src"))
    b = rows.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("community").alias("dst"))
    on = F.col("src") < F.col("dst")
    for k in keys:
        on &= F.col(k) == F.col(f"_{k}")
    return a.join(b, on).groupBy("snapshot", "src", "dst").agg(F.count("*").alias("weight"))


def cocomment_edges(comments: DataFrame, threshold: int = 1) -> DataFrame:
    """Communities linked by authors with at least ``threshold`` comments in both."""
    return pair_up(activity(comments, threshold), ["snapshot", "author"])


def sentiment_edges(comments: DataFrame) -> DataFrame:
    """Communities linked by authors with the same leaning, not neutral, in both."""
    return pair_up(sentiment_summary(comments).filter("sentiment <> 'Neutral'"), ["snapshot", "author", "sentiment"])


def labelled(edges: DataFrame, method: str) -> DataFrame:
    """The edge table of one method, as the other operators take it."""
    return edges.select(F.lit(method).alias("method"), "snapshot", "src", "dst", F.col("weight").cast("double").alias("weight"))


def edge_table(comments: DataFrame) -> DataFrame:
    """The edges of both methods, labelled, from one join: authors active in two communities, and those of them with the same leaning in both.

    The activity is kept, as both sides of the join read it; it is much larger than its files, so it is never sent to all tasks.
    """
    leaning = F.nullif("sentiment", F.lit("Neutral"))
    met = kept(sentiment_summary(comments).select("snapshot", "author", "community", leaning.alias("leaning")), "activity")
    a = met.select("snapshot", "author", F.col("community").alias("src"), F.col("leaning").alias("one"))
    b = met.select(F.col("snapshot").alias("_snapshot"), F.col("author").alias("_author"), F.col("community").alias("dst"), F.col("leaning").alias("other"))
    on = (F.col("snapshot") == F.col("_snapshot")) & (F.col("author") == F.col("_author")) & (F.col("src") < F.col("dst"))
    pairs = a.hint("merge").join(b, on).groupBy("snapshot", "src", "dst").agg(F.count("*").alias("cocomment"), F.count_if(F.col("one") == F.col("other")).alias("sentiment"))
    rows = F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("weight")) for m in ("cocomment", "sentiment")))
    return pairs.select("snapshot", "src", "dst", F.inline(rows)).filter("weight > 0").select("method", "snapshot", "src", "dst", "weight")
