"""Domain tables made from the test tables: comments, networks, threads and their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DELETED = "[deleted]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, author, community, score, snapshot: one row per event."""
    e = table(spark, sf_dir, "events")
    author = F.when(F.col("user_id") % 37 == 0, DELETED).otherwise(F.col("user_id").cast("string"))
    return e.select(
        F.col("event_id").alias("id"),
        author.alias("author"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("community"),
        (F.floor("value").cast("long") - 34).alias("score"),
        F.floor((F.dayofmonth("ts") - 1) / 7).cast("long").alias("snapshot"),
    )


def bots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("user_id % 50 = 7").select(F.col("user_id").cast("string").alias("author")).distinct()


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """yr, node_1, node_2, weighted, unweighted: brands bought by the same customers in a year."""
    bought = (
        table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("author"), F.year("o_orderdate").cast("long").alias("yr"))
        .join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        .join(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("node")), F.col("l_partkey") == F.col("p_partkey"))
        .select("yr", "author", "node").distinct()
    )
    a, b = (bought.select("yr", "author", F.col("node").alias(f"node_{k}")) for k in (1, 2))
    pairs = a.join(b, ["yr", "author"]).filter("node_1 < node_2").groupBy("yr", "node_1", "node_2").agg(F.count("*").alias("weighted"))
    place = F.rank().over(Window.partitionBy("yr").orderBy(F.col("weighted").desc()))
    return pairs.withColumn("unweighted", F.when(place <= 40, 1).otherwise(0))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, link_id, parent_id, author, body_cleaned, pos: conversations as comment threads."""
    c = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    link = F.concat(F.lit("t"), conv)
    at = lambda t: F.concat(F.lit("m"), conv, F.lit("_"), t.cast("string"))
    return c.select(
        at(turn).alias("id"), link.alias("link_id"), F.when(turn == 0, link).otherwise(at(turn - 1)).alias("parent_id"),
        F.col("role").alias("author"), F.col("text").alias("body_cleaned"), turn.alias("pos"),
    )


def _traits(number) -> list:
    party = F.when(number % 3 == 0, "dem").when(number % 3 == 1, "rep").otherwise("")
    flag = lambda m: F.when(number % m == 0, 1).otherwise(0)
    return [party.alias("party"), flag(7).alias("banned"), flag(5).alias("gun")]


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """community, party, banned, gun."""
    number = F.expr("cast(substr(community, 2) as bigint)")
    return comments(spark, sf_dir).select("community").distinct().select("community", *_traits(number))


def brand_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, party, banned, gun."""
    number = F.expr("cast(substr(node, 7) as bigint)")
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("node")).distinct().select("node", *_traits(number))
