"""Algebra of edge tables: canonical pairs, filters, set operations, degrees and strengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRAPH = ["method", "snapshot"]


def canonical(edges: DataFrame, directed: bool = False) -> DataFrame:
    """Edges with src < dst, self-loops dropped; of repeated pairs the greatest weight stays."""
    if directed:
        return edges
    keys = [c for c in edges.columns if c not in ("src", "dst", "weight")]
    pair = edges.filter("src <> dst").withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    return pair.groupBy(*keys, "src", "dst").agg(F.max("weight").alias("weight"))


def heavier(edges: DataFrame, least: float) -> DataFrame:
    return edges.filter(F.col("weight") >= least)


def within(edges: DataFrame, nodes: DataFrame, both: bool = True) -> DataFrame:
    """Edges with both endpoints (or either) among ``nodes``."""
    a, b = (nodes.select(F.col("node").alias(c)) for c in ("src", "dst"))
    if both:
        return edges.join(a, "src", "left_semi").join(b, "dst", "left_semi").select(*edges.columns)
    first = edges.join(a, "src", "left_semi").select(*edges.columns)
    rest = edges.join(a, "src", "left_anti").join(b, "dst", "left_semi").select(*edges.columns)
    return first.unionByName(rest)


def both_ways(edges: DataFrame, keys: Sequence[str] = GRAPH) -> DataFrame:
    """Adjacency: u, v, weight in either direction, from one scan."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v"))))
    return edges.select(*keys, ends.alias("e"), "weight").select(*keys, "e.u", "e.v", "weight")


def weights(edges: DataFrame, keys: Sequence[str] = GRAPH) -> DataFrame:
    """src, dst and weight of every edge, 1 where it has none."""
    given = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
    return edges.select(*keys, "src", "dst", given.alias("weight"))


def nodes(edges: DataFrame, keys: Sequence[str] = GRAPH) -> DataFrame:
    return edges.select(*keys, F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame, keys: Sequence[str] = GRAPH) -> DataFrame:
    """node, degree and strength (summed weight)."""
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node"), "weight")
    return ends.groupBy(*keys, "node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def compose(edges: DataFrame, order: str = "snapshot") -> DataFrame:
    """Union of snapshots; a pair keeps the weight of its latest one."""
    return edges.groupBy("method", "src", "dst").agg(F.max_by("weight", order).alias("weight"))


def expanding_train(edges: DataFrame) -> DataFrame:
    """For each snapshot after a method's first, the composition of all before it: train graphs by ``test``.

    A pair's weight changes only where it occurs, so instead of joining every
    test with its whole past, each pair carries its value over the tests until its next occurrence.
    """
    steps = edges.select("method", "snapshot").distinct()
    later = Window.partitionBy("method", "src", "dst").orderBy("snapshot")
    until = edges.withColumn("until", F.lead("snapshot").over(later))
    tests = steps.select(F.col("method").alias("m"), F.col("snapshot").alias("test"))
    spans = (F.col("test") > F.col("snapshot")) & (F.col("until").isNull() | (F.col("test") <= F.col("until")))
    return until.join(F.broadcast(tests), (F.col("method") == F.col("m")) & spans).select("method", "test", "src", "dst", "weight")


def yearly_stats(networks: DataFrame) -> DataFrame:
    """yr, nodes, edges, total weight."""
    pair = F.struct(F.least("node_1", "node_2"), F.greatest("node_1", "node_2"))
    ends = networks.select("yr", F.explode(F.array("node_1", "node_2")).alias("node")).groupBy("yr").agg(F.count_distinct("node").alias("n_nodes"))
    rest = networks.groupBy("yr").agg(F.count_distinct(pair).alias("n_edges"), F.sum("weighted").alias("total_weight"))
    return rest.join(ends, "yr").select("yr", "n_nodes", "n_edges", "total_weight")


def total_counts(networks: DataFrame) -> DataFrame:
    """Distinct nodes and distinct undirected edges over all years, one row."""
    n = networks.select(F.explode(F.array("node_1", "node_2")).alias("node")).agg(F.count_distinct("node").alias("n_nodes"))
    e = networks.agg(F.count_distinct(F.struct(F.least("node_1", "node_2"), F.greatest("node_1", "node_2"))).alias("n_edges"))
    return n.join(F.broadcast(e))


def backbone(networks: DataFrame) -> DataFrame:
    """Rows flagged unweighted = 1; the weight only where it is positive. Without the flag column all rows stay."""
    kept = networks.filter("unweighted = 1") if "unweighted" in networks.columns else networks
    return kept.select("yr", "node_1", "node_2", F.when(F.col("weighted") > 0, F.col("weighted")).alias("weighted"))


def persistent_nodes(networks: DataFrame, years: int = 5) -> DataFrame:
    """Nodes present in ``years`` or more consecutive available years, with the first and last of each run."""
    numbered = networks.select("yr").distinct().withColumn("k", F.row_number().over(Window.orderBy("yr")))
    seen = networks.select("yr", F.explode(F.array("node_1", "node_2")).alias("node")).distinct().join(F.broadcast(numbered), "yr")
    run = F.col("k") - F.row_number().over(Window.partitionBy("node").orderBy("k"))
    runs = seen.withColumn("run", run).groupBy("node", "run").agg(F.min("yr").alias("first_year"), F.max("yr").alias("last_year"), F.count("*").alias("n_years"))
    return runs.filter(F.col("n_years") >= years).select("node", "first_year", "last_year", "n_years")


def retention(networks: DataFrame, kept_nodes: DataFrame) -> DataFrame:
    """yr, rows, rows with both endpoints kept, and their percentage."""
    marks = [kept_nodes.select(F.col("node").alias(f"node_{k}"), F.lit(1).alias(f"in_{k}")).distinct() for k in (1, 2)]
    both = networks.join(marks[0], "node_1", "left").join(marks[1], "node_2", "left")
    hit = F.count_if(F.col("in_1").isNotNull() & F.col("in_2").isNotNull())
    return both.groupBy("yr").agg(F.count("*").alias("n_rows"), hit.alias("n_kept")).withColumn("pct", F.round(100.0 * F.col("n_kept") / F.col("n_rows"), 6))


def node_strength(networks: DataFrame) -> DataFrame:
    """node, summed weight over all years, mean weight per row it ends."""
    ends = networks.select(F.explode(F.array("node_1", "node_2")).alias("node"), "weighted")
    return ends.groupBy("node").agg(F.sum("weighted").alias("strength"), F.round(F.avg("weighted"), 6).alias("mean_weight"))


def strongest(networks: DataFrame, k: int = 10) -> DataFrame:
    """The k nodes of greatest strength, ties by name, numbered from 1."""
    top = node_strength(networks).orderBy(F.col("strength").desc(), "node").limit(k)
    place = F.row_number().over(Window.orderBy(F.col("strength").desc(), "node"))
    return top.select(place.alias("place"), "node", "strength")


def strength_by_year(networks: DataFrame, k: int = 10) -> DataFrame:
    """One row per year, one column per top node by place; null where a node is absent that year."""
    top = F.broadcast(strongest(networks, k).select("place", "node"))
    ends = networks.select("yr", F.explode(F.array("node_1", "node_2")).alias("node"), "weighted").join(top, "node")
    wide = ends.groupBy("yr").pivot("place", list(range(1, k + 1))).agg(F.sum("weighted"))
    return wide.select("yr", *(F.col(str(p)).alias(f"place_{p}") for p in range(1, k + 1)))
