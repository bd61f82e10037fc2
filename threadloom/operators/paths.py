"""Weighted shortest paths of whole graphs, and what is summed over them, as DataFrame plans.

Distances by delta-stepping: a row per source and node holds its tentative distance; each round takes the rows whose
distance changed and lies in the graph's lowest bucket, joins them with their nodes' edges and keeps the
least distance per source and node. No task holds a graph, only rows; hubs are split like any other join. Sources
are worked on in packs of about ``PACK_PAIRS`` rows, one after the other, so what is held does not grow with the square of the nodes.

Betweenness by Brandes' accumulation over the shortest-path edges, a join per level: path counts outward, shares of paths inward.
Of a node v with s(v) shortest paths from the source, the share that passes on through it is s(v) * y(v) with
y(v) = sum of 1 / s(x) + y(x) over the nodes x after it, so both directions are sums over paths by their number of edges.

Weights are distances and have to be positive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.lineage import kept
from .edges import GRAPH
from .numbering import Numbered

#: Rows (source, node) of a pack of sources.
PACK_PAIRS = 50_000_000
#: Two lengths that differ by less, relative to the longer, are equal.
EQUAL = 1e-12


def _local(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema))


def tentative(sources: DataFrame, adjacency: DataFrame, widths: dict[int, float]) -> DataFrame:
    """g, s, v, d: distances from the sources (g, s) to all nodes that they reach.

    ``widths`` holds each graph's bucket width; a handful of rows (the least open distance of each graph) come back per round.
    """
    rows = kept(sources.select("g", "s", F.col("s").alias("v"), F.lit(0.0).alias("d"), F.lit(True).alias("open")))
    while lows := rows.filter("open").groupBy("g").agg(F.min("d")).collect():
        bounds = _local(rows, [(g, low + widths[g]) for g, low in lows], "g long, bound double")
        placed = rows.join(bounds, "g", "left")
        due = F.col("open") & (F.col("d") < F.col("bound"))
        step = placed.filter(due).select("g", "s", F.col("v").alias("u"), "d").join(adjacency, ["g", "u"])
        found = step.select("g", "s", "v", (F.col("d") + F.col("w")).alias("d"), F.lit(None).cast("boolean").alias("open"))
        old = placed.select("g", "s", "v", "d", (F.col("open") & ~due).alias("open"))
        least = old.unionByName(found).groupBy("g", "s", "v").agg(F.min("d").alias("d"), F.min(F.when(F.col("open").isNotNull(), F.col("d"))).alias("before"), F.bool_or("open").alias("left_open"))
        rows = kept(least.select("g", "s", "v", "d", (F.col("before").isNull() | (F.col("d") < F.col("before")) | F.col("left_open")).alias("open")))
    return rows.drop("open")


def _on_shortest_paths(distances: DataFrame, adjacency: DataFrame) -> DataFrame:
    """g, s, u, v: edges that lie on a shortest path from s, in its direction. What passes a source's farthest node is dropped before any shuffle."""
    far = distances.groupBy("s").agg(F.max("d").alias("far"))
    start = distances.join(far, "s").select("g", "s", F.col("v").alias("u"), F.col("d").alias("du"), "far")
    longer = F.col("du") + F.col("w")
    steps = start.join(adjacency, ["g", "u"]).filter(longer <= F.col("far") * (1 + EQUAL)).select("g", "s", "u", "v", longer.alias("length"))
    ends = distances.select("s", "v", "d")
    return steps.join(ends, ["s", "v"]).filter(F.abs(F.col("length") - F.col("d")) <= EQUAL * F.col("d")).select("s", "u", "v")


def _levels(first: DataFrame, edges: DataFrame, into: str, value: Column) -> DataFrame:
    """Sums of s, ``into``, x over all walks of any length along edges; ``first`` are the walks of none, ``value`` what an edge passes on."""
    out = "u" if into == "v" else "v"
    parts, level = [first], first
    while True:
        level = kept(level.withColumnRenamed("node", out).join(edges, ["s", out]).groupBy("s", F.col(into).alias("node")).agg(F.sum(value).alias("x")))
        if level.isEmpty():
            break
        parts.append(level)
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return kept(total.groupBy("s", "node").agg(F.sum("x").alias("x")))


def passed_through(distances: DataFrame, adjacency: DataFrame) -> DataFrame:
    """id, mid: for each node, its share of the shortest paths between all other nodes and these sources, ends not counted."""
    edges = kept(_on_shortest_paths(distances, adjacency))
    ways = _levels(distances.filter("s = v").select("s", F.col("v").alias("node"), F.lit(1.0).alias("x")), edges, "v", F.col("x"))
    ends = edges.join(ways.select("s", F.col("node").alias("v"), F.col("x").alias("n")), ["s", "v"])
    start = kept(ends.groupBy("s", F.col("u").alias("node")).agg(F.sum(1 / F.col("n")).alias("x")))
    after = _levels(start, edges, "u", F.col("x"))
    both = after.withColumnRenamed("x", "y").join(ways, ["s", "node"]).filter("s <> node")
    return both.groupBy(F.col("node").alias("id")).agg(F.sum(F.col("x") * F.col("y")).alias("mid"))


def distance_metrics(edges: DataFrame, keys: Sequence[str] = GRAPH, between: bool = True, pack_pairs: int = PACK_PAIRS) -> DataFrame:
    """node, in_largest, closeness (null outside the largest component), distance sum and eccentricity there, and betweenness.

    Betweenness is over the whole graph, normalised by (n - 1)(n - 2) for ordered pairs. Of equally large components
    that of the least node counts. The buckets of a graph are as wide as its mean weight.
    """
    graph = Numbered(edges, keys, F.min)
    about = graph.adjacency.groupBy("g").agg(F.avg("w"), F.min("w")).collect()
    if any(not least > 0 for _, _, least in about):
        raise ValueError("weights serve as distances here and have to be positive")
    widths = {g: mean for g, mean, _ in about}
    sizes = graph.ids.groupBy("g").agg(F.count("*").alias("n"))
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
    packs = max(1, -int(-pairs // pack_pairs))
    reached, passed = [], []
    for k in range(packs):
        sources = graph.ids.filter(F.pmod(F.xxhash64("id"), F.lit(packs)) == k).select("g", F.col("id").alias("s"))
        distances = tentative(sources, graph.adjacency, widths)
        reached.append(kept(distances.groupBy("g", F.col("s").alias("id")).agg(F.sum("d").alias("sum"), F.max("d").alias("most"), F.count("*").alias("size"), F.min("v").alias("first"))))
        if between:
            passed.append(kept(passed_through(distances, graph.adjacency)))
    told = _union(reached)
    largest = told.groupBy("g").agg(F.max_by("first", F.struct("size", -F.col("first"))).alias("top"))
    inside = F.col("first") == F.col("top")
    rows = told.join(F.broadcast(largest), "g").join(F.broadcast(sizes), "g")
    rows = rows.join(_union(passed).groupBy("id").agg(F.sum("mid").alias("mid")), "id", "left") if between else rows.withColumn("mid", F.lit(None).cast("double"))
    pairs_of = F.greatest((F.col("n") - 1) * (F.col("n") - 2), F.lit(1))
    share = F.coalesce("mid", F.lit(0.0)) / pairs_of if between else F.col("mid")
    rows = rows.select(
        "id", inside.alias("in_largest"), F.round(F.when(inside, ratio(F.col("size") - 1, F.col("sum"))), 6).alias("closeness"),
        F.when(inside, F.col("sum")).alias("far"), F.when(inside, F.col("most")).alias("eccentricity"), F.when(inside, F.col("size")).alias("size"), F.round(share, 6).alias("betweenness"),
    )
    return graph.named(rows, "in_largest", "closeness", "far", "eccentricity", "size", "betweenness")


def _union(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def path_summary(metrics: DataFrame, keys: Sequence[str] = GRAPH) -> DataFrame:
    """Mean distance over ordered pairs and diameter of the largest component."""
    pairs = F.max("size") * (F.max("size") - 1)
    return metrics.filter("in_largest").groupBy(*keys).agg(F.round(ratio(F.sum("far"), pairs), 6).alias("avg_shortest_path"), F.round(F.max("eccentricity"), 6).alias("diameter"))
