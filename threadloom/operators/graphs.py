"""Graph metrics as DataFrame plans: counts, density, clustering, components, hop distances, weights, the static record.

Weighted paths are in ``paths``, eigenvector centrality in ``spectral``, communities in ``louvain``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.lineage import cut, kept
from .edges import GRAPH, both_ways, degrees

#: Edges, of all graphs together, up to which components are found by one task per graph.
ONE_TASK_EDGES = 1_000_000


def counts(edges: DataFrame, keys: Sequence[str] = GRAPH) -> DataFrame:
    """Nodes, edges, density 2m / (n (n - 1)), 0 for a single node."""
    n = edges.select(*keys, F.explode(F.array("src", "dst")).alias("x")).groupBy(*keys).agg(F.count_distinct("x").alias("num_nodes"))
    m = edges.groupBy(*keys).agg(F.count("*").alias("num_edges"))
    density = ratio(2 * F.col("num_edges"), F.col("num_nodes") * (F.col("num_nodes") - 1))
    return n.join(m, list(keys)).select(*keys, "num_nodes", "num_edges", F.round(density, 6).alias("density"))


def degree_centrality(edges: DataFrame, keys: Sequence[str] = GRAPH) -> DataFrame:
    """node, degree / (n - 1)."""
    d = degrees(edges, keys)
    n = d.groupBy(*keys).agg(F.count("*").alias("n"))
    return d.join(F.broadcast(n), list(keys)).select(*keys, "node", F.round(ratio(F.col("degree"), F.col("n") - 1), 6).alias("degree_centrality"))


def triangles(edges: DataFrame, keys: Sequence[str] = GRAPH) -> DataFrame:
    """node, number of triangles through it.

    Edges are turned from the lower degree to the higher, so a hub's many
    neighbours are never paired with each other: the wedges number at most m sqrt(m).
    """
    d = degrees(edges, keys).select(*keys, F.col("node"), "degree")
    with_d = edges.select(*keys, "src", "dst").join(d.withColumnsRenamed({"node": "src", "degree": "ds"}), [*keys, "src"]).join(d.withColumnsRenamed({"node": "dst", "degree": "dd"}), [*keys, "dst"])
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    turned = with_d.select(*keys, F.when(up, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("y"))
    wedges = turned.join(turned.withColumnRenamed("y", "z"), [*keys, "x"]).filter("y < z")
    closed = edges.select(*keys, F.least("src", "dst").alias("y"), F.greatest("src", "dst").alias("z"))
    found = wedges.join(closed, [*keys, "y", "z"])
    return found.select(*keys, F.explode(F.array("x", "y", "z")).alias("node")).groupBy(*keys, "node").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame, keys: Sequence[str] = GRAPH) -> DataFrame:
    """Average clustering coefficient over all nodes, those of degree below 2 counting 0."""
    d = degrees(edges, keys).select(*keys, "node", "degree")
    each = d.join(triangles(edges, keys), [*keys, "node"], "left").na.fill(0, ["triangles"])
    c = ratio(2 * F.col("triangles"), F.col("degree") * (F.col("degree") - 1))
    return each.groupBy(*keys).agg(F.round(F.avg(c), 6).alias("avg_clustering"))


def _least_reached(frame: pd.DataFrame) -> dict[str, str]:
    """Every node of an edge list and the least node it reaches, by union-find."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for u, v in zip(frame["src"], frame["dst"], strict=True):
        u, v = root(u), root(v)
        if u != v:
            parent[max(u, v)] = min(u, v)
    return {x: root(x) for x in list(parent)}


def components(edges: DataFrame, keys: Sequence[str] = GRAPH, every: int = 2, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """node, component: the least node it reaches.

    Up to ``one_task`` edges in all, a task per graph merges them. Beyond that, labels hop to the least neighbour's and are
    then followed once more, until nothing changes. Both give the same table.
    """
    keys = list(keys)
    edges = cut(edges.select(*keys, "src", "dst"))
    if edges.count() <= one_task:
        kinds = dict(edges.dtypes)

        def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(*key, *pair) for pair in _least_reached(frame).items()], columns=[*keys, "node", "component"])

        return edges.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "node string, component string"]))
    ends = both_ways(edges.withColumn("weight", F.lit(1)), keys).select(*keys, "u", "v")
    labels = cut(ends.groupBy(*keys, F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    turn = 0
    while True:
        near = ends.join(labels.select(*keys, F.col("node").alias("v"), F.col("label").alias("l")), [*keys, "v"]).groupBy(*keys, F.col("u").alias("node")).agg(F.min("l").alias("l"))
        hop = labels.join(near, [*keys, "node"]).select(*keys, "node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = hop.join(labels.select(*keys, F.col("node").alias("label"), F.col("label").alias("further")), [*keys, "label"], "left")
        after = jump.select(*keys, "node", "old", F.least("label", "further").alias("label"))
        turn += 1
        after = cut(after) if turn % every == 0 or turn == 1 else after
        if turn % every == 0 or turn == 1:
            if not after.filter("label <> old").limit(1).count():
                return after.select(*keys, "node", F.col("label").alias("component"))
        labels = after.select(*keys, "node", "label")


def largest_component(found: DataFrame, keys: Sequence[str] = GRAPH) -> DataFrame:
    """Keys, component and size of the largest component (ties: least name), and whether the graph is connected."""
    sizes = found.groupBy(*keys, "component").agg(F.count("*").alias("n"))
    best = sizes.groupBy(*keys).agg(F.max(F.struct("n")).alias("m"), F.count("*").alias("parts"), F.max("n").alias("size"))
    top = sizes.join(best, list(keys)).filter(F.col("n") == F.col("size"))
    return top.groupBy(*keys, "size", "parts").agg(F.min("component").alias("component")).select(*keys, "component", "size", (F.col("parts") == 1).alias("is_connected"))


def hop_distances(edges: DataFrame, sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """source, node, hops for every node that a source reaches, by one breadth-first search for all sources.

    A round joins the frontier only; nodes already seen are dropped by anti-join. The edges and each round are written once, to their own folders.
    """
    keys = list(keys)
    ends = kept(both_ways(edges.withColumn("weight", F.lit(1)) if "weight" not in edges.columns else edges, keys).select(*keys, "u", "v").distinct(), "ends")
    present = ends.select(*keys, F.col("u").alias("source")).distinct()
    seen = kept(sources.select(*keys, "source").distinct().join(present, [*keys, "source"]).select(*keys, "source", F.col("source").alias("node"), F.lit(0).alias("hops")))
    frontier, k = seen, 0
    while not frontier.isEmpty():
        k += 1
        step = frontier.select(*keys, "source", F.col("node").alias("u")).join(ends, [*keys, "u"]).select(*keys, "source", F.col("v").alias("node")).distinct()
        frontier = kept(step.join(seen, [*keys, "source", "node"], "left_anti").withColumn("hops", F.lit(k)))
        seen = seen.unionByName(frontier)
    return seen


def mean_hops(distances: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean hops from each source to each group of targets; itself and what it cannot reach do not count."""
    met = distances.filter("hops > 0").join(targets, "node")
    return met.groupBy(*keys, "source", "target_group").agg(F.round(F.avg("hops"), 6).alias("avg_hops"), F.count("*").alias("n_reached"))


def target_groups(meta: DataFrame) -> DataFrame:
    """node, target_group: members of either party, and the gun group."""
    parties = meta.filter("party in ('dem', 'rep')").select("node", F.col("party").alias("target_group"))
    return parties.unionByName(meta.filter("gun = 1").select("node", F.lit("gun").alias("target_group")))


def covered(panel: DataFrame, starts: dict[str, int], first: int, last: int) -> DataFrame:
    """Rows of a distance panel from each source's start year on, for sources of which some group has every year to ``last``."""
    start = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in starts.items() for x in pair)), F.col("source")), F.lit(first)) if starts else F.lit(first)
    kept = panel.withColumn("start", start).filter(F.col("yr").between(F.col("start"), F.lit(last)))
    whole = kept.groupBy("source", "target_group", "start").agg(F.count_distinct("yr").alias("n")).filter(F.col("n") == F.lit(last) - F.col("start") + 1).select("source").distinct()
    return kept.join(whole, "source", "left_semi").drop("start")


def weight_summary(edges: DataFrame, keys: Sequence[str] = GRAPH) -> DataFrame:
    """Least, quartiles, median and greatest edge weight."""
    per = edges.groupBy(*keys, "weight").agg(F.count("*").alias("c"))  # weights are counts: few distinct ones, each with its frequency
    q = F.percentile("weight", F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))), F.col("c"))
    return per.groupBy(*keys).agg(q.alias("q")).select(*keys, *(F.round(F.col("q")[k], 6).alias(name) for k, name in enumerate(("least", "q1", "median_weight", "q3", "most"))))


def weight_density(edges: DataFrame, least: float, most: float, points: int, keys: Sequence[str] = GRAPH) -> DataFrame:
    """x, density: a Gaussian kernel estimate of the weights at evenly spaced points, its width by Scott's rule.

    Equal weights are counted first, so a point meets each distinct weight once. Graphs whose weights are all equal have no row.
    """
    per = edges.groupBy(*keys, F.col("weight").cast("double").alias("w")).agg(F.count("*").alias("c"))
    size = edges.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_samp("weight").alias("sd")).filter("sd > 0")
    step = (most - least) / max(1, points - 1)
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.lit(float(least)) + k * F.lit(step))).alias("x")
    width = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    z = (F.col("x") - F.col("w")) / width
    term = F.col("c") * F.exp(-z * z / 2) / (F.col("n") * width * F.lit(math.sqrt(2 * math.pi)))
    return per.join(size, list(keys)).select("*", at).groupBy(*keys, "x").agg(F.round(F.sum(term), 6).alias("density"))


def box(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Least, quartiles and greatest of a value per group, nulls and NaN left out."""
    q = F.percentile(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")), F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))))
    return rows.groupBy(*by).agg(q.alias("q")).select(*by, *(F.round(F.col("q")[k], 6).alias(name) for k, name in enumerate(("least", "q1", "median", "q3", "most"))))


def weight_histogram(edges: DataFrame, least: float, most: float, bins: int, keys: Sequence[str] = GRAPH) -> DataFrame:
    """Edges per weight bin; bin 0 and bin n + 1 hold what lies outside."""
    return edges.select(*keys, F.width_bucket("weight", F.lit(float(least)), F.lit(float(most)), F.lit(bins)).alias("bin")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def static_record(edges: DataFrame, calendar: DataFrame | None = None, with_modularity: bool = True) -> DataFrame:
    """One row per method and snapshot with all static metrics; steps of the calendar without edges get zeros and nulls."""
    from .louvain import louvain
    from .paths import distance_metrics, path_summary
    from .quality import modularity
    from .spectral import eigenvector

    distances = kept(distance_metrics(edges))
    means = distances.groupBy(*GRAPH).agg(F.round(F.avg("betweenness"), 6).alias("avg_betweenness"), F.round(F.avg("closeness"), 6).alias("avg_closeness"))
    eigen = eigenvector(edges).groupBy(*GRAPH).agg(F.round(F.avg("eigenvector"), 6).alias("avg_eigenvector"))
    degree = degree_centrality(edges).groupBy(*GRAPH).agg(F.round(F.avg("degree_centrality"), 6).alias("avg_degree"))
    linked = distances.groupBy(*GRAPH).agg(F.bool_and("in_largest").alias("is_connected"))
    record = counts(edges)
    parts = [clustering(edges), path_summary(distances), means, eigen, degree, linked]
    for part in [*parts, modularity(edges, louvain(edges))] if with_modularity else parts:
        record = record.join(part, GRAPH, "left")
    if calendar is not None:
        record = edges.select("method").distinct().join(F.broadcast(calendar.select("snapshot").distinct())).join(record, GRAPH, "left")
    return record.na.fill(0, ["num_nodes", "num_edges"]).na.fill(False, ["is_connected"])
