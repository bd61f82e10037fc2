"""Eigenvector centrality by power iteration: a sparse matrix-vector product is a join and an aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import kept
from .edges import GRAPH
from .graphs import components, largest_component
from .numbering import Numbered

def eigenvector(edges: DataFrame, keys: Sequence[str] = GRAPH, rounds: int = 1000, tolerance: float = 1e-3) -> DataFrame:
    """node, eigenvector centrality in the largest component; null elsewhere and without convergence in that many rounds.

    A round multiplies by I + A in every graph that goes on, until its vector's L1 change is below size * tolerance. The product is
    kept; a norm and a change per graph come to the driver, and graphs that are done leave the rounds.
    """
    keys = list(keys)
    graph = Numbered(edges, keys)
    found = components(edges, keys)
    top = largest_component(found, keys).select(*keys, "component", "size").filter("size > 1")
    inside = found.join(F.broadcast(top), [*keys, "component"]).select(*keys, "node", "size")
    x = kept(graph.nodes.join(inside, [*keys, "node"]).select("g", "id", (F.lit(1.0) / F.col("size")).alias("x"), "size"))
    core = kept(graph.adjacency.join(x.select(F.col("id").alias("u")), "u", "left_semi").select("g", "u", "v", "w"))
    left = {r[0] for r in x.select("g").distinct().collect()}
    done: list[DataFrame] = []
    for _ in range(rounds):
        if not left:
            break
        pushed = x.select("g", F.col("id").alias("u"), "x").join(core, ["g", "u"]).select("g", F.col("v").alias("id"), (F.col("w") * F.col("x")).alias("raw"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("long").alias("size"))
        stays = x.select("g", "id", F.col("x").alias("raw"), "x", F.col("size").cast("long").alias("size"))
        product = kept(stays.unionByName(pushed).groupBy("g", "id").agg(F.sum("raw").alias("raw"), F.max("x").alias("x"), F.max("size").alias("size")))
        norms = product.groupBy("g").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw")))).collect()
        scale = F.broadcast(x.sparkSession.createDataFrame([tuple(r) for r in norms], "g long, norm double"))
        unit = product.join(scale, "g").select("g", "id", (F.col("raw") / F.col("norm")).alias("new"), "x", "size")
        still = unit.groupBy("g").agg((F.sum(F.abs(F.col("new") - F.col("x"))) < F.max("size") * tolerance).alias("over")).filter("over").collect()
        x = unit.select("g", "id", F.col("new").alias("x"), "size")
        if still:
            over = [r["g"] for r in still]
            done.append(x.filter(F.col("g").isin(over)))
            x = x.filter(~F.col("g").isin(over))
            core = core.filter(~F.col("g").isin(over))
            left -= set(over)
    whole = done[0] if done else x.limit(0)
    for part in done[1:]:
        whole = whole.unionByName(part)
    return graph.named(whole, F.round("x", 6).alias("eigenvector"))
