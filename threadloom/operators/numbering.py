"""Nodes as numbers: iterative plans join and group pairs of longs instead of names and graph keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import kept
from .edges import GRAPH


class Numbered:
    """The graphs of an edge table with numbered nodes.

    ``nodes``: keys, node, g (the graph's number), id (unique over all graphs, ascending with the node's name in each);
    ``adjacency``: g, u, v, w in both directions, parallel edges merged by ``merge``. Both are kept in the shared folder.
    """

    def __init__(self, edges: DataFrame, keys: Sequence[str] = GRAPH, merge=F.sum):
        self.keys = list(keys)
        weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
        rows = kept(edges.select(*self.keys, "src", "dst", weight.alias("w")))
        graphs = kept(rows.select(*self.keys).distinct().withColumn("g", F.monotonically_increasing_id()))
        same = [F.col(f"e.{k}").eqNullSafe(F.col(f"g.{k}")) for k in self.keys]
        placed = rows.alias("e").join(F.broadcast(graphs).alias("g"), same).select("g.g", "src", "dst", "w")
        ends = placed.select("g", F.explode(F.array("src", "dst")).alias("node")).distinct()
        found = kept(ends.repartitionByRange("g", "node").sortWithinPartitions("g", "node").withColumn("id", F.monotonically_increasing_id()))
        self.graphs = graphs
        self.ids = found
        self.nodes = found.join(F.broadcast(graphs), "g").select(*self.keys, "node", "g", "id")
        a, b = (found.select("g", F.col("node").alias(c), F.col("id").alias(x)) for c, x in (("src", "u"), ("dst", "v")))
        lines = placed.join(a, ["g", "src"]).join(b, ["g", "dst"]).select("g", "u", "v", "w").filter("u <> v")
        both = lines.select("g", F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"), "w")
        self.adjacency = kept(both.groupBy("g", "e.u", "e.v").agg(merge("w").alias("w")))

    def named(self, rows: DataFrame, *columns: Column | str) -> DataFrame:
        """keys, node and ``columns`` of rows by ``id``, for every node; nulls where a node has none."""
        return self.nodes.join(rows, "id", "left").select(*self.keys, "node", *columns)
