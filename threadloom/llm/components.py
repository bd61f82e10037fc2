"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Kept

#: Edges that one task may hold at once.
ONE_TASK_EDGES = 1_000_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges run from ``a`` to a smaller ``b``.

    Large: every node hands its least neighbour to its larger neighbours.
    Small: every node links itself and its smaller neighbours to the least.
    """
    seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    joined = seen.join(least, F.col("a") == F.col("n"))
    if large:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges and the least node it reaches, by union-find."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return nodes, nodes[[root(k) for k in range(len(nodes))]] if len(nodes) else nodes


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if tables:
        nodes, least = forest(*np.concatenate(tables, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(least, pa.int64())], names=["node", "component"])


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> Kept:
    """(node, component) for every node of an edge (a, b), the component being its least node.

    Up to ``one_task`` edges, 16 bytes each, are merged in a single task. Beyond
    that, pairs of star steps go on until nothing changes, their number growing
    with the logarithm of the longest path; each is written to the
    shared folder, so lost executors cost one step. Both ways give the same table.
    """
    now = Kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    found = now.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    if found["n"] <= one_task:
        done = Kept(now.df.coalesce(1).mapInArrow(_in_one_task, "node long, component long"), "components")
        now.drop()
        return done
    mark = None
    while (found["n"], found["h"]) != mark:
        mark = (found["n"], found["h"])
        after = Kept(_star(_star(now.df, True), False), "edges")
        now.drop()
        now = after
        found = now.df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    least = now.df.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    done = Kept(now.df.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(least), "components")
    now.drop()
    return done
