"""Quality of a partition: modularity, purity, normalised mutual information."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def modularity(edges: DataFrame, partition: DataFrame, keys: Sequence[str] = ("method", "snapshot")) -> DataFrame:
    """Weighted modularity of ``partition`` (node, cluster, and the keys if it depends on them).

    Nodes without a cluster are singletons. Graphs without edges have no row.
    """
    keys = list(keys)
    own = [k for k in keys if k in partition.columns]
    a, b = (partition.select(*own, F.col("node").alias(c), F.col("cluster").cast("string").alias(f"{c}_cluster")) for c in ("src", "dst"))
    placed = edges.join(a, [*own, "src"], "left").join(b, [*own, "dst"], "left")
    alone = lambda c: F.coalesce(F.concat(F.lit("c:"), f"{c}_cluster"), F.concat(F.lit("n:"), c))
    ends = placed.select(*keys, "weight", alone("src").alias("s"), alone("dst").alias("d"))
    inside = F.when(F.col("s") == F.col("d"), F.col("weight")).otherwise(0.0)
    halves = ends.select(*keys, F.explode(F.array(F.struct(F.col("s").alias("c"), F.col("weight").alias("k"), inside.alias("w")), F.struct(F.col("d").alias("c"), F.col("weight").alias("k"), F.lit(0.0).alias("w")))).alias("h"))
    clusters = halves.groupBy(*keys, "h.c").agg(F.sum("h.k").alias("k"), F.sum("h.w").alias("w"))
    sums = clusters.groupBy(*keys).agg((F.sum("k") / 2).alias("m"), F.sum("w").alias("w"), F.sum(F.col("k") * F.col("k")).alias("k2"))
    return sums.select(*keys, F.round(F.coalesce(F.try_divide("w", "m") - F.try_divide(F.col("k2"), 4 * F.col("m") * F.col("m")), F.lit(0.0)), 6).alias("modularity"))


def contingency(clusters: DataFrame, labels: DataFrame) -> DataFrame:
    """cluster, label, n over the nodes that have both."""
    return clusters.join(labels, "node").filter("cluster is not null and label is not null").groupBy(F.col("cluster").cast("string").alias("cluster"), F.col("label").cast("string").alias("label")).agg(F.count("*").alias("n"))


def purity(table: DataFrame) -> DataFrame:
    """Share of rows that hold their cluster's most frequent label."""
    best = table.groupBy("cluster").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return best.agg(F.round(F.coalesce(F.try_divide(F.sum("top").cast("double"), F.sum("n")), F.lit(0.0)), 6).alias("purity"))


def nmi(table: DataFrame) -> DataFrame:
    """Mutual information over the mean of both entropies; 1 if both are constant, 0 if only one is."""
    total = table.agg(F.sum("n").cast("double").alias("t"))
    rows = table.groupBy("cluster").agg(F.sum("n").alias("a"))
    cols = table.groupBy("label").agg(F.sum("n").alias("b"))
    full = table.join(rows, "cluster").join(cols, "label").join(F.broadcast(total))
    mi = full.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))
    entropy = lambda d, c, name: d.join(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("t") * F.log(F.col(c) / F.col("t")))).alias(name))
    all_ = mi.join(F.broadcast(entropy(rows, "a", "hu"))).join(F.broadcast(entropy(cols, "b", "hv")))
    mean = (F.col("hu") + F.col("hv")) / 2
    value = F.when(mean < 1e-12, 1.0).otherwise(F.greatest(F.lit(0.0), F.try_divide(F.col("mi"), mean)))
    return all_.select(F.round(value, 6).alias("nmi"))
