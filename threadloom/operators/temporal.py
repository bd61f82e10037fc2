"""Change between consecutive snapshots: turnover, volatility, change of a metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio


def transitions(edges: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """method, t1, t2: consecutive pairs of the snapshots in the calendar, or of those that occur."""
    steps = edges.select("snapshot").distinct() if calendar is None else calendar.select("snapshot").distinct()
    methods = edges.select("method").distinct()
    nxt = F.lead("snapshot").over(Window.orderBy("snapshot"))
    pairs = steps.select(F.col("snapshot").alias("t1"), nxt.alias("t2")).filter("t2 is not null")
    return methods.join(F.broadcast(pairs))


def _sides(items: DataFrame, key: list[str], pairs: DataFrame) -> DataFrame:
    """For each transition, whether an item occurs before and after; each item is placed in its (at most) two transitions."""
    before = pairs.select("method", F.col("t1").alias("snapshot"), "t1", "t2", F.lit(1).alias("old"), F.lit(0).alias("new"))
    after = pairs.select("method", F.col("t2").alias("snapshot"), "t1", "t2", F.lit(0).alias("old"), F.lit(1).alias("new"))
    placed = items.join(F.broadcast(before.unionByName(after)), ["method", "snapshot"])
    return placed.groupBy("method", "t1", "t2", *key).agg(F.max("old").alias("old"), F.max("new").alias("new"))


def turnover(edges: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Per transition: Jaccard, turnover, appearing and disappearing counts of nodes and edges, volatility.

    Where both snapshots are empty, Jaccard, turnover and volatility are 0.
    """
    pairs = transitions(edges, calendar)
    n = edges.select("method", "snapshot", F.explode(F.array("src", "dst")).alias("a")).distinct().withColumn("b", F.lit(""))
    e = edges.select("method", "snapshot", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    items = n.withColumn("kind", F.lit("node")).unionByName(e.withColumn("kind", F.lit("edge")))
    sides = _sides(items, ["kind", "a", "b"], pairs).groupBy("method", "t1", "t2", "kind")
    counts = sides.agg(F.sum(F.col("old") * F.col("new")).alias("both"), F.count("*").alias("all"), F.sum("new").alias("now"), F.sum("old").alias("past"))
    wide = pairs.join(counts.filter("kind = 'node'").drop("kind").withColumnsRenamed({c: f"n_{c}" for c in ("both", "all", "now", "past")}), ["method", "t1", "t2"], "left")
    wide = wide.join(counts.filter("kind = 'edge'").drop("kind").withColumnsRenamed({c: f"e_{c}" for c in ("both", "all", "now", "past")}), ["method", "t1", "t2"], "left").na.fill(0)
    out = ["method", "t1", "t2"]
    for p, name in (("n", "node"), ("e", "edge")):
        both, union = F.col(f"{p}_both"), F.col(f"{p}_all")
        out += [
            F.round(ratio(both, union), 6).alias(f"{name}_jaccard"),
            F.round(ratio(union - both, union), 6).alias(f"{name}_turnover"),
            (F.col(f"{p}_now") - both).alias(f"appearing_{name}s"),
            (F.col(f"{p}_past") - both).alias(f"disappearing_{name}s"),
        ]
    volatility = F.when(F.col("e_all") == 0, 0.0).otherwise(1 - ratio(F.col("e_both"), F.col("e_all")))
    return wide.select(*out, F.round(volatility, 6).alias("volatility"))


def change(metrics: DataFrame, value: str, by: str = "method", at: str = "snapshot") -> DataFrame:
    """The metric at each step and the next, and the difference; null if either is missing."""
    w = Window.partitionBy(by).orderBy(at)
    pairs = metrics.select(by, F.col(at).alias("t1"), F.lead(at).over(w).alias("t2"), F.col(value).alias(f"{value}_t1"), F.lead(value).over(w).alias(f"{value}_t2")).filter("t2 is not null")
    return pairs.withColumn(f"{value}_change", F.round(F.col(f"{value}_t2") - F.col(f"{value}_t1"), 6))
