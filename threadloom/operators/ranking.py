"""Ranking metrics of scored, labelled pairs, per group of key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut


LEVELS = 1024


def _level(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with ``_l``, an equal step of their group's range of scores, from the highest down: groups are summed and numbered by step."""
    ends = rows.groupBy(*keys).agg(F.min("score").alias("_low"), F.max("score").alias("_high"))
    share = F.coalesce(F.try_divide(F.col("_high") - F.col("score"), F.col("_high") - F.col("_low")), F.lit(0.0))
    return rows.join(ends, list(keys)).withColumn("_l", F.floor(share * (LEVELS - 1)).cast("int")).drop("_low", "_high")


def _by_score(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per distinct score: positives and negatives there, and running totals from the highest score down.

    Totals run within a step, and over the steps, so a group's scores are not sorted in one task. The sums per score are
    checkpointed, so what makes the rows runs once.
    """
    per = _level(cut(rows.groupBy(*keys, "score").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))), keys)
    steps = per.groupBy(*keys, "_l").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    above = Window.partitionBy(*keys).orderBy("_l").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumns({c: F.coalesce(F.sum(c).over(above), F.lit(0)) for c in ("_p", "_n")})
    down = Window.partitionBy(*keys, "_l").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = per.join(steps, [*keys, "_l"])
    return placed.withColumns({"tp": F.col("_p") + F.sum("p").over(down), "fp": F.col("_n") + F.sum("n").over(down)}).drop("_l", "_p", "_n")


def _auc(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    won = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    return steps.groupBy(*keys).agg(F.round(F.try_divide(won, F.sum("p") * F.sum("n")), 6).alias("auc"))


def _average_precision(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    area = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return steps.groupBy(*keys).agg(F.round(F.try_divide(area, F.sum("p")), 6).alias("ap"))


def auc(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the ROC curve; ties count half. Null without both labels."""
    return _auc(_by_score(rows, keys), keys)


def average_precision(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Step-wise mean of precision over recall, at distinct scores. Null without positives."""
    return _average_precision(_by_score(rows, keys), keys)


def at_k(rows: DataFrame, keys: Sequence[str], ks: Sequence[int] = (50, 100)) -> DataFrame:
    """Precision and recall among the k highest scores, ties by u, v and label (a sampled negative may also be a test edge); k is at most the number of rows."""
    rows = cut(rows.select(*keys, "u", "v", "label", "score"))
    stepped = _level(rows, keys)
    steps = stepped.groupBy(*keys, "_l").agg(F.count("*").alias("_c"))
    above = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_l").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.withColumn("_above", above).filter(F.col("_above") < max(ks)).drop("_c")
    place = F.row_number().over(Window.partitionBy(*keys, "_l").orderBy(F.col("score").desc(), "u", "v", "label"))
    placed = stepped.join(steps, [*keys, "_l"]).withColumn("place", place + F.col("_above"))
    sums = [F.sum(F.when(F.col("place") <= k, F.col("label")).otherwise(0)).alias(f"hit_{k}") for k in ks]
    total = placed.groupBy(*keys).agg(*sums).join(rows.groupBy(*keys).agg(F.sum("label").alias("pos"), F.count("*").alias("rows")), list(keys))
    out = []
    for k in ks:
        out.append(F.round(F.col(f"hit_{k}") / F.least(F.lit(k), "rows"), 6).alias(f"p_at_{k}"))
        out.append(F.round(F.coalesce(F.try_divide(F.col(f"hit_{k}").cast("double"), "pos"), F.lit(0.0)), 6).alias(f"r_at_{k}"))
    return total.select(*keys, *out)


def evaluate(rows: DataFrame, keys: Sequence[str], ks: Sequence[int] = (50, 100)) -> DataFrame:
    """All ranking metrics side by side."""
    rows = cut(rows.select(*keys, "u", "v", "label", "score"))
    steps = cut(_by_score(rows, keys))
    return _auc(steps, keys).join(_average_precision(steps, keys), list(keys)).join(at_k(rows, keys, ks), list(keys))


def mean_and_deviation(rows: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean and sample standard deviation of each value per group."""
    return rows.groupBy(*by).agg(*(f(v).alias(f"{name}_{v}") for v in values for name, f in (("mean", F.avg), ("std", F.stddev_samp))))
