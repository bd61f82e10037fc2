"""Link prediction: negative samples and pair features over train graphs.

A train graph is a set of edges under keys (method and the snapshot tested).
Samplers return unordered pairs u < v that are not linked in train.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .edges import both_ways

KEYS = ["method", "test"]


def _absent(pairs: DataFrame, train: DataFrame, keys: Sequence[str]) -> DataFrame:
    linked = train.select(*keys, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    return pairs.join(linked, [*keys, "u", "v"], "left_anti")


def _wanted(pairs: DataFrame, n: DataFrame | int, keys: Sequence[str], bucket: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first n pairs of each graph by ``bucket`` and then ``order``; n is a number or a table of keys and n.

    Pairs are counted per bucket. Only buckets that begin before n are numbered, each by itself, so
    no task sorts all pairs of a graph.
    """
    names = [f"_b{k}" for k in range(len(bucket))]
    rows = pairs.withColumns({name: b for name, b in zip(names, bucket, strict=True)})
    sizes = rows.groupBy(*keys, *names).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before)
    sizes = sizes.withColumn("_n", F.lit(n)) if isinstance(n, int) else sizes.join(n.select(*keys, F.col("n").alias("_n")), list(keys))
    reached = sizes.filter("_before < _n").select(*keys, *names, "_before", "_n")
    place = F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order))
    return rows.join(reached, [*keys, *names]).withColumn("_place", place).filter(F.col("_place") + F.col("_before") <= F.col("_n")).select(*pairs.columns)


def _digest(seed: int, *columns: str) -> Column:
    """Looks random, is the same in every run and can be written in SQL."""
    return F.md5(F.concat_ws("|", *columns, F.lit(str(seed))))


def shuffled(pairs: DataFrame, n: DataFrame | int, seed: int, keys: Sequence[str], first: Sequence[Column] = ()) -> DataFrame:
    """The first n pairs of each graph by ``first`` and then in a hash order."""
    order = _digest(seed, "u", "v")
    return _wanted(pairs, n, keys, [*first, F.substring(order, 1, 2)], [order, F.col("u"), F.col("v")])


def common_neighbours(train: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """u < v with shared neighbours: their number and the Adamic-Adar sum over those of degree over 1."""
    ends = both_ways(train, keys)
    degree = ends.groupBy(*keys, "u").agg(F.count("*").alias("d"))
    mid = ends.join(degree, [*keys, "u"])
    a = mid.select(*keys, F.col("u").alias("w"), F.col("v").alias("u"), "d")
    b = ends.select(*keys, F.col("u").alias("w"), "v")
    share = F.when(F.col("d") > 1, 1 / F.log(F.col("d").cast("double")))
    return a.join(b, [*keys, "w"]).filter("u < v").groupBy(*keys, "u", "v").agg(F.count("*").alias("cn"), F.coalesce(F.sum(share), F.lit(0.0)).alias("aa"))


#: A prime above the number of nodes of any graph, so that it divides no number of pairs.
_STRIDE = 2**31 - 1
_CHUNK = 1 << 16


def _numbered(train: DataFrame, seed: int, keys: Sequence[str]) -> DataFrame:
    """u and its number i in a hash order of its graph's nodes, from 0."""
    order = _digest(seed, "u")
    rows = train.select(*keys, F.explode(F.array("src", "dst")).alias("u")).distinct().withColumns({"_d": order, "_b": F.substring(order, 1, 2)})
    sizes = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_d", "u")) - 1
    return rows.withColumn("_place", place).join(sizes.withColumn("_before", before).drop("_c"), [*keys, "_b"]).select(*keys, "u", (F.col("_place") + F.col("_before")).alias("i"))


def uniform(train: DataFrame, n: DataFrame | int, seed: int = 42, keys: Sequence[str] = KEYS, without: DataFrame | None = None) -> DataFrame:
    """n pairs of each graph that are not linked, nor among ``without`` (unlinked pairs u < v), or all if there are fewer.

    A graph's nodes are numbered in a hash order and its T pairs by t: the pair t joins node t mod N with
    the one t div N + 1 places further round. Pairs are visited at t = x * stride mod T, which meets each once. Among the first n + m pairs, m
    being those to be left out, n must be good; so no more are made, whatever the number of nodes.
    """
    keys = list(keys)
    nodes = cut(_numbered(train, seed, keys))
    barred = train.select(*keys, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    if without is not None:
        barred = barred.unionByName(without.select(*keys, "u", "v"))
    graphs = nodes.groupBy(*keys).agg(F.count("*").alias("size")).join(barred.groupBy(*keys).agg(F.count("*").alias("m")), keys)
    graphs = graphs.withColumn("n", F.lit(n)) if isinstance(n, int) else graphs.join(n.select(*keys, "n"), keys)
    graphs = graphs.withColumn("pairs", F.expr("size * (size - 1) div 2")).withColumn("draws", F.least("pairs", F.col("n") + F.col("m"))).filter("draws > 0")
    chunks = graphs.withColumn("from", F.explode(F.expr(f"sequence(0L, draws - 1, {_CHUNK}L)"))).repartition(*keys, "from")
    drawn = chunks.withColumn("x", F.explode(F.expr(f"sequence(from, least(from + {_CHUNK}L, draws) - 1)"))).withColumn("t", F.expr(f"x * {_STRIDE}L % pairs"))
    ends = drawn.select(*keys, "x", F.expr("t % size").alias("a"), F.expr("(t % size + t div size + 1) % size").alias("b"))
    named = ends.join(nodes.select(*keys, F.col("i").alias("a"), F.col("u").alias("p")), [*keys, "a"]).join(nodes.select(*keys, F.col("i").alias("b"), F.col("u").alias("q")), [*keys, "b"])
    pairs = named.select(*keys, F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"), "x")
    good = pairs.join(barred, [*keys, "u", "v"], "left_anti")
    return _wanted(good, n, keys, [F.expr(f"x div {_CHUNK}")], [F.col("x")]).select(*keys, "u", "v")


def distance_two(train: DataFrame, n: DataFrame | int, seed: int = 42, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs that are not linked but share a neighbour."""
    return shuffled(_absent(common_neighbours(train, keys).select(*keys, "u", "v"), train, keys), n, seed, keys)


def hard(train: DataFrame, n: DataFrame | int, seed: int = 42, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs that are not linked, those with most common neighbours first, equal ones in a hash order.

    Only pairs that share a neighbour are counted; a graph with too few of them is filled up with a uniform sample of the others.
    """
    keys = list(keys)
    sharing = cut(_absent(common_neighbours(train, keys).select(*keys, "u", "v", "cn"), train, keys))
    graphs = train.select(*keys).distinct()
    graphs = graphs.withColumn("n", F.lit(n)) if isinstance(n, int) else graphs.join(n.select(*keys, "n"), keys)
    have = sharing.groupBy(*keys).agg(F.count("*").alias("c"))
    lacking = graphs.join(have, keys, "left").select(*keys, (F.col("n") - F.coalesce("c", F.lit(0))).alias("n")).filter("n > 0")
    best = shuffled(sharing, n, seed, keys, [-F.col("cn")]).select(*keys, "u", "v")
    return best.unionByName(uniform(train, lacking, seed, keys, sharing))


SAMPLERS: dict[str, Callable[..., DataFrame]] = {"uniform": uniform, "distance2": distance_two, "hard": hard}


def features(pairs: DataFrame, train: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """cn, jaccard, aa and preferential attachment of given pairs; missing nodes have no neighbours.

    Only pairs asked for are counted: the neighbours of the end with fewer of them are looked up among those of the other, so hubs are not listed.
    """
    ends = both_ways(train, keys)
    degree = ends.groupBy(*keys, "u").agg(F.count("*").alias("d"))
    du, dv = degree.select(*keys, "u", F.col("d").alias("du")), degree.select(*keys, F.col("u").alias("v"), F.col("d").alias("dv"))
    asked = pairs.select(*keys, "u", "v").distinct().join(du, [*keys, "u"]).join(dv, [*keys, "v"])
    first = F.col("du") <= F.col("dv")
    turned = asked.select(*keys, "u", "v", F.when(first, F.col("u")).otherwise(F.col("v")).alias("few"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("many"))
    left = turned.join(ends.select(*keys, F.col("u").alias("few"), F.col("v").alias("w")), [*keys, "few"])
    met = left.join(ends.select(*keys, F.col("u").alias("many"), F.col("v").alias("w")), [*keys, "many", "w"])
    met = met.join(degree.select(*keys, F.col("u").alias("w"), "d"), [*keys, "w"])
    share = F.when(F.col("d") > 1, 1 / F.log(F.col("d").cast("double")))
    sums = met.groupBy(*keys, "u", "v").agg(F.count("*").alias("cn"), F.sum(share).alias("aa"))
    full = pairs.join(sums, [*keys, "u", "v"], "left").join(du, [*keys, "u"], "left").join(dv, [*keys, "v"], "left").na.fill(0, ["cn", "du", "dv"]).na.fill(0.0, ["aa"])
    union = F.col("du") + F.col("dv") - F.col("cn")
    return full.select(*pairs.columns, "cn", F.coalesce(F.try_divide(F.col("cn").cast("double"), union), F.lit(0.0)).alias("jaccard"), "aa", (F.col("du") * F.col("dv")).alias("pa"))


def labelled_pairs(tests: DataFrame, negatives: DataFrame, keys: Sequence[str] = KEYS, new_only: DataFrame | None = None) -> DataFrame:
    """Positives (label 1) from the test edges and negatives (0), as u < v; with ``new_only``, a train graph, only edges that it lacks."""
    if new_only is not None:
        tests = tests.join(new_only.select(*keys, "src", "dst"), [*keys, "src", "dst"], "left_anti")
    yes = tests.select(*keys, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.lit(1).alias("label"))
    return yes.unionByName(negatives.select(*keys, "u", "v", F.lit(0).alias("label")))


def training_rows(train: DataFrame, seed: int = 43, keys: Sequence[str] = KEYS) -> DataFrame:
    """Labelled pairs with features to fit on: every train edge, and as many uniform negatives of the same train graph.

    The seed is not that of the samplers' default, so the pairs tested are not drawn in the same order.
    """
    wanted = train.groupBy(*keys).agg(F.count("*").alias("n"))
    return features(labelled_pairs(train, uniform(train, wanted, seed, keys), keys), train, keys)


def logistic_scores(train_rows: DataFrame, rows: DataFrame, keys: Sequence[str] = KEYS, columns: Sequence[str] = ("cn", "jaccard", "aa", "pa"), c: float = 1.0, rounds: int = 100) -> DataFrame:
    """Probability of label 1 by L2 logistic regression over unscaled features, one model per ``keys``; column ``score``.

    Newton steps with halving: a round is one aggregation for the models of all keys, solved on the driver, which
    holds a few numbers per key. The rows to fit on are checkpointed. A key whose rows have one label only scores that label.
    """
    keys, size = list(keys), len(columns) + 1
    spark = train_rows.sparkSession
    train_rows = cut(train_rows)
    kinds = dict(train_rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "w array<double>"])
    stats = train_rows.groupBy(*keys).agg(F.avg("label").alias("y"), F.count("*").alias("n"), *(F.max(F.abs(x)).cast("double").alias(f"top_{x}") for x in columns)).collect()
    key = lambda r: tuple(r[k] for k in keys)
    fixed = {key(r): float(r["y"]) for r in stats if r["y"] in (0, 1)}
    # Columns are divided by their greatest value for the arithmetic only; the penalty is on the weights of the unscaled ones.
    scale = {key(r): np.array([r[f"top_{x}"] or 1.0 for x in columns] + [1.0]) for r in stats if r["y"] not in (0, 1)}
    penalty = {k: np.append(1 / (c * v[:-1] ** 2), 0.0) for k, v in scale.items()}
    at = {k: np.zeros(size) for k in scale}
    best: dict[tuple, tuple] = {}
    live = set(scale)
    x = [F.col(n).cast("double") for n in columns] + [F.lit(1.0)]

    def table(w: dict[tuple, np.ndarray]) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(*k, [float(z) for z in v]) for k, v in w.items()], schema))

    def margin() -> Column:
        return sum((v * F.col("w")[i] for i, v in enumerate(x)), F.lit(0.0))

    chance = lambda m: 1 / (1 + F.exp(-m))
    corner = [(i, j) for i in range(size) for j in range(i, size)]
    for _ in range(rounds):
        if not live:
            break
        m = train_rows.join(table({k: at[k] / scale[k] for k in live}), keys).withColumn("m", margin()).withColumn("p", chance(F.col("m")))
        loss = F.sum(F.greatest("m", F.lit(0.0)) + F.log1p(F.exp(-F.abs("m"))) - F.col("label") * F.col("m")).alias("loss")
        slope = [F.sum((F.col("p") - F.col("label")) * x[i]).alias(f"g{i}") for i in range(size)]
        bend = [F.sum(F.col("p") * (1 - F.col("p")) * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in corner]
        for r in m.groupBy(*keys).agg(loss, *slope, *bend).collect():
            k = key(r)
            total = r["loss"] + 0.5 * float(penalty[k] @ at[k] ** 2)
            if k in best and not total <= best[k][0] + 1e-12 * abs(best[k][0]):
                _, start, step = best[k]
                best[k] = (best[k][0], start, step / 2)
                at[k] = start + step / 2
                if np.abs(step).max() < 1e-10:
                    at[k] = start
                    live.discard(k)
                continue
            g = np.array([r[f"g{i}"] for i in range(size)]) / scale[k] + penalty[k] * at[k]
            h = np.diag(penalty[k])
            for i, j in corner:
                h[i, j] += r[f"h{i}_{j}"] / (scale[k][i] * scale[k][j])
                h[j, i] = h[i, j]
            step = -np.linalg.lstsq(h, g, rcond=None)[0]
            best[k] = (total, at[k], step)
            if np.abs(g).max() < 1e-6 or np.abs(step).max() < 1e-10:
                live.discard(k)
            else:
                at[k] = at[k] + step
    weights = {k: (best[k][1] if k in live else at[k]) / scale[k] for k in scale} | {k: np.array([0.0] * (size - 1) + [np.inf if y else -np.inf]) for k, y in fixed.items()}
    return rows.join(table(weights), keys, "left").withColumn("score", chance(margin())).select(*rows.columns, "score")
