"""Node embeddings by random walks, and edge scores by cosine.

Walkers are rows that move by joins, so no task holds a graph. A node's edges become numbered slots, an edge of weight w
taking w over the node's mean weight of them, rounded up; a walker joins one slot of its node, drawn evenly, and
takes it with the chance that the rounding left over (at least a half on average), times that of the second-order
bias: 1 / p back to where it came from, 1 to its neighbours, 1 / q elsewhere, over the greatest of these. A walker whose draw is
rejected stays and draws again in the next round. Draws are hashes of walker, round and seed, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cosine
from ..functions.lineage import cut, kept
from . import links, ranking
from .edges import GRAPH
from .numbering import Numbered

DIM, LENGTH, WALKS, WINDOW, EPOCHS = 64, 30, 200, 10, 5
#: Rounds of all walkers between two writings; partitions that a model is fitted on.
ROUNDS_PER_WRITE, FIT_PARTS = 8, 4
_UNIT = float(1 << 53)


def slots(adjacency: DataFrame) -> DataFrame:
    """u, slot, v, chance, free: of every node's numbered slots the neighbour, the chance to take it, and the neighbour's number of slots."""
    mean = adjacency.groupBy("u").agg(F.avg("w").alias("mean"))
    edges = adjacency.join(mean, "u").withColumn("k", F.ceil(F.col("w") / F.col("mean")).cast("long"))
    size = edges.groupBy(F.col("u").alias("v")).agg(F.sum("k").alias("free"))
    before = F.sum("k").over(Window.partitionBy("u").orderBy("v")) - F.col("k")
    placed = edges.withColumn("first", before).join(size, "v")
    return placed.select("u", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("k") - 1)).alias("slot"), "v", (F.col("w") / (F.col("k") * F.col("mean"))).alias("chance"), "free")


def _draw(*what: Column | str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*what), 11)


def random_walks(edges: DataFrame, length: int = LENGTH, walks: int = WALKS, seed: int = 42, keys: Sequence[str] = GRAPH, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """keys, walk: weighted second-order walks from every node; p is the return parameter, q the in-out parameter."""
    graph = Numbered(edges, keys)
    table = kept(slots(graph.adjacency), "slots")
    start = table.groupBy("u").agg(F.count("*").alias("free"))
    begun = start.select("u", "free", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("nth"))
    state = kept(begun.select(F.col("u").alias("start"), "nth", F.col("u").alias("at"), F.lit(None).cast("long").alias("came"), "free", F.array("u").alias("path")), "walkers")
    joined = table.withColumnsRenamed({"u": "at", "free": "ahead"})
    linked = graph.adjacency.select(F.col("u").alias("came"), "v", F.lit(True).alias("near"))
    most = max(1 / p, 1.0, 1 / q)
    turn, going, done = 0, state, []
    while not going.isEmpty():
        for _ in range(ROUNDS_PER_WRITE):
            who = ("start", "nth", F.lit(turn), F.lit(seed))
            draws = going.withColumn("slot", F.pmod(F.xxhash64(*who), F.col("free"))).join(joined, ["at", "slot"])
            chance = F.col("chance")
            if p != 1 or q != 1:
                draws = draws.join(linked, ["came", "v"], "left")
                bias = F.when(F.col("came").isNull(), most).when(F.col("v") == F.col("came"), 1 / p).when(F.col("near"), 1.0).otherwise(1 / q)
                chance = chance * bias / most
            takes = (_draw(*who, F.lit("takes")) / _UNIT < chance) & (F.size("path") < length)
            moved = lambda new, old, takes=takes: F.when(takes, F.col(new)).otherwise(F.col(old))
            going = draws.select("start", "nth", moved("v", "at").alias("at"), moved("at", "came").alias("came"), moved("ahead", "free").alias("free"), F.when(takes, F.concat("path", F.array("v"))).otherwise(F.col("path")).alias("path"))
            turn += 1
        written = kept(going, "walkers")
        going = written.filter(F.size("path") < length)
        done.append(written.filter(F.size("path") >= length).select("start", "nth", "path"))
    whole = done[0] if done else state.select("start", "nth", "path")
    for part in done[1:]:
        whole = whole.unionByName(part)
    steps = whole.select("start", "nth", F.posexplode("path").alias("k", "id")).join(graph.nodes.select(*graph.keys, "id", "node"), "id")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("k", "node"))), lambda x: x["node"])
    return steps.groupBy(*graph.keys, "start", "nth").agg(ordered.alias("walk")).select(*graph.keys, "walk")


def embed(walks: DataFrame, dim: int = DIM, window: int = WINDOW, seed: int = 42, epochs: int = EPOCHS) -> DataFrame:
    """node, vector: skip-gram embeddings of one graph's walks, in so many passes over them, fitted on several partitions."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=dim, windowSize=window, minCount=1, seed=seed, maxIter=epochs, numPartitions=FIT_PARTS, inputCol="walk", outputCol="out").fit(walks)
    return model.getVectors().select(F.col("word").alias("node"), vector_to_array("vector").alias("vector"))


def pair_cosine(pairs: DataFrame, vectors: DataFrame, name: str = "score") -> DataFrame:
    """Cosine of u's and v's vectors, 0 where either has none."""
    a, b = (vectors.select(F.col("node").alias(c), F.col("vector").alias(f"_{c}")) for c in "uv")
    return pairs.join(a, "u", "left").join(b, "v", "left").select(*pairs.columns, cosine(F.col("_u"), F.col("_v")).alias(name))


def temporal_evaluation(train: DataFrame, tests: DataFrame, wanted: DataFrame, samplers: Sequence[str] = ("uniform", "distance2"), keys: Sequence[str] = links.KEYS, **walking: int) -> DataFrame:
    """keys, sampler and ranking metrics of every train graph under ``keys``, each embedded by its own walks.

    One skip-gram model is fitted per train graph, in turn; its vectors score the pairs of all samplers.
    """
    keys = list(keys)
    walks = cut(random_walks(train, keys=keys, **walking))
    negatives = {name: cut(links.SAMPLERS[name](train, wanted)) for name in samplers}
    scored = None
    for fold in sorted(train.select(*keys).distinct().collect()):
        same = F.lit(True)
        for k in keys:
            same &= F.col(k) == fold[k]
        one = lambda d, same=same: d.filter(same)
        vectors = embed(one(walks))
        for name, pairs in negatives.items():
            rows = links.labelled_pairs(one(tests), one(pairs), keys).withColumn("sampler", F.lit(name))
            part = pair_cosine(rows, vectors)
            scored = part if scored is None else scored.unionByName(part)
    return ranking.evaluate(cut(scored), [*keys, "sampler"])
