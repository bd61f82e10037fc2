"""Louvain communities as DataFrame rounds: local moving, contraction, and again.

In a round every node sums its links to the clusters around it and finds the one with the
greatest gain in modularity; a third of the nodes, chosen anew each round by a hash of node and round, move there. All of them see
the clusters as they were, and since two neighbours seldom are awake together they seldom swap places. After a few such rounds a
move is made only if it is the best of all that leave or enter either of its two clusters: such moves do not disturb each other, so modularity rises by
the sum of their gains. When no node gains by moving, or after a fixed number of rounds, clusters become
nodes (a group-by over the edges) and the rounds start over, until nothing moves. A further cycle starts from the nodes again, in the
clusters found, which mends early moves. Several trials of every graph, under other hashes, run as more rows of the same
rounds; each graph keeps its best trial. No graph is in one task, and nothing but counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import kept
from .edges import GRAPH
from .numbering import Numbered

#: Of so many nodes one is awake in a free round; free rounds of a level, and rounds after them whose moves cannot disturb each other.
CLASSES, FREE_ROUNDS, CAREFUL_ROUNDS = 3, 9, 3
#: A gain in modularity that counts.
LEAST_GAIN = 1e-12


def _move(state: DataFrame, links: DataFrame, free: bool) -> DataFrame:
    """One round. ``state``: g, u, c (cluster), k (strength), m (the graph's total strength), turn, wants (whether it would gain by moving)."""
    total = state.groupBy("c").agg(F.sum("k").alias("total"))
    placed = state.join(total, "c")
    own = placed.select("u", "c", "total", F.lit(0.0).alias("w"))
    near = links.join(placed.select(F.col("u").alias("v"), "c", "total"), "v").select("u", "c", "total", "w").unionByName(own)
    choice = near.groupBy("u", "c").agg(F.sum("w").alias("l"), F.first("total").alias("total")).join(state.select("u", F.col("c").alias("home"), "k", "m"), "u")
    stays = F.col("c") == F.col("home")
    gain = F.col("l") * F.col("m") - F.col("k") * (F.col("total") - F.when(stays, F.col("k")).otherwise(0.0))
    best = choice.select("u", "c", stays.alias("stays"), gain.alias("gain")).groupBy("u").agg(
        F.max(F.when(~F.col("stays"), F.struct("gain", (-F.col("c")).alias("c")))).alias("best"), F.max(F.when(F.col("stays"), F.col("gain"))).alias("stay")
    )
    wants = F.coalesce(F.col("best.gain") > F.col("stay") + LEAST_GAIN * F.col("m") * F.col("m"), F.lit(False))
    wish = state.join(best, "u", "left").select("g", "u", "c", "k", "m", "turn", wants.alias("wants"), (-F.col("best.c")).alias("to"), (F.col("best.gain") - F.col("stay")).alias("more"))
    if free:
        goes = F.col("wants") & (F.pmod(F.xxhash64("u", "turn"), F.lit(CLASSES)) == 0)
    else:
        order = F.struct(F.col("more").alias("more"), (-F.col("u")).alias("u"))
        first = wish.filter("wants").select(F.explode(F.array("c", "to")).alias("x"), order.alias("o")).groupBy("x").agg(F.max("o").alias("o"))
        ends = [first.select(F.col("x").alias(c), F.col("o.u").alias(name)) for c, name in (("c", "leads"), ("to", "follows"))]
        wish = wish.join(ends[0], "c", "left").join(ends[1], "to", "left")
        goes = F.col("wants") & F.col("leads").eqNullSafe(-F.col("u")) & F.col("follows").eqNullSafe(-F.col("u"))
    return wish.select("g", "u", F.when(goes, F.col("to")).otherwise(F.col("c")).alias("c"), "k", "m", (F.col("turn") + 1).alias("turn"), "wants")


def _settle(state: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Rounds until no node would gain by moving, or the level's rounds are used up; clusters move on at the next level."""
    links = kept(adjacency.filter("u <> v").select("u", "v", "w"))
    for turn in range(FREE_ROUNDS + CAREFUL_ROUNDS):
        state = kept(_move(state, links, turn < FREE_ROUNDS))
        if state.filter("wants").isEmpty():
            break
    return state


def _strengths(adjacency: DataFrame) -> DataFrame:
    """g, u, k, m of the nodes of a level; a cluster's own links are an edge to itself, counted from both ends."""
    k = adjacency.groupBy("g", "u").agg(F.sum("w").alias("k"))
    return k.join(F.broadcast(k.groupBy("g").agg(F.sum("k").alias("m"))), "g")


def _cycle(adjacency: DataFrame, home: DataFrame) -> DataFrame:
    """u, c: the clusters after a cycle that starts from the clusters ``home`` (u, c)."""
    member, level, start = home, adjacency, home
    while True:
        state = kept(_strengths(level).join(start, "u").select("g", "u", "c", "k", "m", F.lit(0).alias("turn"), F.lit(True).alias("wants")))
        state = _settle(state, level)
        nodes, clusters = state.agg(F.count("*"), F.count_distinct("c")).first()
        moved = state.select("u", "c")
        member = kept(moved if start is home else member.withColumnRenamed("c", "u0").join(moved.withColumnRenamed("u", "u0"), "u0").select("u", "c"))
        if clusters == nodes:
            return member
        ends = level.join(moved.withColumnRenamed("c", "cu"), "u").join(moved.select(F.col("u").alias("v"), F.col("c").alias("cv")), "v")
        level = kept(ends.groupBy("g", F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
        start = level.select("u", F.col("u").alias("c")).distinct()


def _modularity(adjacency: DataFrame, member: DataFrame) -> DataFrame:
    """g, q: modularity of a partition."""
    strengths = _strengths(adjacency).join(member, "u")
    spread = strengths.groupBy("g", "c").agg(F.sum("k").alias("k"), F.max("m").alias("m")).groupBy("g").agg(F.sum(F.pow(F.col("k") / F.col("m"), F.lit(2))).alias("spread"), F.max("m").alias("m"))
    within = adjacency.join(member, "u").join(member.select(F.col("u").alias("v"), F.col("c").alias("d")), "v").filter("c = d").groupBy("g").agg(F.sum("w").alias("w"))
    return spread.join(within, "g", "left").select("g", (F.coalesce("w", F.lit(0.0)) / F.col("m") - F.col("spread")).alias("q"))


def louvain(edges: DataFrame, keys: Sequence[str] = GRAPH, trials: int = 4, cycles: int = 1) -> DataFrame:
    """node, cluster: communities of each graph, named by their least node."""
    graph = Numbered(edges, keys)
    trial = F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("t")
    of = lambda c: F.col(c) * trials + F.col("t")  # noqa: E731  numbers of a graph and its nodes within a trial
    adjacency = kept(graph.adjacency.select("*", trial).select(of("g").alias("g"), of("u").alias("u"), of("v").alias("v"), "w"))
    home = graph.ids.select("id", trial).select(of("id").alias("u"), of("id").alias("c"))
    rated = []
    for cycle in range(cycles):
        home = _cycle(adjacency, home)
        rated.append(home.withColumn("cycle", F.lit(cycle)).join(_modularity(adjacency, home).join(adjacency.select("g", "u").distinct(), "g"), "u"))
    found = rated[0]
    for more in rated[1:]:
        found = found.unionByName(more)
    found = kept(found.select("cycle", F.col("u").alias("x"), "c", "q").select("cycle", F.floor(F.col("x") / trials).alias("id"), F.pmod("x", F.lit(trials)).alias("t"), F.floor(F.col("c") / trials).alias("c"), "q").join(graph.ids, "id"))
    best = found.groupBy("g").agg(F.max_by(F.struct("cycle", "t"), F.struct("q", -F.col("cycle"), -F.col("t"))).alias("b")).select("g", "b.cycle", "b.t")
    chosen = found.join(F.broadcast(best), ["g", "cycle", "t"])
    least = chosen.groupBy("g", "c").agg(F.min("node").alias("cluster"))
    return graph.named(chosen.join(least, ["g", "c"]).select("id", "cluster"), "cluster")
