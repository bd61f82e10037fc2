"""Positions of the nodes of a graph by forces: linked nodes pull, all nodes push.

A round is a handful of joins and sums for all graphs at once. The pull is a join of the links with the positions. For the push, the bounding box of a graph is
cut into ``GRID`` x ``GRID`` cells and every node is pushed by the centre of the nodes in each cell, itself left out; so a node costs
``GRID`` squared steps however many nodes there are, and no pairs of nodes are made. Forces are summed as whole
numbers of 1e-9 and positions are whole numbers of 1e-6, so reruns agree whatever the order of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import kept

GRID, ROUNDS = 8, 50
#: Share of the unit square that a node may move in the first round; it falls in equal steps.
STEP = 0.1

#: Shared with the SQL of the query: a place's cell, a whole number of 1e-9, and one of 1e-6.
CELL = f"cast(least({GRID - 1}, floor((x - low_x) / wide * {GRID})) * {GRID} + least({GRID - 1}, floor((y - low_y) / high * {GRID})) as int)"
FINE = "cast(floor(({}) * 1e9 + 0.5) as bigint)"
COARSE = "cast(floor(({}) * 1e6 + 0.5) as bigint)"


def push(axis: str) -> str:
    """Push of a cell of m other nodes with sums sx, sy (in 1e-6) on the node at x, y of a graph of n nodes."""
    dx, dy = "(x - sx / 1e6 / m)", "(y - sy / 1e6 / m)"
    return FINE.format(f"m * {dx if axis == 'x' else dy} / n / greatest({dx} * {dx} + {dy} * {dy}, 1e-6)")


def pull(axis: str) -> str:
    """Pull of the node at x2, y2 on that at x, y along a link."""
    return FINE.format(f"weight * ({axis}2 - {axis}) * sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) * sqrt(cast(n as double))")


def moved(axis: str, step: float) -> str:
    """Where forces fx, fy (in 1e-9) take a node in a round of such a step."""
    return f"{COARSE.format(f'{axis} + f{axis} / 1e9 * {step!r} / greatest(sqrt(fx / 1e9 * (fx / 1e9) + fy / 1e9 * (fy / 1e9)), 0.01)')} / 1e6"


def first_place(part: int) -> str:
    """Six hexadecimal digits of the hash of a node's name, as a whole number."""
    return f"substr(md5(concat(node, '|42')), {part}, 6)"


def steps(rounds: int) -> list[float]:
    return [STEP * (1 - k / (rounds + 1)) for k in range(rounds)]


def spring_layout(edges: DataFrame, keys: Sequence[str], rounds: int = ROUNDS) -> DataFrame:
    """keys, node, x, y in the square from -1 to 1 for every node of the links src, dst, weight.

    Loops do not pull; repeated links pull each; a graph of one node has it at 0, 0; a null weight counts 1.
    """
    keys = list(keys)
    links = edges.select(*keys, "src", "dst", F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight")).filter("src is not null and dst is not null")
    ways = kept(links.unionByName(links.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), "ways")
    nodes = ways.select(*keys, F.col("src").alias("node")).distinct()
    place = [F.expr(f"cast(conv({first_place(p)}, 16, 10) as bigint)") for p in (1, 7)]
    at = nodes.select(*keys, "node", *((F.floor(h / F.lit(16777216.0) * 1e6 + 0.5) / 1e6).alias(a) for h, a in zip(place, "xy", strict=True)))
    at = kept(at, "places")
    for step in steps(rounds):
        at = kept(_round(at, ways, keys, step), "places")
    middle = at.groupBy(*keys).agg(F.count("*").alias("n"), *(F.expr(f"sum({COARSE.format(a)})").alias(f"s{a}") for a in "xy"))
    centred = at.join(middle, keys).select(*keys, "node", *(F.expr(f"{a} - s{a} / 1e6 / n").alias(a) for a in "xy"))
    far = centred.groupBy(*keys).agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("far"))
    return centred.join(far, keys).select(*keys, "node", *(F.round(F.when(F.col("far") > 0, F.col(a) / F.col("far")).otherwise(0.0), 4).alias(a) for a in "xy"))


def _round(at: DataFrame, ways: DataFrame, keys: list[str], step: float) -> DataFrame:
    box = at.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("low_x"), F.min("y").alias("low_y"), F.expr("greatest(max(x) - min(x), 1e-6)").alias("wide"), F.expr("greatest(max(y) - min(y), 1e-6)").alias("high"))
    placed = at.join(box, keys).withColumn("cell", F.expr(CELL)).withColumns({"qx": F.expr(COARSE.format("x")), "qy": F.expr(COARSE.format("y"))})
    cells = placed.groupBy(*keys, "cell").agg(F.count("*").alias("m"), F.sum("qx").alias("sx"), F.sum("qy").alias("sy"))
    grid = cells.groupBy(*keys).agg(F.collect_list(F.struct("cell", "m", "sx", "sy")).alias("grid"))  # at most GRID squared
    own = "cast(c.cell = cell as int)"
    others = f"filter(transform(grid, c -> struct(c.m - {own} as m, c.sx - {own} * qx as sx, c.sy - {own} * qy as sy)), c -> c.m > 0)"

    def force(axis: str) -> str:
        one = push(axis).replace("sx", "c.sx").replace("sy", "c.sy").replace("/ m)", "/ c.m)").replace("(m *", "(c.m *")
        return f"aggregate(others, 0L, (sum, c) -> sum + {one})"

    pushed = placed.join(grid, keys).withColumn("others", F.expr(others)).select(*keys, "node", "x", "y", "n", F.expr(force("x")).alias("px"), F.expr(force("y")).alias("py"))
    here = placed.select(*keys, F.col("node").alias("src"), "x", "y", "n")
    there = at.select(*keys, F.col("node").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pulled = ways.join(here, [*keys, "src"]).join(there, [*keys, "dst"]).groupBy(*keys, F.col("src").alias("node")).agg(*(F.sum(F.expr(pull(a))).alias(f"l{a}") for a in "xy"))
    forced = pushed.join(pulled, [*keys, "node"]).select(*keys, "node", "x", "y", (F.col("px") + F.col("lx")).alias("fx"), (F.col("py") + F.col("ly")).alias("fy"))
    return forced.select(*keys, "node", *(F.expr(moved(a, step)).alias(a) for a in "xy"))
