"""Mixing sources to target weights by cube-method balanced sampling.

Each source's target is a share of the mix by weight, capped at a multiple of
what the source holds; the excess is shared again by weight. A document is taken
floor(f) times, f being target over source size, and once more with
probability f - floor(f). The cube method settles these fractions: it moves them
along the null space of the balancing constraints (documents and words of the
source), so that both totals stay as they are, until all but a few are 0 or 1.

The flight runs twice. First in buckets of documents by hash, each source of a
bucket by itself, streaming with three open fractions at a time; then over what
the buckets left open, at most two documents per bucket and source. The two
left then per source are landed on the nearest totals. Bucket membership and order come
from hashes of doc_id and text, so reruns agree whatever the number of partitions.

Defined cases: a null text has size 0; a null source is a source, ordered last;
null ids are told apart by their texts; repeated rows are documents of
their own; equal coins go by doc_id, size and text; documents of a source without words are never taken; very long texts are counted
whole; other columns, whatever their names, are ignored by ``mix`` and carried along by ``apply_mix``; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, keep, row_of

#: Buckets of the first flight: at least so many, and more where they would hold more documents than this.
BUCKETS, BUCKET_ROWS = 256, 100_000
_EPS = 1e-9


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, number of words, and a hash of the text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("of"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: its size and its target.

    Weights repeat over the sources in code-point order, nulls last. The shares
    solve sum(min(cap * size, level * weight)) = share * total: with the sources
    ordered by cap * size / weight, the first one that its level does not fill sets the level.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    rows = totals.withColumn("place", place).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    rows = rows.withColumn("fills_at", F.col("most") / F.col("weight"))
    by_fill = Window.orderBy("fills_at", "place")
    before = F.coalesce(F.sum("most").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    rows = rows.withColumn("level", (everything - before) / rest)
    level = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "place", "level"))).over(Window.partitionBy())["level"]
    target = F.least("most", F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"))


class Flight:
    """The flight phase over one group, holding at most three open documents.

    An open document is [probability, size, coin, payload]; ``coin`` is uniform
    in [0, 1) and decides the direction of the step that the document enters.
    """

    def __init__(self):
        self.open: list[list] = []
        self.settled: list[tuple[object, int]] = []

    def add(self, probability: float, size: int, coin: float, payload) -> None:
        self.open.append([probability, size, coin, payload])
        self._settle()
        while len(self.open) >= 3:
            self._step(coin)
            self._settle()

    def _settle(self) -> None:
        for unit in [u for u in self.open if not _EPS < u[0] < 1 - _EPS]:
            self.open.remove(unit)
            self.settled.append((unit[3], int(unit[0] > 0.5)))

    def _step(self, coin: float) -> None:
        a, b, c = self.open[:3]
        # orthogonal to (1, 1, 1) and to the sizes: both totals stay
        v = (c[1] - b[1], a[1] - c[1], b[1] - a[1])
        if not any(v):
            v = (1, -1, 0)
        pairs = [(u, x) for u, x in zip((a, b, c), v, strict=True) if x]
        ahead = min((1 - u[0]) / x if x > 0 else u[0] / -x for u, x in pairs)
        back = min(u[0] / x if x > 0 else (1 - u[0]) / -x for u, x in pairs)
        step = ahead if coin * (ahead + back) < back else -back
        for u, x in pairs:
            u[0] += step * x

    def land(self) -> None:
        """Settle the last documents on the totals nearest to the open ones."""
        n = len(self.open)
        if not n:
            return
        typical = max(1.0, sum(u[1] for u in self.open) / n)

        def off(ones: int) -> tuple[float, int]:
            gap = [(ones >> k & 1) - u[0] for k, u in enumerate(self.open)]
            return abs(sum(g * u[1] for g, u in zip(gap, self.open, strict=True))) + typical * abs(sum(gap)), ones

        best = min(range(1 << n), key=off)
        self.settled += [(u[3], best >> k & 1) for k, u in enumerate(self.open)]
        self.open = []


_COLUMNS = ["doc_id", "source", "size", "of", "source_size", "target", "base", "chance", "coin", "bucket", "copies"]


def _fly(rows: DataFrame, group: list[str], last: bool) -> DataFrame:
    """Flight over each group of rows that lie together; ``copies`` is null where a document stays open."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in _COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, flight, out = None, Flight(), []
        arrow = None

        def close() -> None:
            if last:
                flight.land()
            for row, one in flight.settled:
                out.append(row | {"copies": row["base"] + one})
            for chance, _, _, row in flight.open:
                out.append(row | {"chance": chance})
            flight.settled, flight.open = [], []

        for b in batches:
            arrow = b.schema
            for row in b.to_pylist():
                key = [row[c] for c in group]
                if key != now:
                    close()
                    now = key
                flight.add(row["chance"], row["size"], row["coin"], row)
            out += [row | {"copies": row["base"] + one} for row, one in flight.settled]
            flight.settled = []
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
            out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.select(*_COLUMNS).mapInArrow(run, schema)


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, size, of (hash of the text), source_size, target, copies for every document.

    Texts are read once, for their sizes; all later steps carry a few numbers
    per row. ``repartition`` goes by bucket, so no source weighs on one task.
    """
    sizes = keep(word_sizes(docs), "sizes")
    targets = keep(source_targets(sizes, weights, share, cap), "targets")
    buckets = max(buckets, -(-sizes.count() // BUCKET_ROWS))
    each = sizes.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    f = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    base = F.floor(f + F.lit(_EPS))
    mixed = F.xxhash64("doc_id", F.lit("order"), "size", "of")
    rows = each.select(
        "doc_id", "s.source", "size", "of", "source_size", "target",
        base.cast("int").alias("base"),
        F.greatest(f - base, F.lit(0.0)).alias("chance"),
        (F.pmod(mixed, F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("coin"),
        F.pmod(F.xxhash64("doc_id", F.lit("bucket"), "of"), F.lit(buckets)).cast("int").alias("bucket"),
        F.lit(None).cast("int").alias("copies"),
    )
    order = ["source", "coin", "doc_id", "size", "of"]
    first = keep(_fly(rows.repartition("bucket").sortWithinPartitions("bucket", *order), ["bucket", "source"], False), "flight")
    rest = first.filter("copies is null").repartition("source").sortWithinPartitions("source", "bucket", *order[1:])
    both = first.filter("copies is not null").unionByName(_fly(rest, ["source"], True))
    return both.select("doc_id", "source", "size", "of", "source_size", "target", F.col("copies").cast("long").alias("copies"))


def taken_words(mixed: DataFrame) -> DataFrame:
    """The mix as words taken of each document."""
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them, with their own columns.

    Texts are shuffled once and not sorted: the decisions are the hashed side, which is small beside the texts of
    its partition. Rows that share doc_id, source and text, if there are any, take their decisions by the
    order of their whole content, so a task that runs again deals them alike.
    """
    key = F.to_json(F.struct("doc_id", "source")).alias("key")
    left = docs.select(row_of(docs).alias("row"), key, F.xxhash64("text").alias("of"))
    each = keep(mixed.groupBy(key, "of").agg(F.count("*").alias("n"), F.min("copies").alias("least"), F.sum("copies").alias("all")).filter("all > 0"), "copies")
    out = left.join(each.filter("n = 1").hint("shuffle_hash"), ["key", "of"]).select("row", F.col("all").alias("times"))
    repeated = each.filter("n > 1")
    if not repeated.isEmpty():
        turn = F.row_number().over(Window.partitionBy("key", "of").orderBy(F.xxhash64(F.to_json("row"))))
        rows = left.join(repeated.hint("shuffle_hash"), ["key", "of"]).withColumn("turn", turn)
        times = F.col("least") + (F.col("turn") <= F.col("all") - F.col("n") * F.col("least")).cast("long")
        out = out.unionByName(rows.select("row", times.alias("times")).filter("times > 0"))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("time")).select("row.*")
