"""A polarity lexicon grown from seed words, and texts scored by it.

Words that occur within ``WINDOW`` words of each other are linked by their positive pointwise mutual information. Seeds keep
their value; in each round every other word takes the mean of its neighbours, weighted by the links and shortened by ``DAMPING``. A text is the sum over
its words, turned around where one of the ``SCOPE`` words before is a negation. Links are counted by number
within a slice of texts and then at their first word; a round is a join and a sum, and values are whole numbers of 1e-6, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import kept

WINDOW, SCOPE, ROUNDS, DAMPING = 4, 3, 3, 0.85
NEGATIONS = ("not", "no", "never", "none", "cannot", "nicht", "kein", "pas", "jamais", "nunca")
#: Words and links that occur less often are no part of the graph.
LEAST_WORDS, LEAST_LINKS = 5, 3
#: Words of text whose pairs are counted together.
SLICE = 2_000_000


def _met(texts: DataFrame, column: str, window: int) -> DataFrame:
    """a and, in arrays b and c, the words after it in order that occur within ``window`` words of it and how often; a row per word and ``SLICE`` words of text."""

    def pairs(lists: pa.Array) -> Iterator[pa.RecordBatch]:
        code = lists.flatten().dictionary_encode()
        order = pc.sort_indices(code.dictionary)
        words, rank = code.dictionary.take(order), np.empty(len(order) + 1, np.int64)
        rank[order.to_numpy()], rank[-1] = np.arange(len(order)), -1
        t = rank[pc.fill_null(code.indices, -1).to_numpy(zero_copy_only=False)]
        doc = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        keys = []
        for d in range(1, window + 1):
            x, y = t[:-d], t[d:]
            held = (doc[:-d] == doc[d:]) & (x != y) & (x >= 0) & (y >= 0)
            keys.append(np.minimum(x, y)[held] * len(words) + np.maximum(x, y)[held])
        both, n = np.unique(np.concatenate(keys), return_counts=True)
        heads, starts = np.unique(both // max(len(words), 1), return_index=True)
        ends = np.append(starts, len(both))
        for at in range(0, len(heads), 1024):
            part = ends[at : at + 1025]
            offsets, inner = pa.array((part - part[0]).astype(np.int32)), slice(part[0], part[-1])
            lists_of = [pa.ListArray.from_arrays(offsets, v) for v in (words.take(pa.array(both[inner] % len(words))), pa.array(n[inner].astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([words.take(pa.array(heads[at : at + 1024])), *lists_of], names=["a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
                yield from pairs(batch.column(0).slice(at, to - at))
                at = to

    return texts.select(column).mapInArrow(run, "a string, b array<string>, c array<long>")


def word_graph(texts: DataFrame, column: str = "tokens", window: int = WINDOW, least_words: int = LEAST_WORDS, least_links: int = LEAST_LINKS) -> DataFrame:
    """a, b, weight both ways: words linked by positive mutual information, in whole numbers of 1e-6."""
    count = kept(texts.select(F.explode(column).alias("t")).groupBy("t").agg(F.count("*").alias("n")).filter(F.col("n") >= least_words), "words")
    placed = _met(texts, column, window).repartition("a").select("a", F.explode(F.arrays_zip("b", "c")).alias("p"))  # counted where a is, without a second shuffle
    met = placed.groupBy("a", "p.b").agg(F.sum("p.c").alias("c")).filter(F.col("c") >= least_links)
    total = count.agg(F.sum("n").cast("double").alias("total"))
    known = met.join(count.select(F.col("t").alias("a"), F.col("n").alias("na")), "a").join(count.select(F.col("t").alias("b"), F.col("n").alias("nb")), "b").join(F.broadcast(total))
    links = known.select("a", "b", F.expr("cast(floor(ln(c * total / na / nb) * 1e6 + 0.5) as bigint)").alias("weight")).filter("weight > 0")
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")  # not a union, which would count twice
    return links.select(ways, "weight").select("e.a", "e.b", "weight")


def grow(graph: DataFrame, seeds: Mapping[str, int], rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """term, polarity (from -1000000 to 1000000) of every word that a seed reaches; seeds are 1 or -1."""
    spark = graph.sparkSession
    graph = kept(graph, "links")
    fixed = F.broadcast(spark.createDataFrame([(w, 1_000_000 * v) for w, v in seeds.items()], "term string, polarity long"))
    whole = graph.groupBy("a").agg(F.sum("weight").alias("whole"))
    now = fixed
    for _ in range(rounds):
        pulled = graph.join(now.select(F.col("term").alias("b"), "polarity"), "b").groupBy("a").agg(F.sum(F.col("weight") * F.col("polarity")).alias("s")).join(whole, "a")
        free = pulled.select(F.col("a").alias("term"), F.expr(f"cast(floor({damping!r}D * s / whole + 0.5) as bigint)").alias("polarity")).filter("polarity <> 0")
        now = kept(free.join(fixed, "term", "left_anti").unionByName(fixed), "lexicon")
    return now


def scores(texts: DataFrame, lexicon: DataFrame, key: str, column: str = "tokens", negations: Sequence[str] = NEGATIONS, scope: int = SCOPE) -> DataFrame:
    """key, score, sentiment (-1, 0 or 1) of every text; texts without known words score 0."""
    turned = lambda i: F.exists(F.slice(F.col(column), F.greatest(i - scope + 1, F.lit(1)), F.least(i, F.lit(scope))), lambda t: t.isin(*negations))
    signed = F.transform(column, lambda t, i: F.struct(t.alias("term"), F.when((i > 0) & turned(i), -1).otherwise(1).alias("sign")))
    rows = texts.select(key, F.explode(signed).alias("w")).select(key, "w.term", "w.sign")
    summed = rows.join(lexicon, "term").groupBy(key).agg(F.sum(F.col("sign") * F.col("polarity")).alias("score"))
    full = texts.select(key).join(summed, key, "left").na.fill(0, ["score"])
    return full.select(key, "score", F.signum("score").cast("int").alias("sentiment"))
