"""Topics of thread documents by LDA, and their labels by seed words."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import kept
from . import variational
from .text import plain_tokens, thread_documents, tokens, vocabulary

NONE = -1
#: Topic ids of guided topics for outliers, empty texts and errors.
OUTLIER, EMPTY, ERROR = -1, -2, -3

# Seed words of the predefined topics, in their order.
SEED_TOPICS: list[list[str]] = [
    ["Trump", "Donald Trump", "MAGA", "Make America Great Again", "Republicans", "conservative movement"],
    ["Clinton", "Hillary", "Democrats", "I'm With Her", "emails", "Benghazi", "liberal"],
    ["Sanders", "Bernie", "FeelTheBern", "progressive", "political revolution", "inequality"],
    ["election", "vote", "polls", "rigged", "voter fraud", "debates", "media bias"],
    ["gun control", "2nd Amendment", "NRA", "firearms", "shootings", "gun rights", "background checks"],
    ["economy", "jobs", "taxes", "trade", "unemployment", "debt", "Wall Street"],
    ["healthcare", "Obamacare", "ACA", "insurance", "repeal and replace"],
    ["immigration", "border", "wall", "refugees", "deportation", "sanctuary cities"],
    ["foreign policy", "ISIS", "Russia", "terrorism", "national security", "Syria"],
    ["BlackLivesMatter", "BLM", "protests", "social justice", "equality", "police brutality"],
    ["scandal", "emails", "Access Hollywood", "WikiLeaks", "Comey", "FBI"],
]


def stopwords(more: Sequence[str] = ()) -> list[str]:
    """The stop words that Spark ships for English, and a corpus's own."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted({*StopWordsRemover.loadDefaultStopWords("english"), *more})


class TopicModel:
    """An LDA model over a pruned vocabulary.

    ``fit`` prunes by document frequency, drops documents that are too short or have no term left, and
    infers topics from all others in every pass; alpha falls off over the topics unless told otherwise. ``iterations`` bounds the inference for a document.
    """

    def __init__(
        self, k: int = 20, passes: int = 5, no_below: int = 3, no_above: float = 0.6, keep_n: int = 3000, eta: float | None = 0.01, asymmetric: bool = True, least_tokens: int = 5, seed: int = 42, iterations: int = 30
    ):
        self.k, self.passes, self.seed, self.least_tokens, self.iterations = k, passes, seed, least_tokens, iterations
        self.pruning = {"no_below": no_below, "no_above": no_above, "keep_n": keep_n}
        self.eta = 1 / k if eta is None else eta
        raw = np.array([1 / (t + k**0.5) for t in range(k)]) if asymmetric else np.ones(k)
        self.alpha = raw / raw.sum()
        self.terms: list[str] = []
        self.weights: np.ndarray | None = None
        self.fitted: tuple[DataFrame, str, DataFrame] | None = None

    def fit(self, docs: DataFrame, key: str) -> TopicModel:
        """``docs`` has the key and an array column ``tokens``."""
        rows = kept(docs.select(key, "tokens"), "tokens")
        terms = vocabulary(rows.filter(F.size("tokens") >= self.least_tokens), **self.pruning)
        self.terms = [r["term"] for r in terms.select("term").toLocalIterator()]  # at most keep_n
        if self.terms:
            bags = kept(variational.bags(rows, key, self.terms), "bags")
            self.fitted = docs, key, bags
            used = bags.filter((F.col("size") >= self.least_tokens) & (F.size("ids") > 0))
            self.weights = variational.fit(used, len(self.terms), self.alpha, self.eta, self.passes, self.iterations, self.seed)
        return self

    def assign(self, docs: DataFrame, key: str, least: float = 0.15) -> DataFrame:
        """key, topic_id: the likeliest topic if it reaches ``least``; -1 for it or for short, empty and unknown texts.

        The table that was fitted is not tokenised and counted again.
        """
        if self.weights is None:
            return docs.select(key, F.lit(NONE).alias("topic_id"))
        same = self.fitted is not None and self.fitted[0] is docs and self.fitted[1] == key
        bags = self.fitted[2] if same else variational.bags(docs, key, self.terms)
        rows = variational.likeliest(bags, key, self.weights, self.alpha, self.iterations)
        fits = (F.col("size") >= self.least_tokens) & (F.col("p") >= least)
        return rows.select(key, F.when(fits, F.col("topic")).otherwise(NONE).cast("int").alias("topic_id"))

    def top_words(self, spark: SparkSession, n: int = 15) -> DataFrame:
        """topic, words: the n likeliest terms of each topic, ties to the earlier term of the vocabulary."""
        weights = np.zeros((0, 0)) if self.weights is None else self.weights
        rows = [(t, [self.terms[i] for i in np.argsort(-row, kind="stable")[:n]]) for t, row in enumerate(weights)]
        return spark.createDataFrame(rows, "topic int, words array<string>")


def seed_sets(seeds: Sequence[Sequence[str]], stop: Sequence[str], spark) -> list[set[str]]:
    rows = spark.createDataFrame([(k, " ".join(words)) for k, words in enumerate(seeds)], "k int, text string")
    return [set(r["t"]) for r in rows.select("k", plain_tokens(F.col("text"), stop).alias("t")).orderBy("k").collect()]


def map_to_seeds(topic_words: dict[int, list[str]], seeds: Sequence[set[str]], labels: Sequence[str], least: float = 0.01) -> dict[int, str]:
    """A label for each topic: seeds in order take the free topic of greatest Jaccard above ``least``; the rest is named by its words."""
    out: dict[int, str] = {}
    for seed, label in zip(seeds, labels, strict=True):
        free = [t for t in sorted(topic_words) if t not in out and topic_words[t]]
        score = {t: len(seed & set(topic_words[t])) / len(seed | set(topic_words[t])) for t in free} if seed else {}
        best = max(score, key=lambda t: (score[t], -t), default=None)
        if best is not None and score[best] > least:
            out[best] = label
    return out | {t: "_".join([f"LDA_TOPIC_{t}", *words[:3]]) for t, words in topic_words.items() if t not in out}


def seeded_topics(docs: DataFrame, key: str, seeds: Sequence[Sequence[str]] | None = None, labels: Sequence[str] | None = None, passes: int = 10) -> DataFrame:
    """key, topic_label of every document (column ``text``) by LDA topics mapped to seed topics."""
    seeds = SEED_TOPICS if seeds is None else seeds
    labels = labels or [f"TOPIC_{k}" for k in range(len(seeds))]
    stop = stopwords()
    rows = docs.select(key, plain_tokens(F.col("text"), stop).alias("tokens"))
    model = TopicModel(k=len(seeds), passes=passes, no_below=5, no_above=0.5, keep_n=100_000, eta=None, asymmetric=False, least_tokens=1, iterations=50).fit(rows, key)
    if model.weights is None:
        return docs.select(key, F.lit("NO_TOPIC_EMPTY_CORPUS").alias("topic_label"))
    words = {r["topic"]: r["words"] for r in model.top_words(docs.sparkSession, 15).collect()}
    names = map_to_seeds(words, seed_sets(seeds, stop, docs.sparkSession), labels)
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    picked = model.assign(rows, key, least=0.0)
    return picked.select(key, F.when(F.col("topic_id") == NONE, "NO_TOPIC_FILTERED_OUT").otherwise(F.coalesce(F.try_element_at(table, F.col("topic_id")), F.lit("UNKNOWN_TOPIC"))).alias("topic_label"))


def _one_each(bags: DataFrame, key: str) -> DataFrame:
    """key, ids, counts with the rows of a repeated key as one; rows of a null key are one document."""
    if bags.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return bags.select(key, "ids", "counts")
    parts = bags.select(key, F.explode_outer(F.arrays_zip("ids", "counts")).alias("t")).groupBy(key, "t.ids").agg(F.sum("t.counts").alias("n"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("ids", "n"))))
    return kept(parts.groupBy(key).agg(pairs.alias("t")).select(key, F.col("t.ids").alias("ids"), F.col("t.n").alias("counts")), "bags")


def _document_frequencies(n_terms: int):
    def run(batches):
        total = np.zeros((n_terms, 1))
        for batch in batches:
            total[:, 0] += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms)
        yield from variational.by_term(total)

    return run


def _nearest(ids: np.ndarray, counts: np.ndarray, starts: np.ndarray, centres: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each document (ties to the first, -1: none shares a term), and the weights of its terms in its unit vector."""
    n_docs, n_topics = len(starts) - 1, centres.shape[1]
    doc, w = np.repeat(np.arange(n_docs), np.diff(starts)), counts * idf[ids]
    x = w / np.sqrt(np.bincount(doc, w * w, minlength=n_docs))[doc]
    s = np.column_stack([np.bincount(doc, x * centres[ids, k], minlength=n_docs) for k in range(n_topics)])
    topic = np.where(s > 0, np.round(s, 9), -1.0).argmax(axis=1)
    return np.where((s > 0).any(axis=1), topic, -1), x


def _moved(centres: np.ndarray, idf: np.ndarray):
    """Sums of the unit vectors by their nearest centre."""

    def run(batches):
        total = np.zeros_like(centres)
        for batch in batches:
            ids, counts, starts = variational.flat(batch.column(0), batch.column(1))
            topic, x = _nearest(ids, counts, starts, centres, idf)
            of = np.repeat(topic, np.diff(starts))
            for k in range(centres.shape[1]):
                total[:, k] += np.bincount(ids[of == k], x[of == k], minlength=len(total))
        yield from variational.by_term(total)

    return run


def _placed(key: str, centres: np.ndarray, idf: np.ndarray):
    def run(batches):
        for batch in batches:
            topic, _ = _nearest(*variational.flat(batch.column(1), batch.column(2)), centres, idf)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(topic, pa.int32(), mask=topic < 0)], names=[key, "topic"])

    return run


def guided_topics(docs: DataFrame, key: str, seeds: Sequence[Sequence[str]] | None = None, labels: Sequence[str] | None = None, stop: Sequence[str] | None = None, rounds: int = 5, least_docs: int = 1, no_below: int = 3, keep_n: int = 3000) -> DataFrame:
    """key, topic_id, topic_label of every document (column ``text``) by spherical k-means from seed centroids.

    Documents are unit vectors of term frequency times ln((1 + N) / (1 + df)) + 1 over a vocabulary of at most ``keep_n`` terms and
    the seed words; a topic's first centroid is its seed words by the same weights. Each round puts every document to the nearest
    centroid (ties to the first topic) and moves the centroids to the means: a pass over the documents as rows of term numbers, of which the
    sums by topic and term come back. Centroids are at most keep_n terms per topic and the seed words, so tasks get them whole. Stands in for clustering of a sentence encoder's vectors, which needs a model file.
    -1: near no centroid, or in a topic of fewer than ``least_docs`` documents; -2: no words.
    """
    seeds = SEED_TOPICS if seeds is None else seeds
    labels = labels or [f"TOPIC_{k}" for k in range(len(seeds))]
    stop = stopwords() if stop is None else stop
    spark = docs.sparkSession
    sets = seed_sets(seeds, stop, spark)
    rows = kept(docs.select(key, plain_tokens(F.col("text"), stop).alias("tokens")), "tokens")
    common = [r["term"] for r in vocabulary(rows, no_below=no_below, no_above=1.0, keep_n=keep_n).select("term").toLocalIterator()]  # at most keep_n
    terms = sorted({*common, *(w for s in sets for w in s)})
    bags = kept(variational.bags(rows, key, terms), "bags")
    points = _one_each(bags, key)
    df = variational.summed(points.select("ids"), _document_frequencies(len(terms)), (len(terms), 1))[:, 0]
    idf = np.where(df > 0, np.log((1.0 + bags.count()) / (1.0 + df)) + 1.0, 0.0)

    def unit(raw: np.ndarray) -> np.ndarray:
        size = np.sqrt((raw * raw).sum(axis=0))
        return raw / np.where(size > 0, size, 1.0)

    number = {t: i for i, t in enumerate(terms)}
    first = np.zeros((len(terms), len(sets)))
    for k, s in enumerate(sets):
        first[[number[w] for w in s], k] = idf[[number[w] for w in s]]
    centres, points = unit(first), points.filter(F.col(key).isNotNull())  # a document without a key counts in df only
    for _ in range(rounds):
        moved = variational.summed(points.select("ids", "counts"), _moved(centres, idf), centres.shape)
        centres = np.where(moved.any(axis=0), unit(moved), centres)
    placed = kept(points.select(key, "ids", "counts").mapInArrow(_placed(key, centres, idf), f"`{key}` {points.schema[key].dataType.simpleString()}, topic int").filter("topic is not null"), "placed")
    large = placed.groupBy("topic").agg(F.count("*").alias("n")).filter(F.col("n") >= least_docs).select("topic")
    names = F.create_map(*(F.lit(x) for k, label in enumerate(labels) for x in (k, label)))
    return bags.select(key, "size").join(placed.join(F.broadcast(large), "topic", "left_semi").select(key, "topic"), key, "left").select(
        key,
        F.coalesce("topic", F.when(F.col("size") == 0, EMPTY).otherwise(OUTLIER)).cast("int").alias("topic_id"),
        F.coalesce(F.try_element_at(names, F.col("topic")), F.lit("OUTLIER")).alias("topic_label"),
    )


def assign_to_comments(comments: DataFrame, topics: DataFrame) -> DataFrame:
    """Comments with the topic of their thread, -1 where it has none."""
    return comments.join(topics.select("link_id", "topic_id"), "link_id", "left").select("id", "link_id", "author", F.coalesce("topic_id", F.lit(NONE)).alias("topic_id"), "body_cleaned")


def comment_topics(comments: DataFrame, model: TopicModel | None = None, stop: Sequence[str] | None = None) -> DataFrame:
    """The whole pipeline: thread documents, LDA, topics back on comments."""
    docs = thread_documents(comments).select("link_id", tokens(F.col("text"), stopwords() if stop is None else stop).alias("tokens"))
    fitted = (model or TopicModel()).fit(docs, "link_id")
    return assign_to_comments(comments, fitted.assign(docs, "link_id"))
