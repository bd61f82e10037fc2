"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained in numpy.

A word is its character n-grams (with its ends marked), hashed into a table of
embeddings; unseen misspellings share n-grams with what was seen. A window of
words is the mean of its words' vectors, each the mean of its n-grams'; a linear
softmax over the two classes turns it into a score. Embeddings and softmax are
trained together by Adam. Embeddings start at zero, so n-grams never trained
say nothing.

Labels are given for documents, and one insult can sit in a long text. Windows
of clean documents are clean; a toxic document's windows are toxic to begin
with, and after each round only those that the model itself finds toxic. A document's score is that of its likeliest window,
recalibrated against the number of windows on the training sample.

Texts are read whole. The fit takes a bounded sample of labelled rows, at most
``MAX_DOCS`` documents of each class by hash order of doc_id, and learns from all windows of
their texts. What it counts of an n-gram shrinks smoothly with the documents that hold it, by
the same rule at every size.

Defined cases: null and empty texts have no window and get the score of no
evidence; without labels of both classes every score is 0; where the clean or
the toxic labels sit on empty texts only, no n-gram is learnt and the number of windows decides; null labels and
labels of unknown documents are ignored; of contradicting labels the toxic one
counts; of a score of exactly 0.5 the prediction is toxic; repeated rows repeat;
very long texts are scored whole, their words through a table of bounded size; other columns, whatever their names,
are ignored by ``score_documents`` and carried along by ``reject_toxic``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bound_batches

MAX_DOCS = 5000
#: An n-gram held by n documents of the sample counts n / (n + SHRINK) of its embedding: rare ones say less, none is left out.
SHRINK = 50.0
#: After the first round the one in HARD clean windows that look most toxic weighs as much as all others together.
HARD = 16
#: The most windows of a training step, and the most that a toxic window weighs.
MOST_BATCH, MOST_WEIGHT = 16_384, 20
#: The logit from which a window counts as toxic in the last round.
CERTAIN = 2.0
BITS, DIM, WINDOW = 18, 8, 8
GRAMS = (3, 4, 5)
_ENDS = ".,;:!?\"'()[]{}<>*#$%&-_…«»“”"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table slots of all n-grams of all words, and where each word's begin."""
    if len(words) > 20_000:
        parts = [subwords(words[k : k + 20_000]) for k in range(0, len(words), 20_000)]
        shifts = np.cumsum([0, *(len(s) for s, _ in parts)])
        starts = [p[:-1] + d for (_, p), d in zip(parts, shifts[:-1], strict=True)]
        return np.concatenate([s for s, _ in parts]), np.concatenate([*starts, shifts[-1:]])
    marked = ["<" + (w.strip(_ENDS) or w) + ">" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(marked)), sizes)
    slots, owners = [], []
    for n in GRAMS:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : k + count]) * _PRIME
            h ^= h >> np.uint64(29)
        inside = word[:count] == word[n - 1 :]
        slots.append((h[inside] >> np.uint64(64 - BITS)).astype(np.int32))
        owners.append(word[:count][inside])
    if not slots:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    slots, owners = np.concatenate(slots), np.concatenate(owners)
    by_word = np.argsort(owners, kind="stable")
    return slots[by_word], np.searchsorted(owners[by_word], np.arange(len(words) + 1))


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row sums between consecutive starts; empty ranges give 0."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), values.dtype)
    full = starts[1:] > starts[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, starts[:-1][full], axis=0)
    return out


@dataclass
class Model:
    """``lean`` folds embeddings and softmax: the difference of the two classes' logits per n-gram."""

    lean: np.ndarray
    bias: float
    scale: float
    per_window: float
    offset: float

    def word_logits(self, words: list[str]) -> np.ndarray:
        slots, starts = subwords(words)
        return _sums(self.lean[slots], starts) / np.maximum(1, np.diff(starts))


class Scorer:
    """Scores whole texts; word logits are kept in a table of bounded size."""

    LIMIT = 100_000

    def __init__(self, model: Model | None):
        self.model, self.table = model, {}

    def best_window(self, words: list[str]) -> float:
        fresh = [w for w in set(words) if w not in self.table]
        if fresh:
            if len(self.table) + len(fresh) > self.LIMIT:
                self.table.clear()
                fresh = list(set(words))
            self.table.update(zip(fresh, self.model.word_logits(fresh).tolist(), strict=True))
        logits = np.fromiter(map(self.table.__getitem__, words), np.float64, len(words))
        starts = np.arange(0, len(words), WINDOW)
        sizes = np.minimum(WINDOW, len(words) - starts)
        return float((np.add.reduceat(logits, starts) / sizes).max()) + self.model.bias

    def score(self, text: str | None) -> float:
        if self.model is None:
            return 0.0
        words = words_of(text)
        top = self.best_window(words) if words else self.model.bias
        z = self.model.scale * top + self.model.per_window * np.log1p(len(words) / WINDOW) + self.model.offset
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _calibrate(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Coefficients of a class-balanced logistic fit towards smoothed targets, by damped Newton steps."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    target = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(toxic, 0.5 / n1, 0.5 / n0)
    middle, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    middle[-1], spread[-1] = 0, 1
    u = (x - middle) / spread
    ridge = np.array([1e-4, 1e-2, 1e-6])

    def loss(c: np.ndarray) -> float:
        z = u @ c
        return float(weight @ (np.logaddexp(0, z) - target * z) + 0.5 * ridge @ (c * c))

    c = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(u @ c, -30, 30)))
        step = np.linalg.solve((u * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ u + np.diag(ridge), u.T @ (weight * (p - target)) + ridge * c)
        size = 1.0
        while size > 1e-4 and loss(c - size * step) > loss(c):
            size /= 2
        c = c - size * step
        if abs(size * step).max() < 1e-6:
            break
    scaled = c / spread
    scaled[-1] -= (c[:-1] / spread[:-1]) @ middle[:-1]
    return scaled


def train(examples: Iterable[tuple[str, int]], rounds: int = 3, epochs: int = 2, seed: int = 7) -> Model | None:
    """Fit embeddings, softmax and calibration on (text, toxic) pairs; only word numbers are kept of the texts."""
    vocabulary: dict[str, int] = {}
    runs, marks = [], []
    for text, mark in examples:
        runs.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)), np.int32))
        marks.append(bool(mark))
    toxic, sizes = np.array(marks, bool), np.array([len(r) for r in runs], np.int64)
    if not vocabulary or not toxic.any() or toxic.all():
        return None
    held = np.zeros(len(vocabulary), np.int32)
    for r in runs:
        held[np.unique(r)] += 1
    ids = np.concatenate(runs)
    del runs
    slots, starts = subwords(list(vocabulary))
    del vocabulary
    live, trust = _trust(slots, starts, held)
    number = np.zeros(1 << BITS, np.int32)
    number[live] = np.arange(len(live), dtype=np.int32)
    for k in range(0, len(slots), 1 << 20):
        slots[k : k + (1 << 20)] = number[slots[k : k + (1 << 20)]]
    per_word = np.maximum(1, np.diff(starts)).astype(np.float32)
    n_docs = len(sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])
    begin = np.concatenate([np.arange(a, b, WINDOW, dtype=np.int32) for a, b in zip(first[:-1], first[1:], strict=True)])
    owner = np.repeat(np.arange(n_docs, dtype=np.int32), -(-sizes // WINDOW))
    end = np.minimum(begin + WINDOW, first[1:][owner]).astype(np.int32)

    rng = np.random.default_rng(seed)
    E, W, b = np.zeros((len(live), DIM), np.float32), (rng.normal(0, 1, (DIM, 2)) / np.sqrt(DIM)).astype(np.float32), np.zeros(2, np.float32)
    state = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in (("E", E), ("W", W), ("b", b))}
    tick = 0

    def adam(key: str, p: np.ndarray, grad: np.ndarray, rate: float) -> None:
        m, v = state[key]
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        p -= rate * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.999**tick)) + 1e-8)

    def leaning() -> tuple[np.ndarray, float]:
        return trust * (E @ (W[:, 1] - W[:, 0])), float(b[1] - b[0])

    def window_logits() -> np.ndarray:
        lean, bias = leaning()
        word = _sums(lean[slots], starts) / per_word
        out = np.empty(len(begin), np.float32)
        for k in range(0, len(begin), 1 << 16):
            at = slice(begin[k], end[min(k + (1 << 16), len(begin)) - 1])
            cut = np.append(begin[k : k + (1 << 16)], at.stop) - at.start
            out[k : k + (1 << 16)] = _sums(word[ids[at]], cut)
        return out / (end - begin) + bias

    positive = toxic[owner]
    clean = np.flatnonzero(~positive)
    heavy, place = np.ones(len(begin), np.float32), np.zeros(len(held), np.int32)
    for turn in range(rounds):
        if turn:
            z = window_logits()
            # in the last round a mislabelled document may have no toxic window at all
            positive = toxic[owner] & (z > (CERTAIN if turn == rounds - 1 else 0.0))
            # the clean windows that the model takes for toxic most weigh as much as all others together
            heavy[:] = 1
            heavy[clean[np.argsort(-z[clean], kind="stable")[: len(clean) // HARD]]] = HARD
        hot = np.flatnonzero(positive)
        if not len(hot) or not len(clean):
            break
        chosen = np.concatenate([hot, clean])
        weight = float(heavy[clean].sum()) / len(hot)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(chosen), -(-len(chosen) // min(MOST_BATCH, max(128, len(chosen) // 24)))):
                tick += 1
                y = positive[part].astype(int)
                n = end[part] - begin[part]
                at = np.repeat(begin[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                place[ids[at]] = 1
                words = np.flatnonzero(place)
                place[words] = np.arange(len(words), dtype=np.int32)
                back = place[ids[at]]
                place[words] = 0
                per = starts[words + 1] - starts[words]
                sub = slots[np.repeat(starts[words] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())]
                size = per_word[words][:, None]
                vectors = _sums((E * trust[:, None])[sub], np.concatenate([[0], np.cumsum(per)])) / size
                bags = _sums(vectors[back], np.concatenate([[0], np.cumsum(n)])) / n[:, None].astype(np.float32)
                z = bags @ W + b
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p *= (np.where(y == 1, min(weight, MOST_WEIGHT), heavy[part]) / len(y))[:, None].astype(np.float32)
                spread = np.repeat((p @ W.T) / n[:, None].astype(np.float32), n, axis=0)
                d_words = np.stack([np.bincount(back, spread[:, k], len(words)) for k in range(DIM)], 1) / size
                d_E = np.empty_like(E)
                for k in range(DIM):
                    d_E[:, k] = np.bincount(sub, np.repeat(d_words[:, k], per), len(live)) * trust
                adam("E", E, d_E, 0.05)
                adam("W", W, bags.T @ p, 0.02)
                adam("b", b, p.sum(0), 0.02)

    lean, bias = leaning()
    z = window_logits()
    top = np.full(n_docs, bias)
    if len(z):
        best = np.full(n_docs, -np.inf)
        np.maximum.at(best, owner, z)
        top = np.where(np.isfinite(best), best, bias)
    c = _calibrate(np.stack([top, np.log1p(sizes / WINDOW), np.ones(n_docs)], 1), toxic)
    table = np.zeros(1 << BITS, np.float32)
    table[live] = lean
    return Model(table, bias, float(c[0]), float(c[1]), float(c[2]))


def _trust(slots: np.ndarray, starts: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table slots that occur, and n / (n + ``SHRINK``) for the documents n that hold each.

    ``held`` counts documents per word, so a slot's count may exceed its documents.
    """
    spread = np.zeros(1 << BITS)
    for k in range(0, len(held), 20_000):
        cut = starts[k : k + 20_001]
        spread += np.bincount(slots[cut[0] : cut[-1]], np.repeat(held[k : k + 20_000], np.diff(cut)), 1 << BITS)
    live = np.flatnonzero(spread)
    return live, (spread[live] / (spread[live] + SHRINK)).astype(np.float32)


def remainder(doc_id) -> object:
    """crc32 of doc_id as text, modulo 5; null ids count as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model | None:
    """Train on a bounded sample of labelled documents outside the held-out fifth."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(remainder("doc_id") != 0)
    order = F.xxhash64("doc_id", F.lit("fit"))
    chosen = [marks.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(max_docs) for y in (0, 1)]
    # at most 2 * max_docs ids and labels, whatever the size of the tables
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("text", "toxic")
    return train((r["text"], r["toxic"]) for r in sample.toLocalIterator())


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every whole text, map only; the model has a fixed size."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            scores = [scorer.score(v.as_py()) for v in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    thin = docs.select("doc_id", "text")
    return thin.mapInArrow(run, f"doc_id {thin.schema[0].dataType.simpleString()}, score double")


def reject_toxic(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The documents scored below the threshold, with all their columns."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            clean = [scorer.score(v.as_py()) < threshold for v in b.column(names.index("text"))]
            yield b.filter(pa.array(clean, pa.bool_()))

    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))  # Spark's own resolves no names with dots here
    return plain.mapInArrow(run, plain.schema).toDF(*names)
