"""Latent Dirichlet allocation by batch variational inference.

Every pass reads every document: its topic weights are iterated to a limit or until they stand still, and the expected
counts of terms by topic are summed over all documents to make the next topics. Documents are rows of term numbers, which a task iterates side by side in tables of about equal sizes; what it gets
besides is topics x terms numbers, bounded by the pruned vocabulary, and what comes back is the same, summed by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: A document's weights stand still when they change by less than this on average.
STILL = 1e-3
#: Terms of documents that are iterated side by side.
TABLE = 32768


def _psi(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x + 6, and the digamma function of x less the log of that, for positive numbers.

    The recurrence over six steps in closed form, 1/x + ... + 1/(x + 5) with t = x (x + 5), and the asymptotic series.
    """
    t = x * (x + 5)
    steps = (2 * x + 5) * ((3 * t + 20) * t + 24) / (t * ((t + 10) * t + 24))
    z = x + 6
    r = 1 / z
    y = r * r
    return z, -(steps + 0.5 * r + y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132)))))


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the log of the gamma function, for positive numbers."""
    z, rest = _psi(np.asarray(x, float))
    return np.log(z) + rest


def expected_log(weights: np.ndarray) -> np.ndarray:
    """exp(E[log p]) of the Dirichlet distributions in the rows of ``weights``."""
    return np.exp(digamma(weights) - digamma(weights.sum(axis=-1, keepdims=True)))


def _raised(weights: np.ndarray) -> np.ndarray:
    """``expected_log`` short of a factor of each row, which inference does not need."""
    z, rest = _psi(weights)
    return z * np.exp(rest)


def _tables(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the documents that have terms, by size, in runs of about ``TABLE`` terms; each run's documents fill a table of its greatest size."""
    order = np.argsort(sizes, kind="stable")
    at = int(np.searchsorted(sizes[order], 1))
    while at < len(order):
        fits = np.arange(1, len(order) - at + 1) * sizes[order[at:]] <= TABLE
        end = at + max(1, int(fits.argmin()) if not fits.all() else len(fits))
        yield order[at:end]
        at = end


def infer(ids: np.ndarray, counts: np.ndarray, starts: np.ndarray, topics: np.ndarray, alpha: np.ndarray, limit: int, total: np.ndarray | None = None) -> np.ndarray:
    """Topic weights (documents x topics) of documents whose terms ``ids`` and ``counts`` lie one after the other, from ``starts`` on.

    ``topics`` is terms x topics. To ``total``, of that shape, their expected counts are added, short of the factor ``topics``. Documents are iterated side by
    side, each until it stands still; those without terms keep alpha.
    """
    sizes = np.diff(starts)
    out = np.repeat(alpha[None], len(sizes), axis=0)
    for docs in _tables(sizes):
        place = np.arange(sizes[docs].max())[None]
        filled = place < sizes[docs][:, None]
        at = np.where(filled, starts[docs][:, None] + place, starts[docs][:, None])
        term, n = ids[at], np.where(filled, counts[at], 0.0)
        table = np.ascontiguousarray(topics[term].transpose(0, 2, 1))
        left, beta, m, moves = np.arange(len(docs)), table, n, np.ones(len(docs), bool)
        gamma = alpha + n.sum(axis=1, keepdims=True) / len(alpha)
        final = gamma.copy()
        for _ in range(limit):
            theta = _raised(gamma)
            before, gamma = gamma, alpha + theta * (beta @ (m / ((theta[:, None, :] @ beta)[:, 0, :] + 1e-100))[:, :, None])[:, :, 0]
            final[left[moves]] = gamma[moves]
            moves &= np.abs(gamma - before).mean(axis=1) >= STILL
            if not moves.any():
                break
            if 4 * moves.sum() < 3 * len(moves):  # the table is copied only when it shrinks by a quarter
                left, beta, m, gamma, moves = left[moves], beta[moves], m[moves], gamma[moves], moves[moves]
        out[docs] = final
        if total is not None:
            theta = _raised(final)
            share = n / ((theta[:, None, :] @ table)[:, 0, :] + 1e-100)
            parts = (share[:, :, None] * theta[:, None, :])[filled]
            order = np.argsort(term[filled], kind="stable")
            found, first = np.unique(term[filled][order], return_index=True)
            total[found] += np.add.reduceat(parts[order], first, axis=0)
    return out


def bags(docs: DataFrame, key: str, terms: Sequence[str]) -> DataFrame:
    """key, size (tokens), ids, counts of every document with ``tokens``; terms outside the vocabulary are left out."""
    known = docs.sparkSession.sparkContext.broadcast(list(terms))
    kind = docs.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, size int, ids array<int>, counts array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(known.value, pa.string())
        for batch in batches:
            lists = batch.column(1)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            term = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary.cast(lists.type.value_type)), -1).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(size)), size)
            pairs, n = np.unique(doc[term >= 0] * len(vocabulary) + term[term >= 0], return_counts=True)
            starts = pa.array(np.searchsorted(pairs, np.arange(len(size) + 1) * len(vocabulary)).astype(np.int32))
            found = [pa.array((pairs % max(len(vocabulary), 1)).astype(np.int32)), pa.array(n.astype(float))]
            columns = [batch.column(0).cast(to_arrow_type(kind)), pa.array(size.astype(np.int32)), *(pa.ListArray.from_arrays(starts, x) for x in found)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "size", "ids", "counts"])

    return docs.select(key, "tokens").mapInArrow(run, schema)


def flat(ids: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms and counts of a batch's documents one after the other, and where each document's begin, with their end."""
    sizes = pc.list_value_length(ids).to_numpy(zero_copy_only=False)
    return ids.flatten().to_numpy(zero_copy_only=False), counts.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def by_term(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The terms of a table (terms x columns) that have something, a row each, as term, n0, n1, ..."""
    terms = np.flatnonzero(total.any(axis=1))
    for cut in range(0, len(terms), 16384):
        part = terms[cut : cut + 16384]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(x) for x in total[part].T.copy())], names=["term", *(f"n{k}" for k in range(total.shape[1]))])


def summed(rows: DataFrame, run, shape: tuple[int, int]) -> np.ndarray:
    """The tables (terms x columns) that ``run`` makes by ``by_term`` in each task, summed."""
    names = [f"n{k}" for k in range(shape[1])]
    parts = rows.mapInArrow(run, ", ".join(["term int", *(f"{n} double" for n in names)]))
    sums = parts.groupBy("term").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    found = np.zeros(shape)
    found[sums["term"].to_numpy()] = np.column_stack([sums[n].to_numpy() for n in names])
    return found


def one_pass(rows: DataFrame, weights: np.ndarray, alpha: np.ndarray, eta: float, limit: int) -> np.ndarray:
    """The topics' weights (topics x terms) after a pass over all documents ``rows`` (ids, counts)."""
    topics = np.ascontiguousarray(expected_log(weights).T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(topics)
        for batch in batches:
            infer(*flat(batch.column(0), batch.column(1)), topics, alpha, limit, total)
        yield from by_term(total)

    return eta + (summed(rows.select("ids", "counts"), run, topics.shape) * topics).T


def fit(rows: DataFrame, n_terms: int, alpha: np.ndarray, eta: float, passes: int, limit: int, seed: int) -> np.ndarray:
    """Weights of the topics after so many passes, from a seeded start."""
    weights = np.random.default_rng(seed).gamma(100.0, 0.01, (len(alpha), n_terms))
    for _ in range(passes):
        weights = one_pass(rows, weights, alpha, eta, limit)
    return weights


def likeliest(rows: DataFrame, key: str, weights: np.ndarray, alpha: np.ndarray, limit: int) -> DataFrame:
    """key, size, topic, p of every document: its likeliest topic (of equal ones the first); both null without a known term."""
    topics = np.ascontiguousarray(expected_log(weights).T)
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, size int, topic int, p double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, starts = flat(batch.column(2), batch.column(3))
            gamma, empty = infer(ids, counts, starts, topics, alpha, limit), np.diff(starts) == 0
            p = gamma.max(axis=1) / gamma.sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(gamma.argmax(axis=1), pa.int32(), mask=empty), pa.array(p, mask=empty)], names=[key, "size", "topic", "p"])

    return rows.select(key, "size", "ids", "counts").mapInArrow(run, schema)
