"""Approximate nearest neighbours by multi-index hashing, reranked by exact inner products.

Codes are ``BITS`` signs of learned rotations: on a bounded sample the vectors are
centred and reduced by principal components where they have more dimensions
than bits, and rotations are fitted that bring them near their signs, several where they have
fewer. A code is split into ``PARTS`` substrings of 16 bits, each with an index of its own over
all rows of a shard: rows in the order of their value, and where each of the 65,536 values begins. Within Hamming
radius r = PARTS s + a, two codes agree up to s bits in one of
the first a + 1 substrings or up to s - 1 in one of the others, so probing those
values retrieves every code within the radius. A query's values are made by flips of its substring, or, where
fewer values than flips are occupied, chosen among the occupied ones. Only rows posted under a probed value are touched; those within
the radius on the whole code are reranked by their vectors.

The radius comes from exact neighbours of a bounded set of calibration rows
among all rows: the least one that holds ``HELD`` of them. Queries that find fewer than k
rows within it, in the whole table, are searched again without a radius, so no bucket or candidate list is capped.

Defined cases: vectors that are null, zero or hold null or non-finite
components take no part, nor do null ids; see ``vector_blocks`` for repeated ids,
unequal lengths and other columns; components of any finite size are coded by their direction; a product beyond the
range of doubles is infinite, and one without a value (infinities of both signs) counts as the least;
ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep
from .vector_blocks import Best, Kept, against_all, load, matrix, pack, packs_of, queries_of, widen

BITS, PARTS = 128, 8
VALUES = 1 << 16
#: Rows that the rotation is fitted on, and rows whose exact neighbours set the radius.
SAMPLE_ROWS, CALIBRATION_ROWS, HELD = 8192, 128, 0.94
#: Queries times rows of a shard that are probed together, and pairs whose products are summed at once.
_PROBING, _PAIRS = 1 << 20, 1 << 16
#: Flips of a substring, those of fewer bits first, and how many have at most 0, 1, ... bits.
_FLIPS = np.argsort(np.bitwise_count(np.arange(VALUES, dtype=np.uint16)), kind="stable").astype(np.uint16)
_UP_TO = np.cumsum(np.bincount(np.bitwise_count(_FLIPS), minlength=17))


def _greatest(x: np.ndarray) -> np.ndarray:
    """The largest magnitude in each row, as a column; 1 for rows of zeros."""
    m = np.abs(x).max(axis=1, initial=0, keepdims=True)
    return np.where(m > 0, m, 1.0)


@dataclass
class Coder:
    mean: np.ndarray
    axes: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Rows of ``PARTS`` substrings of 16 bits. Each row is scaled, which leaves the signs as they are."""
        width = len(self.mean)
        near = widen(x, width)[:, :width]
        size = np.maximum(_greatest(near), np.abs(self.mean).max(initial=0))
        bits = (near / size - self.mean / size) @ self.axes >= 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint16)


def learn(sample: np.ndarray, rounds: int = 30, seed: int = 11) -> Coder:
    """Rotations of the sample towards its signs; several where it has fewer than ``BITS`` dimensions.

    Rows whose largest magnitude is far above the median are shortened for the fit.
    """
    rng = np.random.default_rng(seed)
    size = _greatest(sample)
    typical = float(np.median(size))
    near = sample / size * np.minimum(size / typical, 10.0)
    mean = near.mean(0)
    centred = near - mean
    _, _, axes = np.linalg.svd(centred.T @ centred)
    basis = axes[:BITS].T
    v = centred @ basis
    turns = []
    for _ in range(-(-BITS // v.shape[1])):
        r, _ = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))
        for _ in range(rounds):
            u, _, wt = np.linalg.svd(v.T @ np.where(v @ r >= 0, 1.0, -1.0))
            r = u @ wt
        turns.append(basis @ r)
    return Coder(mean * typical, np.concatenate(turns, axis=1)[:, :BITS])


def build(coder: Coder, ids: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """A block with its codes."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return {"ids": ids, "x": short if (short == x).all() else x, "codes": coder.codes(x).view(np.uint64)}


class Index:
    """All rows of a shard, and per substring the rows in the order of its value with the first place of every value."""

    def __init__(self, blocks: list[dict[str, np.ndarray]]):
        width = max(b["x"].shape[1] for b in blocks)
        self.ids = np.concatenate([b["ids"] for b in blocks])
        self.x = np.concatenate([widen(b["x"], width) for b in blocks])
        self.codes = np.concatenate([b["codes"] for b in blocks])
        parts = self.codes.view(np.uint16)
        self.rows, self.begins, self.occupied = [], [], []
        for p in range(PARTS):
            sizes = np.bincount(parts[:, p], minlength=VALUES)
            self.rows.append(np.argsort(parts[:, p], kind="stable").astype(np.int32))
            self.begins.append(np.concatenate([[0], np.cumsum(sizes)]))
            self.occupied.append(np.flatnonzero(sizes).astype(np.uint16))

    def _posted(self, p: int, part: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a row whose substring p is within so many bits of the query's."""
        if _UP_TO[bits] < len(self.occupied[p]):
            at = np.repeat(np.arange(len(part)), _UP_TO[bits])
            values = (part[:, None] ^ _FLIPS[None, : _UP_TO[bits]]).ravel()
        else:
            at, v = np.nonzero(np.bitwise_count(part[:, None] ^ self.occupied[p]) <= bits)
            values = self.occupied[p][v]
        first = self.begins[p][values]
        sizes = self.begins[p][values.astype(np.int32) + 1] - first
        ends = np.cumsum(sizes)
        places = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.repeat(at, sizes), self.rows[p][places]

    def retrieve(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Pairs of a code and a row within the radius, by code, and how many pairs were touched for them."""
        s, a = divmod(min(radius, BITS), PARTS)
        hit = np.zeros((len(code), len(self.ids)), bool)
        for p in range(PARTS):
            allowed = s if p <= a else s - 1
            if allowed >= 0:
                hit[self._posted(p, code[:, p], min(allowed, 16))] = True
        at, rows = np.divmod(np.flatnonzero(hit), hit.shape[1])
        whole = code.view(np.uint64)
        apart = sum(np.bitwise_count(whole[:, w][at] ^ self.codes[:, w][rows]).astype(np.int16) for w in range(whole.shape[1]))
        within = apart <= radius
        return at[within], rows[within], len(at)


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row inner products, summed in the same order for equal rows."""
    width = max(q.shape[1], x.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        out = (widen(q, width).astype(np.float64, copy=False) * widen(x, width)).sum(axis=1)
    return np.where(np.isnan(out), -np.inf, out)


def search(coder: Coder, radius: int, query_ids: np.ndarray, queries: np.ndarray, index: Index, best: Best) -> None:
    codes = coder.codes(queries)
    step = max(1, _PROBING // len(index.ids))
    for start in range(0, len(query_ids), step):
        at, rows, _ = index.retrieve(codes[start : start + step], radius)
        other = index.ids[rows] != query_ids[start + at]
        at, rows = at[other], rows[other]
        scores = np.concatenate([np.zeros(0)] + [inner(queries[start + at[c : c + _PAIRS]], index.x[rows[c : c + _PAIRS]]) for c in range(0, len(at), _PAIRS)])
        cut = np.searchsorted(at, np.arange(len(codes[start : start + step]) + 1))
        for q in range(len(cut) - 1):
            best.offer(start + q, scores[cut[q] : cut[q + 1]], index.ids[rows[cut[q] : cut[q + 1]]])


def _sample(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a bounded sample, by hash order of the id."""
    order = F.xxhash64("vec_id", F.lit("sample"))
    rows = vectors.filter("vec_id is not null and embedding is not null").select("vec_id", "embedding").orderBy(order, "vec_id", "embedding").limit(SAMPLE_ROWS).toArrow()
    x, good = matrix(rows.column(1).combine_chunks())
    good &= x.any(axis=1)
    return rows.column(0).to_numpy()[good], x[good]


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``, against all others."""
    ids, x = _sample(vectors)
    coder = learn(x) if len(x) else Coder(np.zeros(0), np.zeros((0, BITS)))
    blocks = pack(vectors, lambda i, v: build(coder, i, v), lambda v: v.any(axis=1), "ann")
    radius = calibrate(blocks, coder, ids[:CALIBRATION_ROWS], x[:CALIBRATION_ROWS], k)
    asked = keep(queries_of(blocks, every), "queries")

    def within(queries: DataFrame, r: int) -> DataFrame:
        return against_all(blocks, packs_of(queries), lambda i, q, shard, best: search(coder, r, i, q, shard, best), k, "double", Index)

    found = keep(within(asked, radius), "near")
    others = blocks.df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] - 1
    enough = found.groupBy(F.col("query_id").alias("block")).agg(F.count("*").alias("found")).filter(F.col("found") >= min(k, others))
    short = keep(asked.join(enough, "block", "left_anti").select(*asked.columns), "short")
    if short.isEmpty():
        return found
    return found.join(short.select(F.col("block").alias("query_id")), "query_id", "left_anti").unionByName(within(short, BITS))


def calibrate(blocks: Kept, coder: Coder, ids: np.ndarray, x: np.ndarray, k: int) -> int:
    """The least radius holding the wanted share of the exact neighbours of the calibration rows."""
    if not len(ids):
        return 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = coder.codes(x).view(np.uint64)
        score, bits = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int32)
        for b in batches:
            for blob in b.column(0).to_pylist():
                block = load(blob)
                width = max(x.shape[1], block["x"].shape[1])
                with np.errstate(over="ignore", invalid="ignore"):
                    new = widen(x, width) @ widen(block["x"], width).astype(np.float64).T
                new = np.where(np.isnan(new) | (ids[:, None] == block["ids"]), -np.inf, new)
                top = np.argsort(-new, axis=1, kind="stable")[:, :k]
                apart = np.bitwise_count(codes[:, None, :] ^ block["codes"][top]).sum(axis=2, dtype=np.int32)
                score, bits = np.concatenate([score, np.take_along_axis(new, top, 1)], 1), np.concatenate([bits, apart], 1)
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                score, bits = np.take_along_axis(score, top, 1), np.take_along_axis(bits, top, 1)
        q, at = np.nonzero(score > -np.inf)
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in ((q, pa.int32()), (score[q, at], pa.float64()), (bits[q, at], pa.int32()))], names=["q", "score", "bits"])

    found = blocks.df.select("blob").mapInArrow(run, "q int, score double, bits int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "bits"))
    bits = [r["bits"] for r in found.withColumn("rank", rank).filter(F.col("rank") <= k).select("bits").collect()]
    return int(np.quantile(bits, HELD, method="higher")) if bits else 0
