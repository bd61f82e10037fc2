"""Vectors packed into blocks, and a query set laid against all blocks.

``pack`` sorts the vectors by id into ranges and writes them as blocks of a few
thousand. ``against_all`` deals the blocks to shards and sends each pack of queries to
every shard. A shard's blocks come first and once; they are made ready once, then its packs stream past
them through a kernel that keeps the best k of each query; what shards found is merged by query. Tasks hold one
shard of bounded bytes, one pack and k rows per query of it; no vector is sent to the driver.

Rows that share an id count once: the first in the order of their vectors.
Vectors shorter than others are read as ending in zeros. Only ``vec_id`` and ``embedding`` are
read, so other columns may have any name.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Kept

BLOCK_ROWS, PACK_ROWS = 4096, 1024
#: Bytes of blocks per shard, all of which one join key brings together.
SHARD_BYTES = 64 << 20
_BLOB = "block long, n int, blob binary"


def dump(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def load(blob: bytes) -> dict[str, np.ndarray]:
    return dict(np.load(io.BytesIO(blob)))


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column as doubles padded with zeros, and which of them are finite throughout."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.fromiter((0 if s is None else s for s in column.value_lengths().to_pylist()), np.int64, len(column))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(column), width))
    inside = np.arange(width) < sizes[:, None]
    out[inside] = flat
    valid = np.array(column.is_valid().to_numpy(zero_copy_only=False), bool)
    return out, valid & np.isfinite(out).all(axis=1)


def widen(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=["block", "n", "blob"])


def _stream(batches: Iterator[pa.RecordBatch], least: Callable[[np.ndarray], np.ndarray], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors in runs of ``rows``, without invalid vectors and repeated ids."""
    ids, vectors, last = np.zeros(0, np.int64), np.zeros((0, 0)), None
    for b in batches:
        new = b.column(0).to_numpy(zero_copy_only=False)
        x, good = matrix(b.column(1))
        good &= least(x)
        new, x = new[good], x[good]
        if not len(new):
            continue
        first = np.concatenate([[last is None or new[0] != last], new[1:] != new[:-1]])
        last = new[-1]
        width = max(vectors.shape[1], x.shape[1])
        ids = np.concatenate([ids, new[first]])
        vectors = np.concatenate([widen(vectors, width), widen(x[first], width)])
        while len(ids) >= rows:
            yield ids[:rows], vectors[:rows]
            ids, vectors = ids[rows:], vectors[rows:]
    if len(ids):
        yield ids, vectors


def pack(vectors: DataFrame, build: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], takes: Callable[[np.ndarray], np.ndarray], name: str) -> Kept:
    """The table of blocks. ``takes`` tells which finite vectors take part, ``build`` makes a block's arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _stream(batches, takes, BLOCK_ROWS):
            yield _batch([(int(ids[0]), len(ids), dump(build(ids, x)))])

    thin = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter("vec_id is not null and embedding is not null")
    ranged = thin.repartitionByRange("vec_id").sortWithinPartitions("vec_id", "embedding")
    return Kept(ranged.mapInArrow(run, _BLOB), name)


def queries_of(blocks: Kept, every: int) -> DataFrame:
    """The vectors whose id is divisible by ``every``, one per row under its id; arrays ids and x."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                a = load(blob)
                chosen = np.flatnonzero(a["ids"] % every == 0)
                if len(chosen):
                    yield _batch([(int(a["ids"][k]), 1, dump({"ids": a["ids"][[k]], "x": a["x"][[k]]})) for k in chosen])

    return blocks.df.select("blob").mapInArrow(pick, _BLOB)


def packs_of(queries: DataFrame) -> DataFrame:
    """Query vectors joined into packs."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict[str, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            width = max(a["x"].shape[1] for a in waiting)
            ids = np.concatenate([a["ids"] for a in waiting])
            x = np.concatenate([widen(a["x"], width) for a in waiting])
            return _batch([(int(ids.min()), len(ids), dump({"ids": ids, "x": x}))])

        for b in batches:
            for blob in b.column("blob").to_pylist():
                waiting.append(load(blob))
                if len(waiting) == PACK_ROWS:
                    yield packed()
                    waiting = []
        if waiting:
            yield packed()

    return queries.repartition("block").mapInArrow(join, _BLOB)


class Best:
    """The best k of each query: highest score, then smallest id. Scores are of one kind, so that none is rounded."""

    def __init__(self, ids: np.ndarray, k: int, kind: type = np.float64):
        self.ids, self.k = ids, k
        self.scores: list[np.ndarray] = [np.zeros(0, kind) for _ in ids]
        self.found: list[np.ndarray] = [np.zeros(0, np.int64) for _ in ids]

    def bar(self, q: int):
        """The kth score, below which nothing enters; None while there are fewer."""
        return self.scores[q][-1] if len(self.scores[q]) == self.k else None

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if (bar := self.bar(q)) is not None:
            high = scores >= bar
            scores, ids = scores[high], ids[high]
        if len(scores) > 4 * self.k:  # all that reach the kth of the new ones, ties included
            high = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[high], ids[high]
        if len(scores):
            scores, ids = np.concatenate([self.scores[q], scores]), np.concatenate([self.found[q], ids])
            top = np.lexsort((-ids, scores))[::-1][: self.k]
            self.scores[q], self.found[q] = scores[top], ids[top]


#: Lays one pack (ids, vectors) against a shard that has been made ready, and offers what it finds.
Kernel = Callable[[np.ndarray, np.ndarray, Any, Best], None]


def against_all(blocks: Kept, packs: DataFrame, kernel: Kernel, k: int, exact: str, ready: Callable[[list[dict[str, np.ndarray]]], Any] = list) -> DataFrame:
    """query_id, rank, vec_id, score: the best k of every query among all vectors but its own id."""
    spark = blocks.spark
    size = blocks.df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.length("blob")), F.lit(0)).alias("bytes")).first()
    # each shard adds k rows per query: no more of them than bytes and cores ask for, and none of less than a full block
    shards = int(max(1, -(-size["bytes"] // SHARD_BYTES), min(2 * spark.sparkContext.defaultParallelism, -(-size["rows"] // BLOCK_ROWS))))
    asked = packs.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("turn"), "block", "blob")
    held = blocks.df.select(F.pmod(F.xxhash64("block"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("turn"), "block", "blob")
    lined = held.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("turn", "block")
    arrow = pa.int64() if exact == "long" else pa.float64()
    kind = np.int64 if exact == "long" else np.float64

    def rows(best: Best) -> pa.RecordBatch:
        sizes = [len(f) for f in best.found]
        flat = [np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.int64, best.found), (kind, best.scores))]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(best.ids, sizes), pa.int64()), pa.array(flat[0], pa.int64()), pa.array(flat[1], arrow)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, shard = [], None
        for b in batches:
            for turn, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                arrays = load(blob.as_py())
                if turn == 0:
                    mine.append(arrays)
                    continue
                if not mine:  # hashing left this shard empty
                    continue
                shard = ready(mine) if shard is None else shard
                best = Best(arrays["ids"], k, kind)
                kernel(arrays["ids"], arrays["x"], shard, best)
                yield rows(best)

    partial = lined.select("turn", "blob").mapInArrow(run, f"query_id long, vec_id long, score {exact}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return partial.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
