"""Exact top-k search by block-at-a-time pruning.

Components are floored to integers. A vector's terms are its dimensions with a
sign, so a range of documents has two maxima per dimension: of the value, and
of its negative. The sum over a query's terms of query weight times the range's
maximum bounds every score in the range. Ranges are visited in the order of
that bound, their forward index (the block of their vectors) scores whole
ranges, and the visit ends at the first bound below the kth score so far.

Within a packed block of ids, ranges of 64 are laid out by repeated median
splits on the dimension of greatest spread, so that their maxima are tight. A query visits the
ranges of all blocks of its shard in one order, so its kth score rises early.

Defined cases: vectors that are null or hold null or non-finite components take
no part, nor do null ids; see ``vector_blocks`` for repeated ids, unequal
lengths and other columns; ties go to the smaller id; fewer than k candidates give fewer rows; an
empty table gives an empty result. Where products could pass 64 bits, scores are summed in Python's integers
without pruning; a score that does pass them, or a component beyond a double's range when scaled, is an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .vector_blocks import Best, against_all, pack, packs_of, queries_of, widen

RANGE, SCALE = 64, 256


def _by_median(x: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    if len(rows) <= RANGE:
        return [rows]
    part = x[rows]
    spread = part.max(0) - part.min(0)
    if not spread.size or not spread.any():
        return [rows[k : k + RANGE] for k in range(0, len(rows), RANGE)]
    half = (len(rows) // 2 + RANGE - 1) // RANGE * RANGE
    order = rows[np.argsort(part[:, int(spread.argmax())], kind="stable")]
    return _by_median(x, order[:half]) + _by_median(x, order[half:])


def build(ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """A block: integer vectors in ranges, with the maxima of each range's terms."""
    with np.errstate(over="ignore"):
        x = np.floor(vectors * SCALE)  # whole numbers, exact as doubles
    if not np.isfinite(x).all():
        raise ValueError("a scaled component is beyond the range of doubles")
    ranges = _by_median(x, np.arange(len(ids)))
    order = np.concatenate(ranges)
    starts = np.cumsum([0, *map(len, ranges)])
    top, low = (np.array([f(x[r], axis=0) for r in ranges]).reshape(len(ranges), x.shape[1]) for f in (np.max, np.min))
    most = np.abs(x).max(initial=1)
    if most < 2**31:
        x, top, low = (v.astype(np.min_scalar_type(-int(most) - 1)) for v in (x, top, low))
    return {"ids": ids[order], "x": x[order], "starts": starts, "top": top, "low": low}


def _in_python(own: int, query: np.ndarray, block: dict[str, np.ndarray], best: Best, k: int) -> None:
    """Scores of a whole block in integers of any size."""
    weights = [int(w) for w in query]
    others = np.flatnonzero(block["ids"] != own)
    scores = [sum(w * int(v) for w, v in zip(weights, row, strict=False)) for row in block["x"][others]]
    if any(not -(2**63) <= s < 2**63 for s in scores):
        raise ValueError("a score does not fit 64 bits")
    best.offer(k, np.array(scores, np.int64), block["ids"][others])


def search(query_ids: np.ndarray, queries: np.ndarray, blocks: list[dict[str, np.ndarray]], best: Best) -> None:
    """Offer each query the candidates of all blocks, ranges with the highest bound first."""
    width = max(queries.shape[1], *(b["x"].shape[1] for b in blocks))
    most = [float(np.abs(a.astype(np.float64)).max(initial=0)) for a in (queries, *(b["x"] for b in blocks))]
    largest = most[0] * max(most[1:]) * max(1, width)
    if largest >= 2**62:
        for k, own in enumerate(query_ids):
            for b in blocks:
                _in_python(own, queries[k], b, best, k)
        return
    exact = np.float64 if largest < 2**53 else np.int64  # sums of integers below 2^53 are exact in doubles
    q = widen(queries, width).astype(exact)
    top, low = (np.concatenate([widen(b[name], width).astype(exact) for b in blocks]) for name in ("top", "low"))
    bounds = np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T
    parts = [(b["x"][s:e], b["ids"][s:e]) for b in blocks for s, e in zip(b["starts"][:-1], b["starts"][1:], strict=True)]
    visit = np.argsort(-bounds, axis=1, kind="stable")
    for k, own in enumerate(query_ids):
        at, step = 0, 1
        while at < visit.shape[1]:
            bar = best.bar(k)
            turn = visit[k, at : at + step]
            if bar is not None:
                turn = turn[bounds[k, turn] >= bar]
                if not len(turn):
                    break
            ids = np.concatenate([parts[r][1] for r in turn])
            x = np.concatenate([widen(parts[r][0], width) for r in turn]).astype(exact)
            others = ids != own
            best.offer(k, (x @ q[k])[others].astype(np.int64), ids[others])
            at, step = at + step, min(64, 2 * step)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``, against all others."""
    blocks = pack(vectors, build, lambda x: np.ones(len(x), bool), "topk")
    return against_all(blocks, packs_of(queries_of(blocks, every)), search, k, "long")
