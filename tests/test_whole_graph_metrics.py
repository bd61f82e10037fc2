"""Paths, centralities, communities and walks as join plans, against plain one-machine versions."""

import math
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest

from plain_graphs import Graph, communities
from threadloom.operators import embeddings, louvain, paths, quality, spectral

SCHEMA = "method string, snapshot long, src string, dst string, weight double"


def tangle(spark, seed, n=24, share=0.15, whole=True):
    """Three random graphs, one of them in parts, as rows and as plain graphs by snapshot."""
    rng = random.Random(seed)
    rows, plain = [], {}
    for k in range(3):
        weight = lambda: float(rng.randint(1, 4)) if whole else rng.random() + 0.01
        own = [(f"n{a:02}", f"n{b:02}", weight()) for a in range(n) for b in range(a) if rng.random() < share / (k + 1)]
        rows += [("m", k, *r) for r in own]
        names = sorted({x for r in own for x in r[:2]})
        number = {x: i for i, x in enumerate(names)}
        plain[k] = Graph(names, np.array([number[r[0]] for r in own]), np.array([number[r[1]] for r in own]), np.array([r[2] for r in own]))
    return spark.createDataFrame(rows, SCHEMA), plain


def distances_by_hand(g):
    inside, between, out = g.largest(), np.zeros(g.n), {}
    for s in range(g.n):
        dist, share = g.paths_from(s)
        for v, x in share.items():
            between[v] += x
        out[g.names[s]] = (sum(dist.values()), max(dist.values())) if inside[s] else (None, None)
    size = int(inside.sum())
    pairs = max((g.n - 1) * (g.n - 2), 1)
    return {name: (far, most, None if far is None else round((size - 1) / far, 6), round(between[i] / pairs, 6)) for i, (name, (far, most)) in enumerate(out.items())}


@pytest.mark.parametrize(("seed", "pack", "whole"), [(1, 10**9, True), (2, 300, True), (3, 10**9, False)])
def test_distances_and_betweenness(spark, seed, pack, whole):
    edges, plain = tangle(spark, seed, whole=whole)
    got = {(r["snapshot"], r["node"]): (r["far"], r["eccentricity"], r["closeness"], r["betweenness"]) for r in paths.distance_metrics(edges, pack_pairs=pack).collect()}
    want = {(k, node): v for k, g in plain.items() for node, v in distances_by_hand(g).items()}
    assert got.keys() == want.keys()
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=2e-6), key


def test_a_narrow_bucket_gives_the_same(spark, monkeypatch):
    edges, _ = tangle(spark, 4)
    whole = {tuple(r) for r in paths.distance_metrics(edges, between=False).collect()}
    told = paths.tentative
    monkeypatch.setattr(paths, "tentative", lambda sources, adjacency, widths: told(sources, adjacency, dict.fromkeys(widths, 0.5)))
    assert {tuple(r) for r in paths.distance_metrics(edges, between=False).collect()} == whole


def test_weights_have_to_be_positive(spark):
    with pytest.raises(ValueError, match="positive"):
        paths.distance_metrics(spark.createDataFrame([("m", 0, "a", "b", 0.0)], SCHEMA))


def test_null_keys_are_a_graph(spark):
    (row,) = paths.path_summary(paths.distance_metrics(spark.createDataFrame([(None, None, "a", "b", 2.0)], SCHEMA))).collect()
    assert tuple(row) == (None, None, 2.0, 2.0)


def test_eigenvector(spark):
    edges, plain = tangle(spark, 5)
    got = {(r["snapshot"], r["node"]): r["eigenvector"] for r in spectral.eigenvector(edges).collect()}
    for k, g in plain.items():
        want = g.eigenvector()
        for name, x in zip(g.names, want, strict=True):
            assert got[k, name] == (None if math.isnan(x) else pytest.approx(x, abs=2e-6))
    assert {r["eigenvector"] for r in spectral.eigenvector(edges, rounds=1).collect()} == {None}


def local_modularity(spark, edges, plain):
    rows = []
    for k, g in plain.items():
        near = [dict(zip(*g.near(u), strict=True)) for u in range(g.n)]
        rows += [("m", k, name, c) for name, c in zip(g.names, communities(near, 42), strict=True)]
    return {r["snapshot"]: r["modularity"] for r in quality.modularity(edges, spark.createDataFrame(rows, "method string, snapshot long, node string, cluster long")).collect()}


def test_communities_are_as_good_as_those_of_one_task(spark):
    edges, plain = tangle(spark, 6)
    got = {r["snapshot"]: r["modularity"] for r in quality.modularity(edges, louvain.louvain(edges)).collect()}
    want = local_modularity(spark, edges, plain)
    assert all(got[k] >= want[k] - 0.005 for k in want) and sum(got.values()) >= sum(want.values()) - 1e-6


def test_communities_are_the_best_of_a_small_graph(spark):
    pairs = [("a", "b", 3.0), ("b", "c", 1.0), ("a", "c", 2.0), ("c", "d", 0.5), ("d", "e", 2.0), ("e", "f", 2.0), ("d", "f", 1.0)]
    names, total = "abcdef", 2 * sum(w for *_, w in pairs)
    strength = Counter()
    for a, b, w in pairs:
        strength[a] += w
        strength[b] += w

    def q(member):
        of = dict(zip(names, member, strict=True))
        inside = sum(2 * w for a, b, w in pairs if of[a] == of[b]) / total
        return inside - sum((sum(strength[x] for x in names if of[x] == c) / total) ** 2 for c in set(member))

    best = max(q(m) for m in product(range(3), repeat=6))
    edges = spark.createDataFrame([("m", 0, *p) for p in pairs], SCHEMA)
    found = {r["node"]: r["cluster"] for r in louvain.louvain(edges).collect()}
    assert found == {**dict.fromkeys("abc", "a"), **dict.fromkeys("def", "d")} and q([found[x] for x in names]) == pytest.approx(best)


def share_of(walks, step):
    """How often a walk goes from one node by ``step``: (before, at, after) triples counted by what the step says of them."""
    seen = Counter(step(*w[i : i + 3]) for w in walks for i in range(len(w) - 2))
    return {k: v / sum(seen.values()) for k, v in seen.items()}


def test_walks_follow_weights(spark):
    edges = spark.createDataFrame([("m", 0, "hub", "a", 1.0), ("m", 0, "hub", "b", 10.0), ("m", 0, "hub", "c", 2.5)], SCHEMA)
    walks = [r["walk"] for r in embeddings.random_walks(edges, length=11, walks=400).collect()]
    assert len(walks) == 1600 and {len(w) for w in walks} == {11}
    after = Counter(w[i + 1] for w in walks for i in range(10) if w[i] == "hub")
    total = sum(after.values())
    assert [after[x] / total for x in "abc"] == pytest.approx([1 / 13.5, 10 / 13.5, 2.5 / 13.5], abs=0.02)


@pytest.mark.parametrize(("p", "q"), [(1.0, 1.0), (0.25, 1.0), (4.0, 0.5), (1.0, 4.0)])
def test_walks_follow_p_and_q(spark, p, q):
    """From x, reached from a: back to a, on to b (a neighbour of a), or away to c."""
    edges = spark.createDataFrame([("m", 0, *e, 1.0) for e in (("a", "x"), ("a", "b"), ("b", "x"), ("c", "x"))], SCHEMA)
    walks = [r["walk"] for r in embeddings.random_walks(edges, length=9, walks=400, p=p, q=q).collect()]
    after = Counter(w[i + 2] for w in walks for i in range(7) if w[i] == "a" and w[i + 1] == "x")
    total, mass = sum(after.values()), 1 / p + 1 + 1 / q
    assert [after[k] / total for k in "abc"] == pytest.approx([1 / p / mass, 1 / mass, 1 / q / mass], abs=0.06)


def test_walks_agree_between_runs(spark):
    edges, _ = tangle(spark, 7, n=10)
    one, two = (sorted(map(str, embeddings.random_walks(edges, length=5, walks=3).collect())) for _ in range(2))
    assert one == two
