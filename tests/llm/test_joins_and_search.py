"""Near-duplicates, components, top-k and nearest neighbours against brute force."""

import random

import numpy as np
import pytest

from threadloom.llm import ann, components, near_dups, topk_search


def sets_of(texts):
    return {k: near_dups.shingle_set(near_dups.words_of(t)) for k, t in texts.items()}


def brute_components(texts):
    s = sets_of(texts)
    least = {k: k for k in texts}
    keys = sorted(texts)
    changed = True
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(np.union1d(s[a], s[b])) and 100 * len(np.intersect1d(s[a], s[b])) >= 75 * len(np.union1d(s[a], s[b]))]
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= (least[a], least[b]) != (m, m)
            least[a] = least[b] = m
    return {k: (len(s[k]), least[k]) for k in texts}


def family(rng, base, n, edits):
    """Copies of a text with some words changed."""
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.random()}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(4):
        texts += family(rng, [word() for _ in range(rng.randint(8, 200))], 12, 4)
    hub = [word() for _ in range(120)]
    texts += family(rng, hub, 120, 6)  # a group around the threshold, in long lists
    texts += [" ".join([word() for _ in range(50)] + passage + [word() for _ in range(50)]) for _ in range(60)]
    texts += [" ".join(word() for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 5000)] * 2
    texts += ["", "  \t\n", None, "A b C d e", "a B c D E", "a b c d", "a b c"]
    return dict(enumerate(texts, 100))


def run(spark, texts):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()], "doc_id long, text string, rep int, sign string")
    return {r["doc_id"]: r for r in near_dups.near_duplicates(df).collect()}


def test_near_duplicates_equal_brute_force(spark, corpus):
    got, want = run(spark, corpus), brute_components(corpus)
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == k) for k, r in got.items())


def test_long_lists_of_texts_that_share_a_passage_make_no_tiles(spark, docs, monkeypatch):
    passage = " ".join(f"shared{k}" for k in range(70))
    texts = [passage + " " + " ".join(f"own{d}x{k}" for k in range(70)) for d in range(600)]
    texts += [t.replace("x5 ", "x5 changed ") for t in texts[:200:20]]
    shipped = []
    plain = near_dups.long_list_links

    def counted(posts, *rest):
        shipped.append(posts.count())
        return plain(posts, *rest)

    monkeypatch.setattr(near_dups, "long_list_links", counted)
    monkeypatch.setattr(near_dups, "ROUNDS", 1)
    rows = near_dups.near_duplicates(docs(list(enumerate(texts)))).collect()
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert got == {d: d if d < 600 else (d - 600) * 20 for d in range(610)}
    assert shipped == [0]


def test_tiles_alone_find_the_same(spark, corpus, monkeypatch):
    """Every list in tiles of several chunks, without pivots."""
    monkeypatch.setattr(near_dups, "SHORT", 1)
    monkeypatch.setattr(near_dups, "ROUNDS", 0)
    monkeypatch.setattr(near_dups, "TILE_BYTES", 8_000)
    monkeypatch.setattr(near_dups, "TILE_ROWS", 10)
    got, want = run(spark, corpus), brute_components(corpus)
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == want


def test_near_duplicates_odd_tables(spark, docs):
    assert near_dups.near_duplicates(docs([])).count() == 0
    rows = near_dups.near_duplicates(docs([(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (7, "x"), (8, None)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 1, 0, False), (0, 1, 0, False), (5, 1, 5, True), (5, 1, 5, True), (7, 1, 7, True), (8, 0, 8, True)]


def test_one_document_stays(spark, docs):
    table = docs([(None, "a b c"), (3, "a b c"), (5, "A b c"), (5, "A b c"), (3, "a b c"), (9, None)])
    left = near_dups.drop_near_duplicates(table, near_dups.near_duplicates(table))
    assert left.columns == table.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == [(0, "a b c"), (3, "a b c"), (9, "")]


def test_dropping_is_the_same_in_every_layout(spark):
    """Rows that share id and text but not the rest: the row that stays does not hang on partitions, and odd names go along."""
    rows = [(k % 3, "a b c d e f", k, f"x{k}") for k in range(12)] + [(None, "t", 50, "y"), (None, "t", 51, "z"), (None, "u", 52, "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, row string")
    judged = near_dups.near_duplicates(table)
    seen = {tuple(sorted(map(tuple, near_dups.drop_near_duplicates(t, judged).collect()), key=str)) for t in (table, table.repartition(7), table.orderBy(table["`a.b`"].desc()).coalesce(1))}
    assert len(seen) == 1 and len(next(iter(seen))) == 3
    assert near_dups.drop_near_duplicates(table, judged).columns == table.columns


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_components(spark, one_task):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(60)] + [(7, 7), (500, 501), (501, 500)]
    least = {}
    for a, b in edges:
        if a != b:
            least.setdefault(a, a), least.setdefault(b, b)
    for _ in edges:
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    got = components.components(spark.createDataFrame(edges, "a long, b long"), one_task)
    assert {r["node"]: r["component"] for r in got.df.collect()} == least
    assert components.components(spark.createDataFrame([], "a long, b long"), one_task).df.count() == 0


# Vectors


def vectors(spark, x, extra=()):
    rows = [(int(k), [float(v) for v in r], "x", 1) for k, r in enumerate(x)] + [(*e, "x", 1) for e in extra]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int")


ODD = [(900, None), (950, [float("nan")] * 8), (1000, [1.0, None] * 4), (None, [1.0] * 8), (1050, []), (0, [9.0] * 8)]


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 8))
    x[300:500] = x[300]  # many equal vectors: ties go to the smaller id
    x[0] = -50
    got = topk_search.top_k(vectors(spark, x, ODD), k=5, every=50).collect()
    ints = {k: np.floor(256 * r).astype(int) for k, r in enumerate(x)} | {1050: np.zeros(8, int)}
    want = []
    for q in [k for k in ints if k % 50 == 0]:
        scores = sorted((-int(ints[q] @ v), k) for k, v in ints.items() if k != q)[:5]
        want += [(q, place + 1, k, -s) for place, (s, k) in enumerate(scores)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_pruning_skips_ranges():
    x = np.concatenate([np.full((64, 4), 1.0), np.full((640, 4), -1.0)])
    block = topk_search.build(np.arange(len(x)), x)
    from threadloom.llm.vector_blocks import Best

    seen = []

    class Counting(Best):
        def offer(self, q, scores, ids):
            seen.append(len(ids))
            super().offer(q, scores, ids)

    topk_search.search(np.array([-1]), np.full((1, 4), 256), [block], Counting(np.array([-1]), 5, np.int64))
    assert sum(seen) <= 64 * 2


def test_ranges_of_all_blocks_are_visited_in_one_order():
    low, high = np.full((640, 4), -1.0), np.full((64, 4), 1.0)
    blocks = [topk_search.build(np.arange(640), low), topk_search.build(np.arange(1000, 1064), high)]
    from threadloom.llm.vector_blocks import Best

    seen = []

    class Counting(Best):
        def offer(self, q, scores, ids):
            seen.extend(ids.tolist())
            super().offer(q, scores, ids)

    topk_search.search(np.array([-1]), np.full((1, 4), 256), blocks, Counting(np.array([-1]), 5, np.int64))
    assert min(seen) >= 1000


def test_top_k_of_large_components(spark):
    """Products beyond doubles' and 64-bit integers' exact range, with scores that fit; blocks of both kinds mix."""
    x = [[4e9, 0, 0, 0], [0, 4e9, 0, 0], [1, 1, 0, 0], [0, 0, 2.0**40, -(2.0**40)], [0, 0, 2.0**40, 2.0**40], [3, 2, 0, 0]]
    got = topk_search.top_k(spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>"), k=3, every=1).collect()
    ints = [[int(np.floor(256 * v)) for v in r] for r in x]
    want = []
    for q in range(len(x)):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], ints[k], strict=True)), k) for k in range(len(x)) if k != q)[:3]
        want += [(q, place + 1, k, -s) for place, (s, k) in enumerate(scores)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want
    with pytest.raises(Exception, match="64 bits"):
        topk_search.top_k(spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>"), k=1, every=1).collect()


def test_nearest_neighbours_of_extreme_vectors(spark):
    rng = np.random.default_rng(4)
    for width in (3, 64):
        x = rng.normal(size=(200, width))
        x[7, 0], x[8, 1], x[9, :2] = 1e200, -1e200, 1e-200
        rows = ann.neighbours(vectors(spark, x), k=5, every=20).collect()
        by = {}
        for r in rows:
            by.setdefault(r["query_id"], []).append(r["vec_id"])
        hits = 0
        for q in range(0, 200, 20):
            scores = x @ x[q]
            scores[q] = -np.inf
            assert len(by[q]) == 5
            hits += len(set(by[q]) & set(np.argsort(-scores, kind="stable")[:5].tolist()))
        assert hits >= 0.9 * 50


def test_queries_far_from_all_still_get_k(spark):
    x = np.vstack([np.tile(np.eye(16)[0], (300, 1)) + 0.01 * np.random.default_rng(5).normal(size=(300, 16)), -np.eye(16)[0]])
    rows = ann.neighbours(vectors(spark, x), k=20, every=300).collect()
    assert sorted(r["query_id"] for r in rows) == [0] * 20 + [300] * 20


def test_nearest_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[200:400] = x[200]
    x[60] = 0
    rows = ann.neighbours(vectors(spark, x, [(2000, None), (2020, [0.0] * 64), (2040, [float("inf")] * 64)]), k=20, every=20).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    queries = [q for q in range(0, 1200, 20) if q != 60]
    assert sorted(by) == queries and all(len(v) == 20 for v in by.values())
    hits = 0
    for q in queries:
        scores = x @ x[q]
        order = [k for k in np.lexsort((np.arange(len(x)), -np.round(scores, 12))) if k not in (q, 60)][:20]
        found = sorted(by[q])
        hits += len({k for _, k, _ in found} & set(order))
        assert all(abs(s - scores[k]) < 1e-12 for _, k, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
    assert hits / (20 * len(queries)) >= 0.9
    copies = [k for _, k, _ in sorted(by[200])]
    assert copies == list(range(201, 221))


def test_pigeonhole_retrieves_every_code():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, 500, dtype=np.uint64) & rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    codes = codes.reshape(250, 2)
    codes[100:120] = codes[:20]
    index = ann.Index([{"ids": np.arange(k, k + 125), "x": np.zeros((125, 1)), "codes": codes[k : k + 125]} for k in (0, 125)])
    for radius in (0, 3, 10, 30, 50, 61, 128):
        want = np.bitwise_count(codes[:40, None] ^ codes).sum(axis=2) <= radius
        got = np.zeros_like(want)
        at, rows, touched = index.retrieve(codes[:40].view(np.uint16), radius)
        got[at, rows] = True
        assert (got == want).all() and want.any()
        assert touched >= want.sum() and (radius > 10 or touched < 2500)


def test_empty_vector_tables(spark):
    empty = vectors(spark, np.zeros((0, 4)))
    assert topk_search.top_k(empty).count() == 0 and ann.neighbours(empty).count() == 0
    one = vectors(spark, np.ones((1, 4)))
    assert topk_search.top_k(one).count() == 0 and ann.neighbours(one).count() == 0
    low = vectors(spark, np.random.default_rng(0).normal(size=(50, 5)))
    assert ann.neighbours(low, k=3, every=10).count() == 15
