"""Graph metrics on graphs small enough to work out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from threadloom.operators import edges as E, louvain, paths, spectral
from threadloom.operators import graphs, interactions, links, quality, ranking, temporal

# The hand-checked graph, labels and clusters described in FIXTURES.md.
NETWORK = [("subA", "subB", 5.0), ("subB", "subC", 10.0), ("subC", "subD", 3.0), ("subD", "subE", 2.0), ("subE", "subF", 7.0), ("subG", "subH", 4.0)]
PARTY = {"subA": "dem", "subB": "dem", "subF": "dem", "subC": "rep", "subD": "rep", "subE": "rep", "subG": "neutral", "subH": "neutral", "subNonExistent": "dem"}
CLUSTER = {"subA": 0, "subB": 0, "subE": 0, "subC": 1, "subD": 1, "subF": 1, "subG": 2, "subH": 2, "subMissing": 0}


def graph(spark, rows, method="m", snapshot=0):
    return spark.createDataFrame([(method, snapshot, *r) for r in rows], "method string, snapshot long, src string, dst string, weight double")


def only(df):
    return df.collect()[0].asDict()


def test_partition_quality(spark):
    clusters = spark.createDataFrame(list(CLUSTER.items()), "node string, cluster int")
    labels = spark.createDataFrame(list(PARTY.items()), "node string, label string")
    table = quality.contingency(clusters, labels)
    assert only(quality.purity(table))["purity"] == 0.75
    assert only(quality.nmi(table))["nmi"] == pytest.approx(0.558873, abs=1e-6)
    assert only(quality.modularity(graph(spark, NETWORK), clusters))["modularity"] == pytest.approx(-0.010926, abs=1e-6)
    three = [(n, c) for n, c in CLUSTER.items() if n in ("subA", "subB", "subC")]
    table = quality.contingency(spark.createDataFrame(three, "node string, cluster int"), labels)
    assert only(quality.purity(table))["purity"] == 1 and only(quality.nmi(table))["nmi"] == 1


def test_constant_labels(spark):
    table = spark.createDataFrame([("0", "a", 3)], "cluster string, label string, n long")
    assert only(quality.nmi(table))["nmi"] == 1.0


def test_counts_clustering_triangles(spark):
    g = graph(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 1.0)])
    assert only(graphs.counts(g)) == {"method": "m", "snapshot": 0, "num_nodes": 4, "num_edges": 4, "density": pytest.approx(2 / 3, abs=1e-6)}
    assert only(graphs.clustering(g))["avg_clustering"] == pytest.approx((1 + 1 + 1 / 3 + 0) / 4, abs=1e-6)
    assert {r["node"] for r in graphs.triangles(g).collect()} == {"a", "b", "c"}


def test_components_and_paths(spark):
    g = graph(spark, NETWORK)
    found = {r["node"]: r["component"] for r in graphs.components(g).collect()}
    assert found == {**dict.fromkeys(("subA", "subB", "subC", "subD", "subE", "subF"), "subA"), "subG": "subG", "subH": "subG"}
    assert only(graphs.largest_component(graphs.components(g))) == {"method": "m", "snapshot": 0, "component": "subA", "size": 6, "is_connected": False}
    m = paths.distance_metrics(g).cache()
    s = only(paths.path_summary(m))
    line = [0, 5, 15, 18, 20, 27]
    total = sum(abs(a - b) for a in line for b in line)
    assert s["avg_shortest_path"] == pytest.approx(total / 30, abs=1e-6) and s["diameter"] == 27
    rows = {r["node"]: r for r in m.collect()}
    assert rows["subG"]["closeness"] is None and rows["subA"]["closeness"] == pytest.approx(5 / sum(line), abs=1e-6)
    # in a path of six, the third node lies between 2 * 3 pairs, each in two orders
    assert rows["subC"]["betweenness"] == pytest.approx(12 / (7 * 6), abs=1e-6)


def test_components_by_labels_equal_those_by_tasks(spark):
    import random

    rng = random.Random(8)
    rows = [(f"n{rng.randrange(80):02}", f"n{rng.randrange(80):02}", 1.0) for _ in range(70)]
    g = graph(spark, [r for r in rows if r[0] != r[1]]).unionByName(graph(spark, NETWORK, snapshot=1))
    one, many = (sorted(map(tuple, graphs.components(g, one_task=n).collect())) for n in (10**6, 0))
    assert one == many and len({r[3] for r in one}) > 3


def test_path_counts_split_over_equal_paths(spark):
    square = graph(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("a", "d", 1.0)])
    assert {r["betweenness"] for r in paths.distance_metrics(square).collect()} == {round(1 / 6, 6)}


def test_hops(spark):
    g = graph(spark, NETWORK)
    sources = spark.createDataFrame([("m", 0, "subA"), ("m", 0, "absent")], "method string, snapshot long, source string")
    found = {r["node"]: r["hops"] for r in graphs.hop_distances(g, sources, E.GRAPH).collect()}
    assert found == {"subA": 0, "subB": 1, "subC": 2, "subD": 3, "subE": 4, "subF": 5}


def test_louvain_finds_cliques(spark):
    clique = lambda names: [(a, b, 1.0) for i, a in enumerate(names) for b in names[i + 1 :]]
    g = graph(spark, clique("abcde") + clique("vwxyz") + [("a", "z", 1.0)])
    found = {r["node"]: r["cluster"] for r in louvain.louvain(g).collect()}
    assert len(set(found.values())) == 2 and len({found[n] for n in "abcde"}) == 1
    q = only(quality.modularity(g, louvain.louvain(g)))["modularity"]
    alone = only(quality.modularity(g, spark.createDataFrame([], "node string, cluster int")))["modularity"]
    assert q > 0.4 > alone


def test_empty_graph(spark):
    g = graph(spark, [])
    for f in (graphs.counts, graphs.clustering, graphs.components, paths.distance_metrics, spectral.eigenvector, louvain.louvain):
        assert f(g).count() == 0


def test_canonical_edges(spark):
    g = graph(spark, [("b", "a", 2.0), ("a", "b", 3.0), ("a", "a", 9.0)])
    assert [(r["src"], r["dst"], r["weight"]) for r in E.canonical(g).collect()] == [("a", "b", 3.0)]


def test_turnover_of_equal_and_empty_snapshots(spark):
    g = graph(spark, [("a", "b", 1.0)]).unionByName(graph(spark, [("a", "b", 5.0)], snapshot=1))
    calendar = spark.createDataFrame([(k,) for k in range(4)], "snapshot long")
    rows = {r["t1"]: r for r in temporal.turnover(g, calendar).collect()}
    assert rows[0]["edge_jaccard"] == 1 and rows[0]["volatility"] == 0
    assert rows[1]["edge_jaccard"] == 0 and rows[1]["volatility"] == 1 and rows[1]["disappearing_nodes"] == 2
    assert rows[2]["edge_jaccard"] == 0 and rows[2]["volatility"] == 0


def test_expanding_train_keeps_latest_weight(spark):
    g = graph(spark, [("a", "b", 1.0)]).unionByName(graph(spark, [("a", "b", 5.0), ("b", "c", 1.0)], snapshot=1)).unionByName(graph(spark, [("c", "d", 1.0)], snapshot=2))
    rows = sorted((r["test"], r["src"], r["weight"]) for r in E.expanding_train(g).collect())
    assert rows == [(1, "a", 1.0), (2, "a", 5.0), (2, "b", 1.0)]


def test_features_of_missing_nodes_and_samplers(spark):
    train = graph(spark, [("a", "b", 1.0), ("b", "c", 1.0)]).withColumnRenamed("snapshot", "test")
    pairs = spark.createDataFrame([("m", 0, "a", "c"), ("m", 0, "a", "zz")], "method string, test long, u string, v string")
    rows = {r["v"]: r for r in links.features(pairs, train).collect()}
    assert rows["c"]["cn"] == 1 and rows["c"]["jaccard"] == 1 and rows["c"]["aa"] == pytest.approx(1 / math.log(2)) and rows["c"]["pa"] == 1
    assert rows["zz"]["cn"] == 0 and rows["zz"]["jaccard"] == 0 and rows["zz"]["pa"] == 0
    for sampler in links.SAMPLERS.values():  # more negatives asked for than there are
        assert [(r["u"], r["v"]) for r in sampler(train, 10).collect()] == [("a", "c")]


def test_uniform_negatives_are_good_distinct_and_as_many_as_asked(spark):
    import random

    rng = random.Random(7)
    made = {}
    for key, n, share in (("even", 24, 0.2), ("odd", 25, 0.6), ("two", 2, 1.0), ("dense", 12, 0.95)):
        names = [f"{key}{k}" for k in range(n)]
        made[key] = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < share] or [(names[0], names[1])]
    train = spark.createDataFrame([(key, 1, *sorted(p), 1.0) for key, pairs in made.items() for p in pairs], "method string, test long, src string, dst string, weight double")
    for n in (1, 10, 400):
        for name, sampler in links.SAMPLERS.items():
            got = [(r["method"], r["u"], r["v"]) for r in sampler(train, n).collect()]
            assert len(set(got)) == len(got), name
            for key, pairs in made.items():
                nodes = sorted({x for p in pairs for x in p})
                near = {x: {y for p in pairs if x in p for y in p if y != x} for x in nodes}
                free = {(u, v) for i, u in enumerate(nodes) for v in nodes[i + 1 :] if v not in near[u]}
                mine = [(u, v) for k, u, v in got if k == key]
                pool = {p for p in free if near[p[0]] & near[p[1]]} if name == "distance2" else free
                assert set(mine) <= pool and len(mine) == min(n, len(pool)), (name, key)
                if name == "hard" and mine:
                    cn = {p: len(near[p[0]] & near[p[1]]) for p in free}
                    assert sorted((cn[p] for p in mine), reverse=True) == sorted(cn.values(), reverse=True)[: len(mine)]


def test_uniform_negatives_are_even(spark):
    """Over many seeds every unlinked pair comes up about as often."""
    train = spark.createDataFrame([("m", 1, f"n{k}", f"n{k + 1}", 1.0) for k in range(7)], "method string, test long, src string, dst string, weight double")
    seen = {}
    for seed in range(40):
        for r in links.uniform(train, 5, seed).collect():
            seen[r["u"], r["v"]] = seen.get((r["u"], r["v"]), 0) + 1
    assert len(seen) == 21 and max(seen.values()) < 25


def test_ranking_with_ties(spark):
    rows = spark.createDataFrame([("g", "a", "x", 1, 0.9), ("g", "b", "x", 0, 0.9), ("g", "c", "x", 1, 0.5), ("g", "d", "x", 0, 0.1)], "key string, u string, v string, label int, score double")
    r = only(ranking.evaluate(rows, ["key"], [2]))
    assert r["auc"] == pytest.approx((0.5 + 1 + 0 + 1) / 4) and r["ap"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3, abs=1e-6)
    assert r["p_at_2"] == 0.5 and r["r_at_2"] == 0.5


def test_sentiment_edges_edge_cases(spark):
    rows = [("x", "k1", 5), ("x", "k2", 9), ("x", "k3", 1), ("y", "k1", None), ("y", "k2", 0), ("[deleted]", "k1", 9), (None, "k1", 9), ("bot", "k1", 9), ("bot", "k2", 9)]
    c = spark.createDataFrame([(0, *r) for r in rows], "snapshot long, author string, community string, score long")
    clean = interactions.clean_comments(c, spark.createDataFrame([("bot",)], "author string"))
    assert [(r["src"], r["dst"], r["weight"]) for r in interactions.sentiment_edges(clean).collect()] == [("k1", "k2", 2)]
    assert sorted((r["src"], r["dst"], r["weight"]) for r in interactions.cocomment_edges(clean).collect()) == [("k1", "k2", 2), ("k1", "k3", 1), ("k2", "k3", 1)]


def test_panel_needs_every_year_of_some_group(spark):
    rows = [(y, "a", "dem", 1.0) for y in (2017, 2018, 2019)] + [(y, "a", "rep", 2.0) for y in (2018, 2019)] + [(2019, "b", "dem", 1.0)] + [(y, "c", "gun", 1.0) for y in (2018, 2019)]
    panel = spark.createDataFrame(rows, "yr long, source string, target_group string, avg_hops double")
    got = graphs.covered(panel, {"c": 2018}, 2017, 2019)
    assert {r["source"] for r in got.collect()} == {"a", "c"} and got.count() == 7


def test_new_positives_only(spark):
    train = graph(spark, [("a", "b", 1.0)]).withColumnRenamed("snapshot", "test")
    tests = graph(spark, [("a", "b", 1.0), ("b", "c", 1.0)]).withColumnRenamed("snapshot", "test")
    none = spark.createDataFrame([], "method string, test long, u string, v string")
    assert links.labelled_pairs(tests, none).count() == 2
    assert [(r["u"], r["v"]) for r in links.labelled_pairs(tests, none, new_only=train).collect()] == [("b", "c")]


def test_hops_make_their_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(node):
        seen.add(1)
        return node

    path = spark.createDataFrame([(1, str(i), str(i + 1)) for i in range(6)], "yr int, src string, dst string").select("yr", told("src").alias("src"), "dst")
    sources = spark.createDataFrame([(1, "0")], "yr int, source string")
    assert sorted((r["node"], r["hops"]) for r in graphs.hop_distances(path, sources, ["yr"]).collect()) == [(str(i), i) for i in range(7)]
    assert seen.value <= 12  # six edges, both ways
