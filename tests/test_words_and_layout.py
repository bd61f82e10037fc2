"""Lemmas, the grown lexicon and layouts against plain versions and hand-worked cases."""

import math
import random

from pyspark.sql import functions as F

from threadloom.operators import layout, lemmas, polarity


def test_lemmas_need_the_vocabulary(spark):
    known = spark.createDataFrame([("cats", 3), ("cat", 2), ("bus", 5), ("glasses", 2), ("glass", 4), ("glasse", 9), ("wolves", 1), ("wolf", 2), ("dogs", 7), ("dog", 1), ("children", 1), ("is", 4), ("i", 9), (None, 3)], "term string, n long")
    found = {r["term"]: (r["lemma"], r["n"]) for r in lemmas.lemma_table(known).collect()}
    assert found == {"cats": ("cat", 3), "glasses": ("glass", 2), "wolves": ("wolf", 1), "children": ("child", 1)}


def test_texts_of_lemmas_keep_order_and_empty_texts(spark):
    tokens = spark.createDataFrame([(1, ["two", "cats", "and", "cats"]), (2, []), (3, None), (4, ["cat"])], "doc_id long, tokens array<string>")
    table = spark.createDataFrame([("cats", "cat", 2)], "term string, lemma string, n long")
    got = {r["doc_id"]: (r["tokens"], r["n_changed"]) for r in lemmas.lemmatise(tokens, table, "doc_id").collect()}
    assert got == {1: (["two", "cat", "and", "cat"], 2), 2: ([], 0), 3: ([], 0), 4: (["cat"], 0)}
    assert lemmas.lemmatise(tokens.limit(0), table, "doc_id").count() == 0


def test_lemmas_take_the_places_of_their_words(spark):
    rng, swaps = random.Random(4), {"cats": "cat", "dogs": "dog", "teeth": "tooth"}
    lists = [(k, [rng.choice(["cats", "dogs", "teeth", "a", "bird", None]) for _ in range(rng.randint(0, 9))]) for k in range(120)]
    tokens = spark.createDataFrame([*lists, (None, ["a", "cats"])], "doc_id long, tokens array<string>")
    table = spark.createDataFrame(list(swaps.items()), "term string, lemma string")
    got = {r["doc_id"]: (r["tokens"], r["n_changed"]) for r in lemmas.lemmatise(tokens, table, "doc_id").collect()}
    assert got.pop(None) == (["a", "cat"], 1)
    assert got == {k: ([swaps.get(t, t) for t in words if t is not None], sum(t in swaps for t in words)) for k, words in lists}


def test_only_changed_words_are_shuffled(spark):
    tokens = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.array(F.lit("cats")), F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.concat(F.lit("w"), i.cast("string")))).alias("tokens"))
    table = spark.createDataFrame([("cats", "cat")], "term string, lemma string")
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def sent():
        stages = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}

    before = sent()
    assert lemmas.lemmatise(tokens, table, "doc_id").agg(F.sum("n_changed"), F.sum(F.size("tokens"))).first() == (200, 200 * 501)
    assert sum(n for k, n in sent().items() if k not in before) < 2_000


def test_polarity_spreads_from_seeds(spark):
    texts = [(k, ["fine", "lovely", "warm"]) for k in range(12)] + [(20 + k, ["vile", "nasty", "cold"]) for k in range(12)] + [(40 + k, ["table", "chair", "lamp"]) for k in range(12)]
    docs = spark.createDataFrame(texts, "doc_id long, tokens array<string>")
    lexicon = polarity.grow(polarity.word_graph(docs), {"fine": 1, "vile": -1})
    found = {r["term"]: r["polarity"] for r in lexicon.collect()}
    assert found["fine"] == 1_000_000 and found["vile"] == -1_000_000
    assert found["lovely"] > 300_000 and found["warm"] > 300_000 and found["nasty"] < -300_000 and "table" not in found


def test_polarity_by_a_plain_loop(spark):
    graph = {("a", "b"): 500_000, ("b", "c"): 1_500_000, ("c", "d"): 250_000}
    rows = [(x, y, w) for (a, b), w in graph.items() for x, y in ((a, b), (b, a))]
    now, seeds = {"a": 1_000_000}, {"a": 1_000_000}
    for _ in range(3):
        after = dict(seeds)
        for node in "bcd":
            near = [(y, w) for x, y, w in rows if x == node]
            value = math.floor(0.85 * sum(w * now.get(y, 0) for y, w in near) / sum(w for _, w in near) + 0.5)
            if value:
                after[node] = value
        now = after
    lexicon = polarity.grow(spark.createDataFrame(rows, "a string, b string, weight long"), {"a": 1})
    assert {r["term"]: r["polarity"] for r in lexicon.collect()} == now


def test_negation_turns_the_words_in_its_scope(spark):
    docs = spark.createDataFrame([(1, ["good"]), (2, ["not", "a", "good"]), (3, ["not", "x", "y", "good"]), (8, ["not", "x", "y", "z", "good"]), (4, ["good", "not"]), (5, []), (6, None), (7, ["no", "bad"])], "doc_id long, tokens array<string>")
    lexicon = spark.createDataFrame([("good", 10), ("bad", -4)], "term string, polarity long")
    got = {r["doc_id"]: (r["score"], r["sentiment"]) for r in polarity.scores(docs, lexicon, "doc_id").collect()}
    assert got == {1: (10, 1), 2: (-10, -1), 3: (-10, -1), 8: (10, 1), 4: (10, 1), 5: (0, 0), 6: (0, 0), 7: (4, 1)}


def _energy(places, links):
    return sum(math.dist(places[a], places[b]) for a, b in links) / len(links)


def test_layout_draws_linked_nodes_together(spark):
    cliques = [(f"{c}{i}", f"{c}{j}") for c in "pqr" for i in range(6) for j in range(i)]
    edges = spark.createDataFrame([(1, a, b, 1.0) for a, b in cliques] + [(2, "x", "y", None)], "yr long, src string, dst string, weight double")
    drawn = {r: layout.spring_layout(edges, ["yr"], r).collect() for r in (0, 30)}
    places = {r: {p["node"]: (p["x"], p["y"]) for p in rows if p["yr"] == 1} for r, rows in drawn.items()}
    assert len(places[30]) == 18 and max(max(map(abs, p)) for p in places[30].values()) == 1
    assert _energy(places[30], cliques) < 0.4 * _energy(places[0], cliques)
    assert len(set(places[30].values())) == 18
    assert sorted(p["node"] for p in drawn[30] if p["yr"] == 2) == ["x", "y"]
    assert sorted(layout.spring_layout(edges.repartition(7, "dst"), ["yr"], 30).collect()) == sorted(drawn[30])
    assert layout.spring_layout(edges.filter(F.lit(False)), ["yr"], 2).count() == 0


def test_pairs_are_counted_by_slice_in_thin_rows(spark, monkeypatch):
    monkeypatch.setattr(polarity, "SLICE", 5)
    rows = [["b", "a", "c"], None, ["a", "b", "a", "b", "a", "b", "a"], [], ["é", "z", None, "a"]]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id long, tokens array<string>").coalesce(1)
    got, want = {}, {}
    for r in polarity._met(texts, "tokens", 2).collect():
        for b, c in zip(r["b"], r["c"]):
            got[r["a"], b] = got.get((r["a"], b), 0) + c
    for t in rows:
        for i, x in enumerate(t or []):
            for y in t[i + 1 : i + 3]:
                if x and y and x != y:
                    pair = (min(x, y), max(x, y))
                    want[pair] = want.get(pair, 0) + 1
    assert got == want
