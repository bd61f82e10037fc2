"""Toxicity, mixing and the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from threadloom.llm import mixing, toxicity

INSULTS = ["idiot", "moron", "pathetic", "worthless"]


def prose(rng, n, insults=0):
    words = ["".join(rng.choice(["ta", "ne", "ri", "so", "lu", "mi"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for _ in range(insults):
        words[rng.randrange(n)] = rng.choice(INSULTS)
    return " ".join(words)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(0)
    rows = [(prose(rng, rng.randint(5, 300), 0), 0) for _ in range(400)] + [(prose(rng, rng.randint(10, 300), rng.randint(2, 5)), 1) for _ in range(100)]
    return toxicity.train(rows)


def test_held_out_accuracy_and_misspellings(model):
    rng = random.Random(1)
    s = toxicity.Scorer(model)
    clean = [s.score(prose(rng, rng.randint(5, 2000))) for _ in range(150)]
    toxic = [s.score(prose(rng, rng.randint(10, 400), 3)) for _ in range(150)]
    assert np.mean(np.array(clean) < 0.5) > 0.95 and np.mean(np.array(toxic) >= 0.5) > 0.95
    for wrong in ("idiott", "morons", "patheticc", "worthles"):
        assert s.score(prose(rng, 40) + " " + wrong) > s.score(prose(rng, 40) + " narisolu") + 0.05


def test_scores_equal_a_plain_loop(model):
    """The score recomputed n-gram by n-gram from the table of the model."""
    mask, prime = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def slot(gram):
        h = len(gram)
        for c in gram:
            h = ((h ^ ord(c)) * prime) & mask
            h ^= h >> 29
        return h >> (64 - toxicity.BITS)

    def word_logit(word):
        marked = "<" + (word.strip(toxicity._ENDS) or word) + ">"
        grams = [marked[k : k + n] for n in (3, 4, 5) for k in range(len(marked) - n + 1)]
        return sum(float(model.lean[slot(g)]) for g in grams) / max(1, len(grams))

    def score(text):
        words = text.lower().split()
        windows = [words[k : k + 8] for k in range(0, len(words), 8)]
        top = max([sum(map(word_logit, w)) / len(w) + model.bias for w in windows], default=model.bias)
        z = model.scale * top + model.per_window * np.log1p(len(words) / 8) + model.offset
        return 1 / (1 + np.exp(-z))

    rng, s = random.Random(9), toxicity.Scorer(model)
    for text in [prose(rng, n, n % 3) for n in range(1, 40)] + ["", "A b. (idiot)!", "« Moron » --- x"]:
        assert s.score(text) == pytest.approx(score(text), abs=1e-5)


def test_labels_on_empty_texts_only():
    """Nothing to learn words from: no crash, scores stay in range."""
    for examples in ([("", 0), (None, 0), ("idiot you", 1), ("bad idiot", 1)], [("nice day", 0), ("a", 0), ("", 1), (None, 1)]):
        s = toxicity.Scorer(toxicity.train(examples))
        assert all(0 <= s.score(t) <= 1 for t in ("idiot", "nice", "", None))


def test_rare_ngrams_are_learnt_at_every_size():
    """An insult of three labelled documents leans towards toxic among few and among many others."""
    for n in (60, 900):
        rng = random.Random(n)
        rows = [(prose(rng, 30), 0) for _ in range(n)] + [(prose(rng, 4) + " zxqvw " + prose(rng, 3), 1) for _ in range(3)] + [(prose(rng, 30, 4), 1) for _ in range(n // 6)]
        m = toxicity.train(rows)
        usual = m.word_logits([w for _ in range(50) for w in prose(rng, 30).split()])
        assert m.word_logits(["zxqvw"])[0] > np.quantile(usual, 0.9) and m.word_logits(["zxqvw"])[0] > 0


def test_toxicity_of_odd_tables(spark, docs, model):
    from pyspark.sql import functions as F

    assert toxicity.score_documents(docs([]), model).count() == 0 and toxicity.reject_toxic(docs([]), model).count() == 0
    odd = docs([(1, "idiot moron idiot moron"), (1, "idiot moron idiot moron"), (2, None), (None, "sota neri")]).withColumn("score", F.lit("x")).withColumn("a.b", F.lit(1))
    scored = toxicity.score_documents(odd, model).collect()
    assert len(scored) == 4 and len({r["score"] for r in scored if r["doc_id"] == 1}) == 1
    left = toxicity.reject_toxic(odd, model)
    assert left.columns == odd.columns and sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 2]


def test_scores_of_odd_texts(model):
    s = toxicity.Scorer(model)
    for text in (None, "", " \n", "!!!", "\ud800x".encode("utf-8", "replace").decode(), "a" * 100_000, "x " * 100_000):
        assert 0 <= s.score(text) <= 1
    assert s.score(None) < 0.5 and s.score("") == s.score(" ")
    assert toxicity.train([]) is None and toxicity.train([("a b", 1)]) is None and toxicity.train([("", 0), ("", 1)]) is None
    assert toxicity.Scorer(None).score("idiot") == 0


def test_word_table_is_bounded_and_harmless(model, monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, 50, k % 2) for k in range(40)]
    want = [toxicity.Scorer(model).score(t) for t in texts]
    monkeypatch.setattr(toxicity.Scorer, "LIMIT", 30)
    s = toxicity.Scorer(model)
    assert [s.score(t) for t in texts] == pytest.approx(want)


def test_fit_uses_no_held_out_label(spark, docs):
    rng = random.Random(3)
    table = docs([(k, prose(rng, 40, 3 * (k % 4 == 0))) for k in range(400)])
    marks = [(k, int(k % 4 == 0)) for k in range(400)]
    held = {k for k in range(400) if zlib.crc32(str(k).encode()) % 5 == 0}
    lie = [(k, 1 - y if k in held else y) for k, y in marks] + [(None, 1), (9999, 1), (3, None)]
    a, b = (toxicity.fit(table, spark.createDataFrame(m, "doc_id long, toxic int")) for m in (marks, lie))
    assert np.allclose(a.lean, b.lean)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_documents(table, a).collect()}
    assert np.mean([(scored[k] >= 0.5) == bool(y) for k, y in marks if k in held]) > 0.95
    left = toxicity.reject_toxic(table, a)
    assert left.columns == table.columns and {r["doc_id"] for r in left.collect()} == {k for k, s in scored.items() if s < 0.5}
    assert toxicity.fit(table, spark.createDataFrame([], "doc_id long, toxic int")) is None


# Mixing


def water_fill(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > cap * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mix_meets_targets_and_agrees(spark, docs):
    rng = random.Random(4)
    rows = [(k, "w " * int(rng.paretovariate(1.2) * 20), "en", rng.choice(["a"] * 6 + ["b", "c", "d", None])) for k in range(3000)]
    rows += [(5000, None, "en", "a"), (5001, "", "en", "zero"), (None, "x y", "en", "a"), (None, "x y", "en", "a")]
    table = docs(rows)
    got = [r.asDict() for r in mixing.taken_words(mixing.mix(table)).collect()]
    sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    source = {r[0]: r[3] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        biggest[s] = max(biggest[s], r["size"])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = water_fill(sizes)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * biggest[s] + 1e-6
    for r in got:
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]]) and r["source_size"] == sizes[source[r["doc_id"]]]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    again = mixing.taken_words(mixing.mix(table.repartition(5))).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_flight_keeps_totals():
    rng = random.Random(5)
    units = [(0.3, rng.randint(1, 10_000)) for _ in range(2000)]
    f = mixing.Flight()
    for k, (p, size) in enumerate(units):
        f.add(p, size, rng.random(), k)
    assert len(f.open) <= 2
    ones = dict(f.settled)
    total = sum(units[k][1] * y for k, y in ones.items()) + sum(u[0] * u[1] for u in f.open)
    assert total == pytest.approx(sum(p * s for p, s in units), rel=1e-6)
    assert sum(ones.values()) + sum(u[0] for u in f.open) == pytest.approx(0.3 * 2000, rel=1e-6)
    f.land()
    assert not f.open and len(f.settled) == 2000


def test_mix_applies(spark, docs):
    table = docs([(k, "w " * (k + 1), "en", "ab"[k % 2]) for k in range(60)] + [(None, "x y", "en", "a")] * 3)
    mixed = mixing.mix(table)
    out = mixing.apply_mix(table, mixed)
    assert out.columns == table.columns
    words = sum(len(r["text"].split()) for r in out.collect())
    assert words == sum(r["taken"] for r in mixing.taken_words(mixed).collect())
    assert mixing.mix(docs([])).count() == 0


def test_mix_is_applied_alike_in_every_layout(spark, docs):
    """Rows that share id, source and text, and rows that share only id and size: each layout takes the same rows."""
    from pyspark.sql import functions as F

    rows = [(None, f"w{k} x", "en", "a") for k in range(20)] + [(7, "same text here", f"l{k}", "b") for k in range(9)] + [(7, "same text here", "en", "a")] + [(100 + k, "w " * (k % 5 + 1), "en", "ab"[k % 2]) for k in range(40)]
    rows += [(500, "w " * 30_000, "en", "a")]
    table = docs(rows).withColumn("a.b", F.lit(1)).withColumn("times", F.lit("x")).withColumn("key", F.lit(2))
    mixed = mixing.mix(table)
    seen = {tuple(sorted(map(tuple, mixing.apply_mix(t, mixed).collect()), key=str)) for t in (table, table.repartition(7), table.orderBy(F.col("lang").desc()).coalesce(1))}
    assert len(seen) == 1
    words = sum(len(r[1].split()) for r in next(iter(seen)))
    assert words == sum(r["taken"] for r in mixing.taken_words(mixed).collect())
    assert mixing.apply_mix(table, mixed).columns == table.columns


def test_pipeline_of_odd_tables(spark, tmp_path, docs):
    """Empty tables, nulls, repeated rows, very long texts and columns whose names clash with the pipeline's own."""
    import corpus_pipeline as c

    from pyspark.sql import functions as F

    for name, rows in (("none", []), ("odd", [(1, "a b c"), (1, "a b c"), (2, None), (None, "x y z"), (None, "x y z"), (3, ""), (4, "w " * 50_000)])):
        table = docs(rows).withColumn("row", F.lit(1)).withColumn("score", F.lit("x")).withColumn("a.b", F.lit(2)).withColumn("copies", F.lit(0))
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(9, 1)] if not rows else [], "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = c.run(spark, f"{tmp_path}/{name}").collect()
        assert all(r["n_tokens"] == len(r["ids"]) for r in got)
        assert {r["doc_id"] for r in got} <= {r[0] for r in rows}
        assert (not rows and not got) or any(r["doc_id"] == 4 for r in got)


def test_pipeline_equals_its_stages_by_brute_force(spark, small):
    import corpus_pipeline as c

    from test_joins_and_search import brute_components
    from threadloom.llm import sentence_pieces
    from threadloom.llm.queries import piece_model

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.collect()
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    clean = {r["doc_id"]: r["text"] for r in rows if scorer.score(r["text"]) < 0.5}
    kept = {k for k, (_, least) in brute_components(clean).items() if least == k}
    result = c.run(spark, small).collect()
    codec = sentence_pieces.codec(piece_model())
    assert [n for n, _ in c.STAGES] == ["toxicity", "minhash_near_dedup", "source_mixing", "sentence_pieces"]
    counts = defaultdict(int)
    for r in result:
        counts[r["doc_id"]] += 1
        assert r["ids"] == codec.sp.encode(clean[r["doc_id"]])
    mixed = mixing.mix(docs.filter(docs.doc_id.isin(sorted(kept)))).collect()
    assert dict(counts) == {r["doc_id"]: r["copies"] for r in mixed if r["copies"]}
