"""Topics by whole passes of variational inference, against a plain version over dense counts."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import topics, variational


def plain(counts, alpha, eta, passes, limit, seed):
    """Batch inference, a document after the other, over a dense matrix of counts."""
    psi = np.vectorize(lambda x: (math.lgamma(x + 1e-5) - math.lgamma(x - 1e-5)) / 2e-5)
    log_mean = lambda w: np.exp(psi(w) - psi(w.sum(axis=-1, keepdims=True)))
    weights = np.random.default_rng(seed).gamma(100.0, 0.01, (len(alpha), counts.shape[1]))
    gammas = []
    for _ in range(passes):
        beta, total, gammas = log_mean(weights), np.zeros_like(weights), []
        for n in counts:
            gamma = alpha + n.sum() / len(alpha)
            for _ in range(limit):
                theta, before = log_mean(gamma), gamma
                phi = theta[:, None] * beta
                phi /= phi.sum(axis=0)
                gamma = alpha + phi @ n
                if np.abs(gamma - before).mean() < variational.STILL:
                    break
            phi = log_mean(gamma)[:, None] * beta
            total += phi / phi.sum(axis=0) * n
            gammas.append(gamma)
        weights = eta + total
    return weights


def corpus(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    words = [[f"w{k}{i}" for i in range(8)] for k in range(3)]
    rows = [(i, list(rng.choice(words[i % 3], 20)) + list(rng.choice(sum(words, []), 2))) for i in range(n)]
    return spark.createDataFrame([(i, [str(t) for t in r]) for i, r in rows], "id long, tokens array<string>"), rows


def test_digamma():
    assert variational.digamma(np.array([1.0, 0.5, 10.0, 1e-3])) == pytest.approx([-0.5772156649015329, -1.9635100260214235, 2.251752589066721, -1000.5755719318103], rel=1e-9)


def test_same_topics_as_the_plain_version(spark):
    docs, rows = corpus(spark)
    model = topics.TopicModel(k=3, passes=4, no_above=1.0, no_below=1).fit(docs.repartition(5), "id")
    counts = np.zeros((len(rows), len(model.terms)))
    for i, tokens in rows:
        for t in tokens:
            counts[i, model.terms.index(str(t))] += 1
    assert model.weights == pytest.approx(plain(counts, model.alpha, 0.01, 4, 30, 42), rel=1e-4, abs=1e-4)


def test_planted_topics_are_found(spark):
    docs, _ = corpus(spark, 90)
    model = topics.TopicModel(k=3, passes=10, no_above=1.0, no_below=1).fit(docs, "id")
    got = {r["id"]: r["topic_id"] for r in model.assign(docs, "id").collect()}
    assert len({(i % 3, t) for i, t in got.items()}) == 3 and len(set(got.values())) == 3
    words = {r["topic"]: r["words"] for r in model.top_words(spark, 8).collect()}
    assert all(len({w[:2] for w in v}) == 1 for v in words.values())


def test_every_document_is_in_every_pass(spark, monkeypatch):
    docs, rows = corpus(spark, 30)
    sizes, told = [], variational.one_pass

    def watch(bags, *more):
        sizes.append(bags.selectExpr("sum(aggregate(counts, 0D, (a, x) -> a + x))").first()[0])
        return told(bags, *more)

    monkeypatch.setattr(variational, "one_pass", watch)
    topics.TopicModel(k=2, passes=3, no_above=1.0, no_below=1).fit(docs, "id")
    assert sizes == [sum(len(t) for _, t in rows)] * 3


def test_short_unknown_and_null_documents(spark):
    docs, _ = corpus(spark)
    model = topics.TopicModel(k=3, no_above=1.0, no_below=1).fit(docs, "id")
    odd = spark.createDataFrame([(1, ["w00"] * 4), (2, ["zz"] * 9), (3, []), (4, None), (None, ["w00"] * 9)], "id long, tokens array<string>")
    got = {r["id"]: r["topic_id"] for r in model.assign(odd, "id").collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == [-1] * 4 and got[None] >= 0
    assert model.assign(odd.limit(0), "id").count() == 0


def test_documents_side_by_side_are_iterated_as_alone(monkeypatch):
    rng = np.random.default_rng(5)
    sizes = np.concatenate([rng.integers(0, 40, 200), [0, 700]])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.concatenate([np.sort(rng.choice(900, s, replace=False)) for s in sizes])
    counts, table, alpha = rng.integers(1, 5, len(ids)).astype(float), rng.random((900, 4)) + 1e-3, np.array([0.4, 0.3, 0.2, 0.1])
    monkeypatch.setattr(variational, "TABLE", 500)
    total, alone = np.zeros((900, 4)), np.zeros((900, 4))
    calls, told = [], variational._raised
    monkeypatch.setattr(variational, "_raised", lambda w: calls.append(1) or told(w))
    got = variational.infer(ids, counts, starts, table, alpha, 30, total)
    assert len(calls) < len(sizes) * 5  # not one by one
    for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
        one = variational.infer(ids[a:b], counts[a:b], np.array([0, b - a]), table, alpha, 30, alone)
        assert got[i] == pytest.approx(one[0], rel=1e-9)
    assert total == pytest.approx(alone, rel=1e-9) and got[-2].tolist() == alpha.tolist()


def test_texts_are_tokenised_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(text):
        seen.add(1)
        return text.split()

    docs = spark.createDataFrame([(i, "red green blue grey " * (1 + i % 3)) for i in range(20)], "id long, text string").select("id", words("text").alias("tokens"))
    model = topics.TopicModel(k=2, passes=2, no_above=1.0, no_below=1, least_tokens=1).fit(docs, "id")
    assert model.assign(docs, "id").count() == 20 and seen.value == 20


def test_guided_topics_count_documents_once(spark):
    """Rounds read term numbers; repeated and null keys are one document each, as in a join by key."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        seen.add(1)
        return text

    rows = [(i, ["apple pear plum", "iron steel copper"][i % 2] + " common") for i in range(12)] + [(0, "iron steel copper"), (20, ""), (21, "zzz"), (None, "apple pear")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3).select("id", told("text").alias("text"))
    got = topics.guided_topics(docs, "id", [["apple"], ["iron"]], ["fruit", "metal"], (), rounds=3).collect()
    assert seen.value == len(rows) and len(got) == len(rows)
    of = {r["id"]: r["topic_id"] for r in got if r["id"] != 0}
    assert [of[i] for i in range(1, 12)] == [i % 2 for i in range(1, 12)] and (of[20], of[21], of[None]) == (-2, -1, -1)
    assert len({r["topic_id"] for r in got if r["id"] == 0}) == 1
