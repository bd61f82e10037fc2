"""Link prediction is evaluated on every fold, with the settings of the operators."""

import itertools

import pytest

from threadloom.operators import embeddings, links
from threadloom.plans import catalogue


@pytest.fixture
def months(spark, monkeypatch):
    """Three snapshots over ten communities: rings with chords, put in place of the edge table."""
    made = [("sentiment", t, *sorted((f"c{a}", f"c{(a + step) % 10}")), 25.0) for t, steps in enumerate([(1,), (1, 2), (2, 3)]) for step in steps for a in range(10)]
    table = spark.createDataFrame(made, "method string, snapshot long, src string, dst string, weight double")
    monkeypatch.setattr(catalogue, "graph_edges", lambda spark, sf_dir: table)


def test_node2vec_scores_every_fold_and_sampler(spark, months, monkeypatch):
    seen, embed = [], embeddings.embed

    def watch(walks, *more, **named):
        seen.append({(r["walk"][0], len(r["walk"])) for r in walks.collect()} | {walks.count()})
        assert not more and not named
        return embed(walks)

    monkeypatch.setattr(embeddings, "embed", watch)
    got = {(r["test"], r["sampler"]) for r in catalogue.QUERIES["l15_node2vec"](spark, "").collect()}
    assert got == set(itertools.product((1, 2), ("uniform", "distance2")))
    assert seen == [{(f"c{a}", 30) for a in range(10)} | {2000}] * 2


def test_each_fold_is_fitted_on_its_own_train_graph(spark, months, monkeypatch):
    """Against a plain optimiser over the train edges and as many uniform negatives of one fold."""
    import numpy as np

    _, train, _ = catalogue._train(spark, "")
    names = ["cn", "jaccard", "aa", "pa"]
    fit, rows = links.training_rows(train).toPandas(), catalogue.scored_pairs(spark, "").toPandas()
    got = catalogue.QUERIES["l13_logreg_scores"](spark, "").toPandas().set_index(["test", "u", "v", "label"])["score"]
    assert len(got) == len(rows)
    for test in (1, 2):
        d = fit[fit["test"] == test]
        assert (d["label"] == 1).sum() == train.filter(f"test = {test}").count() and (d["label"] == 0).any()
        a, y, w = np.c_[d[names].to_numpy(float), np.ones(len(d))], d["label"].to_numpy(), np.zeros(5)
        for _ in range(200):
            p = 1 / (1 + np.exp(-a @ w))
            ridge = np.diag([1.0, 1, 1, 1, 0])
            w -= 0.5 * np.linalg.lstsq((a.T * (p * (1 - p))) @ a + ridge, a.T @ (p - y) + ridge @ w, rcond=None)[0]
        for r in rows[rows["test"] == test].itertuples():
            want = 1 / (1 + np.exp(-(np.array([*(getattr(r, n) for n in names), 1.0], float) @ w)))
            assert got.loc[(test, r.u, r.v, r.label)] == pytest.approx(want, abs=1e-5)


def test_sweep_has_the_thresholds_of_the_experiment(spark, months):
    got = {r["method"] for r in catalogue.QUERIES["l14_experiment_sweep"](spark, "").collect()}
    assert got == {f"sentiment|{t}" for t in (5, 10, 20)}
