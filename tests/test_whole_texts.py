"""Sentiment reads texts to their end, by the lexicon and by a scorer that is handed in."""

import numpy as np

from threadloom.operators import sentiment


def test_sentiment_counts_words_far_into_a_text(spark):
    late = "filler " * 300 + "good great"
    df = spark.createDataFrame([("a", late), ("b", "bad " + late)], "id string, body_cleaned string")
    assert {r["id"]: r["sentiment"] for r in sentiment.direct_sentiment(df).collect()} == {"a": 1, "b": 1}

    def make():
        return lambda texts: np.array([[0.0, 0.0, 1.0] if t.endswith("good great") else [1.0, 0.0, 0.0] for t in texts])

    assert {r["sentiment"] for r in sentiment.with_sentiment(df, sentiment.model_sentiment(make)).collect()} == {1}
