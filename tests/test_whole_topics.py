"""Topic queries fit with the operators' own number of topics and passes."""

import pytest

from threadloom.operators import topics
from threadloom.plans.catalogue import QUERIES


class Fitted(Exception):
    pass


@pytest.mark.parametrize("name", ["m1_lda_topics", "m5_seeded_topics", "m11_topic_words", "m13_comment_topics", "m14_sentiment_on_topics", "m16_topics_and_sentiment", "a18_topic_counts"])
def test_fits_have_the_default_size(spark, small, monkeypatch, name):
    def stop(self, docs, key):
        raise Fitted(self.k, self.passes)

    monkeypatch.setattr(topics.TopicModel, "fit", stop)
    with pytest.raises(Fitted) as told:
        QUERIES[name](spark, small)
    assert told.value.args == ((11, 10) if name == "m5_seeded_topics" else (20, 5))
