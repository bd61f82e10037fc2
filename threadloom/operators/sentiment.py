"""Sentiment of texts: a lexicon expression by default, or any batch scorer given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank
from .text import SPACE, body

POSITIVE = ("good", "great", "love", "excellent", "happy", "best", "thanks", "agree", "nice", "right")
NEGATIVE = ("bad", "terrible", "hate", "awful", "sad", "worst", "wrong", "angry", "poor", "fail")
#: A scorer makes one row of class logits per text; ``labels`` names the columns.
Scorer = Callable[[list[str]], np.ndarray]
CODES = {"negative": -1, "neutral": 0, "positive": 1, "LABEL_0": -1, "LABEL_1": 0, "LABEL_2": 1}


def lexicon_sentiment(text: Column, positive: Sequence[str] = POSITIVE, negative: Sequence[str] = NEGATIVE) -> Column:
    """-1, 0 or 1 by all words of a text; null for blank texts. Runs inside the JVM."""
    words = F.filter(F.split(F.lower(text), SPACE), lambda t: t != "")
    count = lambda lexicon: F.size(F.filter(words, lambda t: F.array_contains(F.array(*(F.lit(w) for w in lexicon)), t)))
    return F.when(~blank(text), F.signum(count(positive) - count(negative)).cast("int"))


def codes_of(logits: np.ndarray, labels: Sequence[str]) -> np.ndarray:
    """Softmax, likeliest label, its code; labels that are not known count as neutral."""
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return np.array([CODES.get(labels[k], 0) for k in p.argmax(axis=1)])


def model_sentiment(make: Callable[[], Scorer], labels: Sequence[str] = ("negative", "neutral", "positive"), batch: int = 64, failed: str = "raise") -> Callable[[Column], Column]:
    """A column function around a scorer, made once per task; blank and null texts stay null.

    A scorer that fails fails the query; with ``failed="null"`` it leaves the texts of its batch null.

    Texts are handed over whole; a scorer with a token limit truncates or pools by its own tokenizer.
    """

    @F.pandas_udf("int")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make()
        for texts in parts:
            out = pd.Series([None] * len(texts), dtype="Int32")
            live = np.flatnonzero(texts.notna() & (texts.fillna("").str.strip() != ""))
            for at in range(0, len(live), batch):
                rows = live[at : at + batch]
                try:
                    out.iloc[rows] = codes_of(scorer(texts.iloc[rows].tolist()), labels)
                except Exception:
                    if failed != "null":
                        raise
            yield out

    return score


def with_sentiment(rows: DataFrame, score: Callable[[Column], Column] = lexicon_sentiment) -> DataFrame:
    """All columns and ``sentiment``."""
    return rows.withColumn("sentiment", score(body(rows.columns)))


def direct_sentiment(comments: DataFrame, score: Callable[[Column], Column] = lexicon_sentiment) -> DataFrame:
    """id, link_id, author, sentiment, body_cleaned straight from comments; columns they lack are null."""
    text = body(comments.columns).alias("body_cleaned")
    known = [F.col(c) if c in comments.columns else F.lit(None).cast("string").alias(c) for c in ("id", "link_id", "author")]
    return comments.select(*known, text).withColumn("sentiment", score(F.col("body_cleaned"))).select("id", "link_id", "author", "sentiment", "body_cleaned")
