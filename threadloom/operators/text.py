"""Thread documents, tokens and vocabularies."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import blank
from ..functions.lineage import cut

#: White space as str.split() sees it.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]+"
_PUNCTUATION = r"^[!-/:-@\[-`{-~]+$"
#: Combining marks, and what a word of ``plain_tokens`` consists of: word characters but decimal digits.
_MARK, _LETTERS = r"\p{Mn}", r"[\p{L}\p{Nl}\p{No}_]+"
_ACCENTED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0] != chr(c)}


def body(columns: Sequence[str]) -> Column:
    """body_cleaned where the table has it, else body; a missing text stays null."""
    for c in ("body_cleaned", "body"):
        if c in columns:
            return F.col(c).cast("string")
    raise ValueError("the table has neither body_cleaned nor body")


def thread_documents(comments: DataFrame, order: str = "pos") -> DataFrame:
    """link_id, text, n_comments: non-blank texts of each thread in order, joined by spaces; threads of blanks are absent.

    A document is one value, so a thread's texts must fit one, 2 GB, as they come.
    """
    rows = comments.select("link_id", F.col(order).alias("pos"), "id", body(comments.columns).alias("text")).filter(~blank(F.col("text")))
    texts = F.array_sort(F.collect_list(F.struct("pos", "id", "text")))
    grouped = rows.groupBy("link_id").agg(texts.alias("t"))
    return grouped.select("link_id", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("text"), F.size("t").cast("long").alias("n_comments"))


def tokens(text: Column, stopwords: Sequence[str] = (), least: int = 3) -> Column:
    """Lower-cased words without stop words, short words, numbers, punctuation, and those that begin with ' or ..."""

    def good(t: Column) -> Column:
        return (F.length(t) >= least) & ~t.isin(*stopwords) & ~t.startswith("'") & ~t.startswith("...") & ~t.rlike(r"^\p{Nd}+$") & ~t.rlike(_PUNCTUATION)

    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), good)


def plain_tokens(text: Column, stopwords: Sequence[str] = (), least: int = 3, most: int = 15) -> Column:
    """Runs of letters of any script without accents, 2 to ``most`` long, of at least ``least`` letters and no stop word."""
    bare = F.regexp_replace(F.translate(F.lower(F.coalesce(text, F.lit(""))), "".join(_ACCENTED), "".join(_ACCENTED.values())), _MARK, "")
    words = F.regexp_extract_all(bare, F.lit(_LETTERS), F.lit(0))
    return F.filter(words, lambda t: (F.length(t) >= max(2, least)) & (F.length(t) <= most) & ~t.startswith("_") & ~t.isin(*stopwords))


def lemmatised(make: Callable[[], Callable[[str], str]]) -> Callable[[Column], Column]:
    """A column function around a word lemmatiser, made once per task; texts are split at white space."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lemma = make()
        for texts in parts:
            yield texts.map(lambda t: None if t is None else " ".join(map(lemma, t.split())))

    return run


def vocabulary(docs: DataFrame, column: str = "tokens", no_below: int = 3, no_above: float = 0.6, keep_n: int = 3000) -> DataFrame:
    """term, df: terms in at least ``no_below`` documents and at most a share of them, the ``keep_n`` of greatest document frequency."""
    marked = F.concat(F.array(F.lit("")), F.array_distinct(column))  # no term is empty: it counts the documents in the same pass
    df = cut(docs.select(F.explode(marked).alias("term")).groupBy("term").agg(F.count("*").alias("df")).filter((F.col("df") >= no_below) | (F.col("term") == "")))
    total = df.filter("term = ''").select(F.col("df").alias("total"))
    kept = df.filter("term <> ''").join(F.broadcast(total)).filter(F.col("df") <= no_above * F.col("total"))
    return kept.select("term", "df").orderBy(F.col("df").desc(), "term").limit(keep_n)


def valid_documents(docs: DataFrame, terms: DataFrame, key: str, column: str = "tokens", least: int = 5) -> DataFrame:
    """key, n_tokens, n_terms of documents with enough tokens and at least one term of the vocabulary."""
    long = docs.filter(F.size(column) >= least).select(key, F.size(column).cast("long").alias("n_tokens"), F.explode(column).alias("term"))
    met = long.join(terms.select("term"), "term").groupBy(key, "n_tokens").agg(F.count("*").alias("n_terms"))
    return met.select(key, "n_tokens", "n_terms")


def reply_types(comments: DataFrame) -> DataFrame:
    """One row: top-level comments, other replies, all."""
    top = F.coalesce(F.col("link_id") == F.col("parent_id"), F.lit(False))
    return comments.agg(F.count_if(top).alias("top_level"), F.count_if(~top).alias("replies"), F.count("*").alias("n_comments"))


def several(comments: DataFrame, of: str, per: str) -> DataFrame:
    """Values of ``per`` with more than one distinct ``of``."""
    return comments.groupBy(per).agg(F.count_distinct(of).alias("n")).filter("n > 1")


def thread_ratios(comments: DataFrame) -> DataFrame:
    """Distinct threads and parents, and comments per each."""
    counts = comments.agg(F.count_distinct("link_id").alias("links"), F.count_distinct("parent_id").alias("parents"), F.count("*").alias("n_comments"))
    per = lambda c: F.round(F.try_divide(F.col("n_comments").cast("double"), c), 6)
    return counts.select("links", "parents", "n_comments", per("links").alias("per_link"), per("parents").alias("per_parent"))


def distinct_pairs(comments: DataFrame, n: int = 10) -> DataFrame:
    """The first n distinct (link_id, parent_id) pairs by name."""
    return comments.select("link_id", "parent_id").distinct().orderBy("link_id", "parent_id").limit(n)
