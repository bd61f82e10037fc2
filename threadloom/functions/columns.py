"""Column expressions: scores, canonical pairs, safe ratios, text predicates, snapshot labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def adjusted_score(score: Column) -> Column:
    """A comment's score without its author's own vote; a missing score counts as 0 before that."""
    return F.coalesce(score, F.lit(0)) - 1


def sentiment_label(num_pos: Column, num_neg: Column, sum_pos: Column, sum_neg: Column) -> Column:
    """Positive, Negative or Neutral by the sign of the weighted mean of score sums.

    The denominator num_pos + num_neg never is negative, so the numerator has the sign; 0 / 0 is Neutral.
    """
    lean = sum_pos * num_pos - sum_neg * num_neg
    return F.when(lean > 0, "Positive").when(lean < 0, "Negative").otherwise("Neutral")


def ratio(above: Column, below: Column) -> Column:
    """above / below, 0 where below is 0."""
    return F.coalesce(F.try_divide(above.cast("double"), below), F.lit(0.0))


def blank(text: Column) -> Column:
    """Null or nothing but Unicode white space."""
    return F.coalesce(text.rlike(r"(?U)^\s*$"), F.lit(True))


def from_file_name(path: Column, pattern: str) -> Column:
    """The first group of ``pattern`` in a file's name, null if it does not fit."""
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))


def category_colour(kind: str, party: Column, gun: Column, banned: Column) -> Column:
    """The colour that a drawing gives a node by party, gun or banned."""
    if kind == "party":
        return F.when(party == "dem", "blue").when(party == "rep", "red").otherwise("gray")
    if kind in ("gun", "banned"):
        return F.when(F.coalesce(gun if kind == "gun" else banned, F.lit(0)) != 0, "orange" if kind == "gun" else "black").otherwise("gray")
    raise ValueError(f"unknown category {kind!r}")


def cosine(u: Column, v: Column) -> Column:
    """Cosine of two arrays; 0 where one is null or has no length."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(dot(u, v), F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two array columns taken as sets, 0 if both are empty."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))
