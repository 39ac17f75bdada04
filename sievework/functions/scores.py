"""Scores and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WEAK_WORDS

WEAK_WEIGHT, EXTRA_PENALTY = 0.35, 0.35


def _weight(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0.0), lambda a, t: a + F.when(t.isin(*WEAK_WORDS), F.lit(WEAK_WEIGHT)).otherwise(F.lit(1.0)))


def overlap_score(query: Column, candidate: Column) -> Column:
    """Weighted share of the query's tokens found, less a penalty for the candidate's own; 0 to 1."""
    q, c = F.array_distinct(query), F.array_distinct(candidate)
    base = _weight(F.array_intersect(q, c)) / _weight(q) - EXTRA_PENALTY * _weight(F.array_except(c, q)) / _weight(c)
    return F.when((F.size(q) == 0) | (F.size(c) == 0), F.lit(0.0)).otherwise(F.round(F.greatest(F.lit(0.0), base), 4))


def rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded; 0 for an empty whole."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


def version_order(version: Column) -> Column:
    """Numbers of a version like v1.10 as an array, which compares as versions do."""
    return F.transform(F.filter(F.split(F.regexp_replace(version, "^v", ""), r"\."), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))
