"""Integrity checks: references, keys, vocabularies and table-wide rules, as rows of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dealt


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """Child rows whose reference is not blank and has no parent."""
    # Not as an anti join, which would be moved ahead of the dealing.
    rows = dealt(child.where(F.col(key).isNotNull()).select(key), key)
    lost = rows.join(parent.select(F.col(parent_key).alias(key), F.lit(True).alias("_there")), key, "left").where("_there IS NULL")
    return lost.select(F.lit(name).alias("check"), F.col(key).cast("string").alias("subject"))


def duplicates(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    return dealt(rows.select(*key), *key).groupBy(*key).count().where("count > 1").select(F.lit(name).alias("check"), F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("subject"))


def outside_vocabulary(rows: DataFrame, column: str, allowed: DataFrame, name: str) -> DataFrame:
    used = rows.select(F.trim(column).alias(column)).where(F.col(column) != "").distinct()
    return used.join(allowed.select(F.trim("value").alias(column)).distinct(), column, "left_anti").select(F.lit(name).alias("check"), F.col(column).alias("subject"))


def findings(*checks: DataFrame) -> DataFrame:
    """Findings counted per check."""
    return reduce(DataFrame.unionByName, checks).groupBy("check").agg(F.count("*").alias("findings"), F.min("subject").alias("first"))


def problems(*rules: tuple[Column, str]) -> Column:
    """The messages of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(text)) for broken, text in rules]))


def require(rows: DataFrame, column: str = "problems") -> DataFrame:
    """Rows unchanged; the job fails on the first row with a problem, so a bad batch writes nothing."""
    return rows.where(F.when(F.size(column) > 0, F.raise_error(F.concat(F.lit("rejected: "), F.array_join(column, "; "))).isNull()).otherwise(F.lit(True)))
