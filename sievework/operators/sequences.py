"""Ranking and order-dependent rules: first rows, collapses, runs and picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list, *order) -> DataFrame:
    """The first row of each key, and how many others were dropped for it. A least row and a count combine before the shuffle, so a hot key is no hot task."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    by = [F.expr(c) if isinstance(c, str) else c for c in keys]
    first = F.min_by(whole, F.struct(*[F.col(c) if isinstance(c, str) else c for c in order]))
    return rows.groupBy(*[c.alias(f"_k{i}") for i, c in enumerate(by)]).agg(first.alias("_first"), (F.count("*") - 1).alias("dropped")).select("_first.*", "dropped")


def collapse_copies(rows: DataFrame, keys: list, priority: Column, url: str) -> DataFrame:
    """Of syndicated copies the one of the best source, with the number suppressed."""
    return first_per_key(rows, keys, priority, url).withColumnRenamed("dropped", "suppressed")


def breaker_stops(rows: DataFrame, by: str, order: str, failed: Column, limit: int) -> DataFrame:
    """Per key the first place where `limit` failures stand in a row; later rows would not have been tried."""
    w = Window.partitionBy(by).orderBy(order)
    runs = rows.withColumn("_f", failed.cast("int")).withColumn("_island", F.sum(1 - F.col("_f")).over(w))
    streak = runs.withColumn("streak", F.sum("_f").over(Window.partitionBy(by, "_island").orderBy(order)))
    return streak.where(F.col("streak") == limit).groupBy(by).agg(F.min(order).alias("stopped_at"))


def sequence_numbers(rows: DataFrame, by: str, *order) -> DataFrame:
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def top_per_key(rows: DataFrame, by: str, k: int, *order) -> DataFrame:
    """The first k rows of each key with their rank and whether there were more: a capped list says so."""
    w = Window.partitionBy(by)
    return rows.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("truncated", F.count("*").over(w) > k).where(F.col("rank") <= k)


def disappeared_paths(captures: DataFrame, by: str, path: str, at: Column, cutoff: int, least: int = 8, clustered: float = 0.6, wholesale: float = 0.7) -> DataFrame:
    """Paths last seen before the cutoff year, and whether they went together.

    clustered: most vanished in one year; wholesale: most of all paths are gone.
    """
    last = captures.groupBy(by, path).agg(F.max(at).alias("year"))
    gone = F.col("year") < cutoff
    years = last.where(gone).groupBy(by, "year").agg(F.count("*").alias("n"))
    mode = years.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "year"))).where("_n = 1").select(by, F.col("year").alias("modal_year"), F.col("n").alias("in_modal_year"))
    g = last.groupBy(by).agg(F.count("*").alias("paths"), F.count_if(gone).alias("gone"))
    out = g.join(mode, by, "left")
    kind = F.when(F.col("gone") < least, "individual").when(F.col("gone") / F.col("paths") >= wholesale, "wholesale").when(F.col("in_modal_year") / F.col("gone") >= clustered, "clustered").otherwise("individual")
    return out.select(by, "paths", "gone", "modal_year", kind.alias("pattern"))


def ranked_family(rows: DataFrame, by: str, order: list, place: str, active: str) -> DataFrame:
    """The first row of each key by `order`, and the other active ones at the same place; is_primary tells them apart."""
    w = Window.partitionBy(by).orderBy(*order)
    ranked = rows.withColumns({"_n": F.row_number().over(w), "_home": F.first(place).over(w)})
    kin = F.col(active) & (F.col(place) == F.col("_home")) & (F.col(place) != "")
    return ranked.where((F.col("_n") == 1) | kin).withColumn("is_primary", F.col("_n") == 1).drop("_n", "_home")
