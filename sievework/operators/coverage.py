"""Coverage of declared scope: rollups, gaps, failures by class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import rate, version_order
from ..functions.text import access_class

#: Outcomes that count as coverage.
COVERED = ("covered", "absent_confirmed", "partial")


def coverage_rollup(attempts: DataFrame, by: list[str]) -> DataFrame:
    """Counts per outcome over scoped attempts on active signals, and the coverage rate. Needs outcome, scope, signal_status."""
    live = attempts.where("scope = 'scoped' AND coalesce(signal_status, 'active') = 'active'")
    counts = {f"n_{o}": F.count_if(F.col("outcome") == o) for o in (*COVERED, "not_covered")}
    done = F.count_if(F.col("outcome").isin(*COVERED))
    return live.groupBy(*by).agg(F.count("*").alias("attempts_total"), *[c.alias(k) for k, c in counts.items()], rate(done, F.count("*")).alias("coverage_rate"))


def missing_scope(declared: DataFrame, attempted: DataFrame, keys: list[str]) -> DataFrame:
    """Declared units that nobody attempted, as not_covered rows to be written."""
    gaps = declared.select(*keys).distinct().join(attempted.select(*keys).distinct(), keys, "left_anti")
    return gaps.withColumns({"outcome": F.lit("not_covered"), "failure_stage": F.lit("discovery"), "failure_category": F.lit("source_not_found")})


def known_issues(failures: DataFrame, by: str, id_col: str, shown: int = 6) -> DataFrame:
    """Per category the number of failures and the first ids, with how many more there are."""
    rows = failures.select(by, F.col(id_col).cast("string").alias("_id"))
    g = rows.groupBy(by).agg(F.count("*").alias("failures"), F.count_distinct("_id").alias("_n"))
    g = with_first(g, rows.distinct(), [by], "_id", shown)
    more = F.col("_n") - shown
    text = F.concat(F.array_join("_first", ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(F.lit("")))
    return g.select(by, "failures", text.alias("ids"))


def with_first(groups: DataFrame, rows: DataFrame, by: list[str], value: str, shown: int) -> DataFrame:
    """Adds _first: the `shown` smallest values of each group, in order, without nulls.

    The first of each of 64 parts of a group are found before those of the group, so no task holds a group.
    """
    part = rows.where(F.col(value).isNotNull()).withColumn("_part", F.pmod(F.xxhash64(value, F.spark_partition_id()), F.lit(64)))
    for key in ([*by, "_part"], by):
        part = part.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(value))).where(F.col("_k") <= shown)
    first = part.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(F.array_sort(F.collect_list(value)).alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return groups.join(first, same, "left").drop(*[f"_by_{c}" for c in by]).withColumn("_first", F.coalesce("_first", F.array().cast("array<string>")))


def access_report(failures: DataFrame, detail: str, unit: list[str]) -> DataFrame:
    """Rows, distinct units and distinct companies per binding access class; unclassified rows are reported as such."""
    kind = F.coalesce(access_class(F.col(detail)), F.lit("unclassified")).alias("access_class")
    return failures.select(kind, *unit).groupBy("access_class").agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(*unit)).alias("n_units"), F.count_distinct(unit[0]).alias("n_companies"))


def latest_versions(runs: DataFrame, by: str, version: str) -> DataFrame:
    """The rows of each key's latest version, compared by its numbers."""
    return runs.withColumn("_v", version_order(F.col(version))).withColumn("_last", F.max("_v").over(Window.partitionBy(by))).where("_v = _last").drop("_v", "_last")
