"""The (company x theme x week) history: three gates in order, null with a reason and never an absence by default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import week_id, week_start
from ..sources.tables import dealt

#: Ranks of retrospective reach, classes that license an absence, days in five years.
REACH_RANK = {"current_only": 0, "bounded": 1, "archival": 2}
ABSENCE_CLASSES = ("IC3", "IC4")
STALE_DAYS = 1825


def week_buckets(spark, start: str, end: str) -> DataFrame:
    """ISO weeks, Monday to Sunday, that cover the range."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date_trunc('week', DATE'{start}'), DATE'{end}', interval 7 days)")).alias("d")).select(F.to_date("d").alias("bucket_start"))
    return days.select(week_id(F.col("bucket_start")).alias("bucket_id"), "bucket_start", F.date_add("bucket_start", 6).alias("bucket_end"))


def reach_covers(reach: Column, seen: Column, start: Column, end: Column, months: Column, effective: Column) -> Column:
    """Whether something read on day `seen` speaks for a bucket: never for one that starts later."""
    window = F.datediff(seen, end) <= F.floor(months * 30.44)
    kind = F.when(reach == "archival", True).when(reach == "current_only", (start <= seen) & (seen <= end)).when(reach == "bounded", window).otherwise(False)
    return (start <= seen) & F.coalesce(effective <= seen, F.lit(True)) & F.coalesce(kind, F.lit(False))


def state_history(companies: DataFrame, themes: DataFrame, buckets: DataFrame, attempts: DataFrame, observations: DataFrame, instruments: DataFrame) -> DataFrame:
    """Status and reason of every cell.

    themes (theme, since), instruments (signal, theme, instrument_class, presence_only, reach, months, effective),
    attempts (company_id, signal, outcome, seen), observations (observation_id, company_id, theme, published, seen,
    reach, months, effective, state, grade, confidence, valid); without a publication date the day it was read counts, and
    the source's reach at that day must cover the bucket. Attempts are spread over the buckets they reach, then joined on equal keys.
    Rows are dealt before they are spread, so that a task has a bounded number of them, and combine by cell before the shuffle, so a company with many is no hot key.
    """
    cube = companies.select("company_id").crossJoin(themes).crossJoin(buckets)
    tried = dealt(attempts, "company_id", "signal", "seen").join(F.broadcast(instruments), "signal").crossJoin(F.broadcast(buckets))
    tried = tried.where(reach_covers(F.col("reach"), F.col("seen"), F.col("bucket_start"), F.col("bucket_end"), F.col("months"), F.col("effective")))
    # As a place among the classes: a number combines in a hash table, a text would be sorted for.
    classes = F.array(*map(F.lit, sorted(ABSENCE_CLASSES)))
    licence = (F.col("outcome") == "absent_confirmed") & F.col("instrument_class").isin(*ABSENCE_CLASSES) & ~F.col("presence_only")
    reached = tried.groupBy("company_id", "theme", "bucket_id").agg(
        F.count_distinct("signal").alias("covering"),
        F.get(classes, F.max(F.when(licence, F.array_position(classes, F.col("instrument_class")).cast("int"))) - 1).alias("licence"),
        F.min(F.create_map(*[F.lit(x) for kv in REACH_RANK.items() for x in kv])[F.col("reach")]).alias("rank"),
    )
    seen = dealt(observations.where("valid"), "observation_id").withColumn("published", F.coalesce("published", "seen")).crossJoin(F.broadcast(buckets)).where("published <= bucket_end").where(F.datediff("bucket_end", "published") <= STALE_DAYS)
    seen = seen.where(reach_covers(F.col("reach"), F.col("seen"), F.col("bucket_start"), F.col("bucket_end"), F.col("months"), F.col("effective")))
    found = seen.groupBy("company_id", "theme", "bucket_id").agg(F.count("*").alias("evidence"), F.max_by("state", F.struct("confidence", "published", "observation_id")).alias("state"), F.max(F.coalesce("grade", F.lit("C"))).alias("lowest_grade"))
    cells = cube.join(reached, ["company_id", "theme", "bucket_id"], "left").join(found, ["company_id", "theme", "bucket_id"], "left")
    reason = (
        F.when(F.col("bucket_end") < F.col("since"), "theme_not_detectable")
        .when(F.col("evidence") > 0, "observed")
        .when(F.col("covering").isNull(), "no_reach")
        .when(F.col("licence").isNotNull(), F.concat(F.lit("absence_licensed_"), F.col("licence")))
        .otherwise("no_absence_license")
    )
    out = cells.withColumn("reason", reason)
    status = F.when(F.col("reason") == "observed", "observed").when(F.col("reason").startswith("absence_licensed"), "absent").otherwise("null")
    seen_only = lambda c: F.when(F.col("reason") == "observed", F.col(c))
    return out.select("company_id", "theme", "bucket_id", status.alias("status"), "reason", seen_only("state").alias("state"), F.coalesce(seen_only("evidence"), F.lit(0)).alias("evidence_count"), seen_only("lowest_grade").alias("lowest_grade"))


def weeks_between(days: DataFrame, day: str) -> DataFrame:
    """(bucket_id, bucket_start, bucket_end, n): every week from that of the first day to that of the last, with its number of rows; weeks without any have 0."""
    counts = days.groupBy(week_start(F.col(day)).alias("bucket_start")).agg(F.count("*").alias("n"))
    first = counts.agg(F.min("bucket_start").alias("a"), F.max("bucket_start").alias("b")).where("a IS NOT NULL")
    weeks = first.select(F.explode(F.expr("sequence(a, b, INTERVAL 7 DAYS)")).alias("bucket_start"))
    out = weeks.join(counts, "bucket_start", "left")
    return out.select(week_id(F.col("bucket_start")).alias("bucket_id"), "bucket_start", F.date_add("bucket_start", 6).alias("bucket_end"), F.coalesce("n", F.lit(0)).alias("n"))
