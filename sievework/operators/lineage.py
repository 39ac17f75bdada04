"""Ids and determinations over time: what was deleted, renumbered, cited, superseded or may be used again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .integrity import problems

#: The form of an ISO date and of a determination's id.
ISO_DATE, DETERMINATION_ID = r"^\d{4}-\d{2}-\d{2}$", r"^OVH-\d{4,}$"


def id_lineage(registry: DataFrame, live: DataFrame) -> DataFrame:
    """Of each registered id its state and what is wrong with its current_id.

    registry has observation_id, natural_key, status and current_id, live has observation_id and natural_key. A retired id whose claim
    is live under another id is renumbered, one whose claim is live nowhere was hard-deleted.
    """
    owners = live.groupBy("natural_key").agg(F.count("*").alias("n"), F.min("observation_id").alias("owner"))
    rows = registry.join(owners, "natural_key", "left").withColumn("current", F.trim(F.coalesce("current_id", F.lit(""))))
    retired = F.col("status") == "retired"
    state = F.when(~retired, "live").when(F.col("n").isNull(), "hard_deleted").otherwise("renumbered")
    problem = (
        F.when((F.col("status") == "live") & (F.col("current") != ""), F.concat(F.lit("live, but records current_id "), "current"))
        .when(retired & (F.col("n") == 1) & (F.col("current") != F.col("owner")), F.concat(F.lit("current_id "), F.when(F.col("current") == "", "(blank)").otherwise(F.col("current")), F.lit(", but its claim is live as "), "owner"))
        .when(retired & F.col("n").isNull() & (F.col("current") != ""), F.concat(F.lit("current_id "), "current", F.lit(", but its claim has no live row")))
    )
    return rows.select("observation_id", state.alias("state"), F.when(state == "renumbered", F.col("owner")).alias("live_as"), problem.alias("problem"))


def citation_states(citing: DataFrame, ids: Column, live: DataFrame, registry: DataFrame, current: DataFrame) -> DataFrame:
    """(source, observation_id, state) of every cited id: valid, invalidated:<status>, deleted or never assigned."""
    cited = citing.select("source", F.explode(ids).alias("observation_id")).distinct()
    rows = cited.join(live.select("observation_id", F.lit(True).alias("_live")).distinct(), "observation_id", "left")
    rows = rows.join(registry.where("status = 'retired'").select("observation_id", F.lit(True).alias("_retired")).distinct(), "observation_id", "left")
    rows = rows.join(current.select("observation_id", "validity_status"), "observation_id", "left")
    state = F.when(F.col("_live"), F.coalesce(F.concat(F.lit("invalidated:"), "validity_status"), F.lit("valid"))).when(F.col("_retired"), "deleted").otherwise("never assigned")
    return rows.select("source", "observation_id", state.alias("state"))


def assign_ids(proposed: DataFrame, registry: DataFrame, prefix: str = "O", width: int = 5) -> DataFrame:
    """The id of each new claim: the retired one seen last, an error where a live one exists, else one above all ever assigned.

    proposed has natural_key, registry observation_id, natural_key, status and seq. Fresh claims are numbered by their keys.
    """
    from .merge import surrogate_ids

    known = registry.groupBy("natural_key").agg(F.max_by(F.when(F.col("status") != "live", F.col("observation_id")), F.when(F.col("status") != "live", F.col("seq"))).alias("retired"), F.bool_or(F.col("status") == "live").alias("live"))
    rows = proposed.select("natural_key").distinct().join(known, "natural_key", "left")
    action = F.when(F.col("retired").isNotNull(), "revived").when(F.col("live"), "refused").otherwise("fresh")
    rows = rows.withColumn("action", action)
    fresh = surrogate_ids(rows.where("action = 'fresh'").select("natural_key"), registry.select("observation_id"), "observation_id", prefix, F.col("natural_key"), width)
    return rows.join(fresh, "natural_key", "left").select("natural_key", "action", F.coalesce("retired", "observation_id").alias("observation_id"))


def determination_problems(rows: DataFrame, statuses: tuple[str, ...]) -> Column:
    """What forbids a single determination."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return problems(
        (~text("validity_status").isin(*statuses), "unknown validity_status"),
        (text("observation_id") == "", "observation_id is required"),
        (~text("as_of_date").rlike(ISO_DATE), "as_of_date must be an ISO date"),
        (~text("determined_at").rlike(ISO_DATE), "determined_at must be an ISO date"),
        (text("determined_by") == "", "determined_by is required"),
        (text("basis") == "", "basis is required"),
        ((text("id") != "") & ~text("id").rlike(DETERMINATION_ID), "id is not of the form OVH-NNNN"),
    )


def history_problems(history: DataFrame, live: DataFrame, known: DataFrame) -> DataFrame:
    """(id, problem): rules that a table of determinations must satisfy as a whole.

    history has id, observation_id and superseded_by; a pointer must lead forward to a row about the same observation.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    twice = history.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    own = history.select("id", "observation_id").join(known.select("observation_id", F.lit(True).alias("_known")).distinct(), "observation_id", "left")
    own = own.join(live.select("observation_id", F.lit(True).alias("_live")).distinct(), "observation_id", "left")
    lost = own.where("observation_id IS NOT NULL AND _live IS NULL").select("id", F.when(F.col("_known").isNull(), "observation was never assigned").otherwise("observation was hard-deleted").alias("problem"))
    target = history.groupBy("id").agg(F.max("observation_id").alias("_about")).select(F.col("id").alias("superseded_by"), "_about", F.lit(True).alias("_there"))
    led = history.where(~blank(F.col("superseded_by"))).join(target, "superseded_by", "left")
    wrong = F.when(F.col("_there").isNull(), "superseded_by does not exist").when(~F.col("_about").eqNullSafe(F.col("observation_id")), "superseded_by is about another observation").when(F.col("superseded_by") <= F.col("id"), "superseded_by points backward")
    led = led.select("id", wrong.alias("problem")).where("problem IS NOT NULL")
    several = history.where(blank(F.col("superseded_by"))).groupBy("observation_id").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1").select("id", F.lit("more than one current determination").alias("problem"))
    return twice.unionByName(lost).unionByName(led).unionByName(several)


def sequential_status(history: DataFrame, batch: DataFrame, subject: str, status: str, as_of: str, order: str) -> DataFrame:
    """What each determination of a batch does, one after the other: appended, noop (same status as the current one) or refused (older).

    A refused or unchanged one leaves the current row as it is, so each is compared with the last that was appended: of a run of
    equal statuses only the first can be, and a date below the largest so far never is. Rows of a subject meet in one group, in order.
    """
    now = history.where("coalesce(superseded_by, '') = ''").groupBy(subject).agg(F.max_by(F.struct(F.col(status).alias("s"), F.col(as_of).alias("d")), F.struct(as_of, order)).alias("now"))
    items = batch.groupBy(subject).agg(F.array_sort(F.collect_list(F.struct(order, status, as_of))).alias("items")).join(now, subject, "left")
    step = F.aggregate(
        "items",
        F.struct(F.col("now").alias("now"), F.array().cast(f"array<struct<o:{dict(batch.dtypes)[order]},v:string>>").alias("out")),
        lambda a, x: F.struct(
            F.when(_verdict(a["now"], x, status, as_of) == "appended", F.struct(x[status].alias("s"), x[as_of].alias("d"))).otherwise(a["now"]).alias("now"),
            F.array_append(a["out"], F.struct(x[order].alias("o"), _verdict(a["now"], x, status, as_of).alias("v"))).alias("out"),
        ),
        lambda a: a["out"],
    )
    done = items.select(subject, F.explode(step).alias("e")).select(subject, F.col("e.o").alias(order), F.col("e.v").alias("verdict"))
    return batch.join(done, [subject, order])


def _verdict(now: Column, x: Column, status: str, as_of: str) -> Column:
    return F.when(now.isNotNull() & (now["s"] == x[status]), "noop").when(now.isNotNull() & (x[as_of] < now["d"]), "refused").otherwise("appended")


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two transcriptions has, with the side."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def latest_partition(rows: DataFrame, version: str) -> DataFrame:
    """The rows of the largest version id."""
    top = rows.agg(F.max(version).alias("_top"))
    return rows.join(F.broadcast(top), F.col(version) == F.col("_top"), "left_semi")


