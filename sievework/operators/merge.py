"""Idempotent merge on a key with protection of human review; histories and snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fingerprint

#: Review statuses that a person has set.
HUMAN_STATUSES = ("accepted", "corrected", "rejected")


def human_authored(review_source: Column, review_status: Column) -> Column:
    return F.coalesce(F.lower(review_source) == "human", F.lit(False)) | F.coalesce(review_status.isin(*HUMAN_STATUSES), F.lit(False))


def sync_actions(existing: DataFrame, proposed: DataFrame, key: list[str], fields: list[str], order: str, refresh: Column | None = None) -> DataFrame:
    """What each proposed row does: inserted, invalid, unchanged, conflict or updated.

    existing has key, fields, is_human and is_invalid. A key proposed twice inserts once; later
    rows compare with what is stored by then, in `order`: the proposal before, or, where a person's row
    is protected and so was never changed, the row itself.
    """
    mark = fingerprint(*[F.col(c) for c in fields])
    have = existing.select(*key, mark.alias("_old"), "is_human", "is_invalid", F.lit(True).alias("_there"))
    w = Window.partitionBy(*key).orderBy(order)
    rows = proposed.withColumn("_new", mark).withColumn("_before", F.lag("_new").over(w)).join(have, key, "left")
    protected = F.coalesce("is_human", F.lit(False)) & ~(refresh if refresh is not None else F.lit(False))
    against = F.when(protected, F.col("_old")).otherwise(F.coalesce("_before", "_old"))
    action = (
        F.when(F.col("_there").isNull() & F.col("_before").isNull(), "inserted")
        .when(F.coalesce("is_invalid", F.lit(False)), "invalid")
        .when(F.col("_new") == against, "unchanged")
        .when(protected, "conflict")
        .otherwise("updated")
    )
    return rows.withColumn("action", action).drop("_new", "_old", "_before", "_there", "is_human", "is_invalid")


def apply_actions(existing: DataFrame, decided: DataFrame, key: list[str], fields: list[str], order: str) -> DataFrame:
    """The table after the merge: nothing is deleted, protected rows stay as they were."""
    last = decided.where("action IN ('inserted', 'updated')").withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_n = 1").select(*key, *fields)
    # Not as an anti join, which would be moved ahead of a dealing by key.
    same = existing.select(*key, *fields).join(last.select(*key, F.lit(True).alias("_changed")), key, "left").where("_changed IS NULL").drop("_changed")
    return same.unionByName(last)


def unreproduced(existing: DataFrame, proposed: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows that a new run didn't propose: eligible for invalidation, or held because of a person."""
    missed = existing.join(proposed.select(*key, F.lit(True).alias("_proposed")), key, "left").where("_proposed IS NULL").drop("_proposed")
    return missed.withColumn("verdict", F.when(F.col("is_human"), "held").otherwise("eligible"))


def current_rows(history: DataFrame, subject: str, order: list[str]) -> DataFrame:
    """The latest row of each subject that nothing supersedes."""
    w = Window.partitionBy(subject).orderBy(*[F.desc(c) for c in order])
    return history.where("coalesce(superseded_by, '') = ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def status_changes(history: DataFrame, subject: str, status: str, order: list[str]) -> DataFrame:
    """Determinations that change a subject's status, each with the one that supersedes it."""
    w = Window.partitionBy(subject).orderBy(*order)
    changed = history.withColumn("_p", F.lag(status).over(w)).where(f"NOT (_p <=> {status})").drop("_p")
    return changed.withColumn("superseded_at", F.lead(order[0]).over(w))


def late_rows(history: DataFrame, subject: str, arrival: str, as_of: str) -> DataFrame:
    """Rows that arrive with an older date than one that came before: refused."""
    w = Window.partitionBy(subject).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return history.withColumn("_m", F.max(as_of).over(w)).where(f"{as_of} < _m").drop("_m")


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Per key: added, lost, changed or same."""
    mark = fingerprint(*[F.col(c) for c in fields])
    a, b = before.select(*key, mark.alias("_a")), after.select(*key, mark.alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "lost").when(F.col("_a") == F.col("_b"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").select(*key, kind.alias("change"))


def surrogate_ids(new: DataFrame, known: DataFrame, id_col: str, prefix: str, order: Column, width: int = 5, range_rows: int = 100_000) -> DataFrame:
    """Ids after the largest known one; ids of another form are ignored.

    Numbers new rows in order: ranges of about `range_rows` rows are counted and numbered each on its own. Their bounds are
    taken once, from a sample by hash of about 64 values a range, so the ranges are the same in each reading.
    """
    top = known.select(F.coalesce(F.max(F.regexp_extract(id_col, f"^{prefix}([0-9]+)$", 1).try_cast("int")), F.lit(0)).alias("_top"))
    rows, n = new.withColumn("_order", order), new.count()
    ranges, bounds = -(-n // range_rows), []
    if ranges > 1:
        found = rows.select("_order").where(F.col("_order").isNotNull() & (F.pmod(F.xxhash64("_order"), F.lit(max(1, n // (64 * ranges)))) == 0)).sort("_order").collect()
        bounds = [found[k * len(found) // ranges][0] for k in range(1, ranges)] if found else []
    cuts = F.array(*map(F.lit, bounds)).cast(f"array<{dict(rows.dtypes)['_order']}>")
    rows = rows.withColumn("_range", F.when(F.col("_order").isNull(), 0).otherwise(F.size(F.filter(cuts, lambda b: b <= F.col("_order")))))
    # A row per range.
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_size"))
    ahead = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_ahead"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy("_order")) + F.col("_ahead")
    ids = F.format_string(f"{prefix}%0{width}d", F.col("_top") + number)
    return rows.join(F.broadcast(ahead), "_range").crossJoin(top).withColumn(id_col, ids).drop("_top", "_range", "_order", "_ahead")


def sync_executives(existing: DataFrame, proposed: DataFrame, fields: list[str], authoritative: DataFrame) -> DataFrame:
    """What happens to each person, by (company_id, name_key): inserted, unchanged, conflict, updated, superseded or kept.

    A person missing from the proposal has left only if the company's page was read with authority, the row is active and no
    person has reviewed it; a reviewed row is a conflict. existing has company_id, name_key, fields, status and review_status.
    """
    reviewed = F.lower(F.trim(F.coalesce("review_status", F.lit("")))).isin(*HUMAN_STATUSES)
    mark = fingerprint(*[F.col(c) for c in fields])
    a = existing.select("company_id", "name_key", mark.alias("_old"), reviewed.alias("_held"), (F.lower(F.trim("status")) == "active").alias("_active"))
    b = proposed.select("company_id", "name_key", mark.alias("_new"))
    known = authoritative.select("company_id", F.lit(True).alias("_read")).distinct()
    rows = a.join(b, ["company_id", "name_key"], "full_outer").join(known, "company_id", "left")
    gone = F.coalesce(F.col("_read") & F.col("_active"), F.lit(False))
    action = (
        F.when(F.col("_old").isNull(), "inserted")
        .when(F.col("_new").isNull(), F.when(~gone, "kept").when(F.col("_held"), "conflict").otherwise("superseded"))
        .when(F.col("_old") == F.col("_new"), "unchanged")
        .when(F.col("_held"), "conflict")
        .otherwise("updated")
    )
    return rows.select("company_id", "name_key", action.alias("action"))


def append_only(existing: DataFrame, batch: DataFrame, key: list[str], value: str, problems: Column) -> DataFrame:
    """The batch with verdict: append, noop (identical) or refused, and its first problem. A stored value is never overwritten.

    The batch is all or nothing: `accepted` is true in every row or in none.
    """
    have = existing.select(*key, F.col(value).alias("_have"), F.lit(True).alias("_there"))
    rows = batch.withColumn("_twice", F.row_number().over(Window.partitionBy(*key).orderBy(value)) > 1).join(have, key, "left")
    own = F.get(problems, F.lit(0))
    problem = F.coalesce(
        own,
        F.when(F.col("_twice"), "the same key appears twice in the batch"),
        F.when(F.col("_there") & ~F.col("_have").eqNullSafe(F.col(value)), F.concat(F.lit("already "), F.coalesce("_have", F.lit("blank")), F.lit("; never overwritten"))),
    )
    rows = rows.withColumn("problem", problem)
    verdict = F.when(F.col("problem").isNotNull(), "refused").when(F.col("_there"), "noop").otherwise("append")
    clean = rows.agg((F.count("problem") == 0).alias("accepted"))
    return rows.withColumn("verdict", verdict).drop("_have", "_there", "_twice").crossJoin(F.broadcast(clean))


def supersede(history: DataFrame, batch: DataFrame, subject: str, value: list[str], as_of: str, order: str) -> DataFrame:
    """Each new determination against the current one of its subject: appended, noop, late, with the row it supersedes.

    One determination for each subject and batch; later ones are for the next batch. history has id and superseded_by.
    """
    now = current_rows(history, subject, [order]).select(subject, F.col(as_of).alias("_as_of"), F.col("id").alias("supersedes"), *[F.col(v).alias(f"_{v}") for v in value])
    rows = batch.join(now, subject, "left")
    same = F.col("supersedes").isNotNull()
    for v in value:
        same = same & F.col(v).eqNullSafe(F.col(f"_{v}"))
    verdict = F.when(same, "noop").when(F.col(as_of) < F.col("_as_of"), "late").otherwise("appended")
    rows = rows.withColumn("verdict", verdict)
    return rows.select(*batch.columns, "verdict", F.when(F.col("verdict") == "appended", F.col("supersedes")).alias("supersedes"))


def correct(rows: DataFrame, corrections: DataFrame, id_col: str, column: str, notes: str) -> DataFrame:
    """Point corrections: where the old text is still there, the new one and a stamped note; otherwise the row stays as it was.

    corrections has id, old, new, reviewer and day, one row for each id.
    """
    own = corrections.select(F.col("id").alias(id_col), "old", "new", "reviewer", "day")
    out = rows.join(own, id_col, "left")
    fits = F.coalesce(F.contains(column, "old"), F.lit(False))
    note = F.concat_ws(" ", F.nullif(F.trim(F.coalesce(notes, F.lit(""))), F.lit("")), F.concat(F.lit("["), "day", F.lit(" "), "reviewer", F.lit("] corrected "), F.lit(column)))
    state = F.when(F.col("old").isNull(), "untouched").when(fits, "corrected").otherwise("refused")
    return out.select(
        *[F.when(fits, F.replace(column, "old", "new")).otherwise(F.col(column)).alias(c) if c == column else F.when(fits, note).otherwise(F.col(notes)).alias(c) if c == notes else F.col(c) for c in rows.columns],
        state.alias("correction"),
    )
