"""What is wrong with a row before it is written: evidence, attempts and tags, each with all of its problems in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .integrity import problems

#: Fields of evidence that hold a word of a vocabulary, those that must not be blank, outcomes that need a failure, suppressions that may stand beside a success, words of tags.
VOCABULARY_FIELDS = ("evidence_family", "evidence_role", "organizational_state", "signal_strength", "source_grade", "review_status", "publication_state", "review_source")
REQUIRED_FIELDS = ("observation_text", "source_url", "retrieval_date", "topic")
REQUIRES_FAILURE = ("partial", "not_covered")
FORBIDS_FAILURE = ("covered", "absent_confirmed")
GOVERNANCE_SUPPRESSIONS = ("suppressed_by_cap", "suppressed_redundant", "write_conflict_post_review", "stale_beyond_threshold", "suppressed_generic_only")
DIRECTIONS = ("buyer_side", "seller_side", "mixed", "not_applicable")
BACKFILL = "backfill_"
EXCLUDED_GRADE = "D"


def _blank(column: str) -> Column:
    return F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == ""


def _outside(column: str, words: tuple[str, ...]) -> Column:
    return ~F.coalesce(F.col(column).isin(*words), F.lit(False))


def observation_problems(rows: DataFrame, companies: DataFrame, vocabulary: dict[str, tuple[str, ...]]) -> DataFrame:
    """The rows with `problems`, an array. companies has company_id; a null is outside every vocabulary, but a verdict that is missing is none."""
    known = companies.select("company_id", F.lit(True).alias("_known")).distinct()
    rules = [(_outside(f, vocabulary[f]), f"{f} is outside its vocabulary") for f in VOCABULARY_FIELDS]
    rules += [
        (~_blank("audit_verdict") & _outside("audit_verdict", vocabulary["audit_verdict"]), "audit_verdict is outside its vocabulary"),
        (F.col("source_grade").eqNullSafe(EXCLUDED_GRADE), "grade D is not written"),
        (~F.coalesce(F.col("confidence_0_1").between(0, 1), F.lit(False)), "confidence is out of range"),
        (F.col("_known").isNull(), "unknown company"),
        *[(_blank(f), f"{f} is blank") for f in REQUIRED_FIELDS],
    ]
    return rows.join(known, "company_id", "left").withColumn("problems", problems(*rules)).drop("_known")


def attempt_problems(rows: DataFrame, vocabulary: dict[str, tuple[str, ...]]) -> DataFrame:
    """The rows with `problems`: a gap names its failure, a success carries none but a deliberate suppression, coverage has records, and words are of their vocabularies (blank ones are none)."""
    c = F.col
    stage, category = ~_blank("failure_stage"), ~_blank("failure_category")
    written = F.coalesce("records_written", F.lit(0)) + F.coalesce("records_reconciled", F.lit(0))
    rules = [
        (c("outcome").isin(*REQUIRES_FAILURE) & ~(stage & category), "outcome requires a failure stage and category"),
        (c("outcome").isin(*FORBIDS_FAILURE) & (stage | category) & _outside("failure_category", GOVERNANCE_SUPPRESSIONS), "outcome must not carry a failure"),
        ((c("outcome") == "covered") & (written <= 0), "covered without a record"),
        *[(~_blank(f) & _outside(f, words), f"{f} is outside its vocabulary") for f, words in vocabulary.items()],
    ]
    return rows.withColumn("problems", problems(*rules))


def tag_problems(rows: DataFrame, observations: DataFrame) -> DataFrame:
    """The rows with `problems`: tags of evidence that exists, with a known direction, a load date, a run, and notes where they rest on a rationale or a finding."""
    known = observations.select(F.col("observation_id"), F.lit(True).alias("_known")).distinct()
    run = F.coalesce(F.trim("tagging_run_id"), F.lit(""))
    rules = [
        (_blank("observation_id"), "observation_id is required"),
        (~_blank("observation_id") & F.col("_known").isNull(), "observation_id does not resolve"),
        (_outside("evidence_directionality", DIRECTIONS), "evidence_directionality is none of the four"),
        (~F.coalesce(F.col("tagged_at").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), "tagged_at must be an ISO date"),
        (run == "", "tagging_run_id is required"),
        ((F.col("evidence_directionality") == "mixed") & _blank("notes"), "a mixed tag needs notes"),
        (F.startswith(run, F.lit(BACKFILL)) & _blank("notes"), "a backfilled tag needs notes"),
    ]
    return rows.join(known, "observation_id", "left").withColumn("problems", problems(*rules)).drop("_known")
