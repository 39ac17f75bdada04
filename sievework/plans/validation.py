"""Queries that hold whole tables of rows against the rules of writing, some made to break each rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as V
from .planted import quoted
from .standin import standin

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


VOCABULARY = {
    "evidence_family": ("1_first_party", "9_industrial_safety_environmental"), "evidence_role": ("buyer_acts", "buyer_articulates"), "organizational_state": ("unknown", "active_transition"), "signal_strength": ("weak_clue", "measured_result"),
    "source_grade": ("A", "B", "C", "D"), "review_status": ("unreviewed", "accepted"), "publication_state": ("released", "quarantined"), "review_source": ("none", "human"), "audit_verdict": ("supported", "overgraded"),
}
ATTEMPT_VOCABULARY = {"evidence_family": ("1_first_party",), "outcome": ("covered", "absent_confirmed", "partial", "not_covered"), "failure_stage": ("fetch", "parse"), "failure_category": ("access_blocked", "suppressed_by_cap"), "scope": ("scoped", "probe")}
#: A row for each order; one field in some is not what it should be.
_ROWS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN concat('X', o_custkey) ELSE concat('C', o_custkey) END AS company_id, CASE o_orderkey % 11 WHEN 0 THEN 'x' WHEN 1 THEN NULL ELSE '1_first_party' END AS evidence_family, CASE o_orderkey % 13 WHEN 0 THEN '' ELSE 'buyer_acts' END AS evidence_role,
 'unknown' AS organizational_state, CASE o_orderkey % 17 WHEN 0 THEN 'strong' ELSE 'weak_clue' END AS signal_strength, substring('ABCDE', CAST(o_orderkey % 5 + 1 AS INT), 1) AS source_grade, CASE o_orderkey % 6 WHEN 0 THEN 'done' ELSE 'accepted' END AS review_status, 'released' AS publication_state,
 CASE o_orderkey % 9 WHEN 0 THEN NULL ELSE 'human' END AS review_source, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'supported' ELSE 'maybe' END AS audit_verdict, CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN 1.2 WHEN 2 THEN -0.1 ELSE 0.5 END AS confidence_0_1,
 CASE o_orderkey % 10 WHEN 0 THEN '  ' ELSE 'text' END AS observation_text, 'https://x.com' AS source_url, CASE o_orderkey % 12 WHEN 0 THEN NULL ELSE '2024-01-01' END AS retrieval_date, 't' AS topic FROM orders"""


def _listed(rules: list[tuple[str, str]]) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {broken} THEN {quoted(text)} END" for broken, text in rules) + ")"


def _not_in(column: str, words) -> str:
    return f"coalesce({column} NOT IN ({', '.join(map(quoted, words))}), true)"


def _empty(column: str) -> str:
    return f"coalesce(trim(CAST({column} AS VARCHAR)), '') = ''"


_OBSERVATION_RULES = [(_not_in(f, VOCABULARY[f]), f"{f} is outside its vocabulary") for f in V.VOCABULARY_FIELDS] + [
    (f"NOT {_empty('audit_verdict')} AND {_not_in('audit_verdict', VOCABULARY['audit_verdict'])}", "audit_verdict is outside its vocabulary"),
    ("source_grade = 'D'", "grade D is not written"),
    ("coalesce(confidence_0_1 < 0 OR confidence_0_1 > 1, true)", "confidence is out of range"),
    ("company_id NOT IN (SELECT concat('C', c_custkey) FROM customer)", "unknown company"),
    *[(_empty(f), f"{f} is blank") for f in V.REQUIRED_FIELDS],
]


@query(f"WITH r AS ({_ROWS}), p AS (SELECT id, {_listed(_OBSERVATION_RULES)} AS problems FROM r) SELECT * FROM p WHERE problems <> ''")
def observation_problems(spark, sf):
    """All problems of each row of evidence that has any."""
    standin(spark, sf)
    companies = spark.sql("SELECT concat('C', c_custkey) AS company_id FROM customer")
    found = V.observation_problems(spark.sql(_ROWS), companies, VOCABULARY).where(F.size("problems") > 0)
    return found.select("id", F.array_join("problems", "; ").alias("problems"))


_ATTEMPTS = """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'covered' WHEN 1 THEN 'absent_confirmed' WHEN 2 THEN 'partial' WHEN 3 THEN 'not_covered' ELSE 'odd' END AS outcome, CASE event_id % 3 WHEN 0 THEN 'fetch' WHEN 1 THEN '' ELSE NULL END AS failure_stage,
 CASE event_id % 4 WHEN 0 THEN 'access_blocked' WHEN 1 THEN 'suppressed_by_cap' WHEN 2 THEN NULL ELSE 'unheard_of' END AS failure_category, CASE event_id % 7 WHEN 0 THEN NULL ELSE event_id % 7 - 1 END AS records_written, event_id % 2 AS records_reconciled,
 CASE event_id % 6 WHEN 0 THEN 'else' ELSE '1_first_party' END AS evidence_family, CASE event_id % 9 WHEN 0 THEN 'all' ELSE 'scoped' END AS scope FROM events"""
_ATTEMPT_RULES = [
    (f"outcome IN ('partial', 'not_covered') AND ({_empty('failure_stage')} OR {_empty('failure_category')})", "outcome requires a failure stage and category"),
    (f"outcome IN ('covered', 'absent_confirmed') AND NOT ({_empty('failure_stage')} AND {_empty('failure_category')}) AND {_not_in('failure_category', V.GOVERNANCE_SUPPRESSIONS)}", "outcome must not carry a failure"),
    ("outcome = 'covered' AND coalesce(records_written, 0) + records_reconciled <= 0", "covered without a record"),
    *[(f"NOT {_empty(f)} AND {_not_in(f, words)}", f"{f} is outside its vocabulary") for f, words in ATTEMPT_VOCABULARY.items()],
]


@query(f"WITH r AS ({_ATTEMPTS}), p AS (SELECT id, {_listed(_ATTEMPT_RULES)} AS problems FROM r) SELECT * FROM p WHERE problems <> ''")
def attempt_problems(spark, sf):
    """All problems of each attempt that has any."""
    standin(spark, sf)
    found = V.attempt_problems(spark.sql(_ATTEMPTS), ATTEMPT_VOCABULARY).where(F.size("problems") > 0)
    return found.select("id", F.array_join("problems", "; ").alias("problems"))


_TAGS = """SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN concat('O', -o_orderkey) ELSE concat('O', o_orderkey) END AS observation_id, CASE o_orderkey % 5 WHEN 0 THEN 'mixed' WHEN 1 THEN 'buyer_side' WHEN 2 THEN 'sideways' WHEN 3 THEN NULL ELSE 'not_applicable' END AS evidence_directionality,
 CASE o_orderkey % 4 WHEN 0 THEN '2024-1-05' WHEN 1 THEN NULL ELSE '2024-01-05' END AS tagged_at, CASE o_orderkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'backfill_1' ELSE 'HR-1' END AS tagging_run_id, CASE o_orderkey % 2 WHEN 0 THEN 'why' END AS notes FROM orders"""
_TAG_RULES = [
    (_empty("observation_id"), "observation_id is required"),
    (f"NOT {_empty('observation_id')} AND observation_id NOT IN (SELECT concat('O', o_orderkey) FROM orders)", "observation_id does not resolve"),
    (_not_in("evidence_directionality", V.DIRECTIONS), "evidence_directionality is none of the four"),
    ("NOT coalesce(regexp_matches(tagged_at, '^\\d{4}-\\d{2}-\\d{2}$'), false)", "tagged_at must be an ISO date"),
    (_empty("tagging_run_id"), "tagging_run_id is required"),
    (f"evidence_directionality = 'mixed' AND {_empty('notes')}", "a mixed tag needs notes"),
    (f"trim(tagging_run_id) ^@ 'backfill_' AND {_empty('notes')}", "a backfilled tag needs notes"),
]


@query(f"WITH r AS ({_TAGS}), p AS (SELECT id, {_listed(_TAG_RULES)} AS problems FROM r) SELECT * FROM p WHERE problems <> ''")
def tag_problems(spark, sf):
    """All problems of each tag that has any."""
    standin(spark, sf)
    found = V.tag_problems(spark.sql(_TAGS), spark.sql("SELECT concat('O', o_orderkey) AS observation_id FROM orders")).where(F.size("problems") > 0)
    return found.select("id", F.array_join("problems", "; ").alias("problems"))
