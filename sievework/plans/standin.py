"""Tables of the evidence library, made from the driver's tables by SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table

_BASE = ("customer", "supplier", "part", "orders", "events", "documents", "pages", "nation", "region", "lineitem")

#: One SELECT per table. Companies C..., providers P...; themes T0 to T9, T10 is a topic without theme.
TABLES = {
    "companies": """SELECT concat(CASE WHEN c_custkey % 13 = 0 THEN 'P' ELSE 'C' END, c_custkey) AS company_id, c_name AS canonical_name,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN 'provider_benchmark' ELSE 'qualified' END AS status FROM customer""",
    "runs": """SELECT concat('HR-', s_suppkey) AS run_id, concat('H', s_suppkey % 9) AS harness_id,
        concat('v1.', CAST(floor(s_suppkey / 18) AS BIGINT)) AS version, s_suppkey AS turn,
        CASE s_suppkey % 5 WHEN 0 THEN 'quarantined' WHEN 1 THEN 'superseded' ELSE 'published' END AS publication,
        CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE round((s_acctbal + 1000) / 11000, 4) END AS stored_rate FROM supplier""",
    "signal_types": """SELECT * FROM (VALUES ('S0', 'active', 'IC3', false), ('S1', 'active', 'IC4', true), ('S2', 'routing_only', 'IC1', false),
        ('S3', 'active', 'IC4', false), ('S4', 'active', 'IC2', false), ('S5', 'retired', 'IC3', false)) t(signal, signal_status, instrument_class, presence_only)""",
    "instruments": """SELECT * FROM (VALUES ('S0', 'T0'), ('S0', 'T1'), ('S0', 'T2'), ('S1', 'T1'), ('S1', 'T3'), ('S3', 'T2'), ('S3', 'T4'), ('S4', 'T5'), ('S4', 'T0'), ('S2', 'T6')) t(signal, theme)""",
    "attempts": """SELECT event_id, concat('HR-', event_id % 120) AS run_id, concat(CASE WHEN user_id % 13 = 0 THEN 'P' ELSE 'C' END, user_id) AS company_id,
        concat('S', event_id % 7) AS signal, CASE WHEN value < 20 THEN 'probe' ELSE 'scoped' END AS scope,
        CASE event_type WHEN 'purchase' THEN 'covered' WHEN 'signup' THEN 'absent_confirmed' WHEN 'view' THEN 'partial' ELSE 'not_covered' END AS outcome,
        CAST(ts AS DATE) AS tried_on FROM events""",
    "observations": """SELECT concat('O', o_orderkey) AS observation_id, concat('H', o_orderkey % 9) AS harness_id, concat('v1.', o_custkey % 12) AS version,
        concat(CASE WHEN o_custkey % 13 = 0 THEN 'P' ELSE 'C' END, o_custkey) AS company_id, concat('T', CAST(floor(o_totalprice) AS BIGINT) % 11) AS topic,
        CASE o_orderstatus WHEN 'F' THEN 'buyer_acts' WHEN 'O' THEN 'provider_market_responds' ELSE 'buyer_articulates' END AS role,
        CASE WHEN o_custkey % 4 = 0 THEN 'quarantined' ELSE 'released' END AS publication, substring('ABC', CAST(o_orderkey % 3 + 1 AS INT), 1) AS grade,
        CASE WHEN o_orderkey % 5 = 0 THEN '[low-grade: thin] text' ELSE 'text' END AS excerpt, CAST(o_orderdate AS DATE) AS published_on FROM orders""",
    "invalid": """SELECT concat('O', o_orderkey) AS observation_id, CASE WHEN o_totalprice > 450000 THEN 'wrong_entity' ELSE 'unsupported' END AS validity_status
        FROM orders WHERE o_totalprice > 400000 OR o_custkey % 17 = 3""",
    "tags": """SELECT concat('O', o_orderkey) AS observation_id, CASE WHEN o_orderkey % 2 = 0 THEN 'seller_side' ELSE 'mixed' END AS directionality FROM orders WHERE o_orderkey % 7 < 2""",
    "harness_sources": """SELECT p_partkey AS turn, concat('H', p_partkey % 9) AS harness_id, concat('v', p_size % 3, '.', p_size) AS version,
        CASE WHEN p_brand = 'Brand#1' THEN 'secondary' ELSE 'primary' END AS role,
        CASE p_partkey % 4 WHEN 0 THEN 'current_only' WHEN 1 THEN 'bounded' WHEN 2 THEN 'archival' ELSE NULL END AS reach, p_size AS months FROM part""",
}


def standin(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    """The named tables."""
    for base in _BASE:
        read_table(spark, folder, base).createOrReplaceTempView(base)
    return [spark.sql(TABLES[name]) for name in names]


def ctes(*names: str) -> str:
    """The same tables for the other engine."""
    return "WITH " + ", ".join(f"{name} AS ({TABLES[name]})" for name in names)
