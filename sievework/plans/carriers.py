"""Queries over carrier snapshots and over a person's verdicts, made from whole tables by SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, carriers
from .standin import standin

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


#: A snapshot for each customer; the numbers that a page may lack are null for some.
_SNAPSHOT = """SELECT c_custkey AS id, CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 0 ELSE c_custkey % 90 END AS power_units, CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE c_custkey % 130 END AS drivers,
 CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Private(Property)' WHEN 2 THEN 'Auth. For Hire' ELSE 'Private Property;Exempt For Hire' END AS classes, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Property Broker' ELSE 'Property' END AS authorized_for,
 CASE c_custkey % 3 WHEN 0 THEN 'NOT AUTHORIZED' ELSE 'AUTHORIZED FOR Property' END AS authority_status, CASE c_custkey % 10 WHEN 0 THEN NULL ELSE 'CARRIER' END AS entity_type, CASE c_custkey % 6 WHEN 0 THEN 'OUT-OF-SERVICE' ELSE 'Active' END AS usdot_status,
 CASE WHEN c_custkey % 13 <> 0 THEN DATE '2024-06-01' - CAST(c_custkey % 1500 AS INT) END AS filed_on, DATE '2024-06-01' AS data_as_of, CASE c_custkey % 7 WHEN 0 THEN NULL ELSE c_custkey % 7 - 1 END AS crashes_total,
 CASE c_custkey % 8 WHEN 0 THEN 'many' WHEN 1 THEN NULL ELSE CAST(c_custkey % 120 AS STRING) END AS employees, 0.5 + (c_custkey % 10) / 20.0 AS confidence, upper(c_name) AS name_key,
 CASE c_custkey % 9 WHEN 0 THEN '' WHEN 1 THEN upper(c_name) WHEN 2 THEN concat(upper(c_name), ';OTHER') ELSE 'ONE;TWO' END AS family,
 CASE c_custkey % 12 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE c_custkey % 140 END AS vehicle_inspections, c_custkey % 5 AS vehicle_oos, CAST(c_custkey % 40 AS DOUBLE) AS vehicle_oos_pct, CASE WHEN c_custkey % 17 <> 0 THEN 22.26 END AS vehicle_national_pct,
 c_custkey % 30 AS driver_inspections, c_custkey % 3 AS driver_oos, CAST(c_custkey % 9 AS DOUBLE) AS driver_oos_pct, 6.67 AS driver_national_pct FROM customer"""
_HERE = _SNAPSHOT.replace("DATE '2024-06-01' - CAST(c_custkey % 1500 AS INT)", "date_sub(DATE '2024-06-01', CAST(c_custkey % 1500 AS INT))")


def _oos(who: str, topic: str, emitter: str) -> str:
    i, r, n = (f"{who}_{x}" for x in ("inspections", "oos_pct", "national_pct"))
    return f"""SELECT id, '{emitter}' AS emitter, CASE WHEN {i} > 0 AND {i} < 20 AND {r} IS NOT NULL AND {n} IS NOT NULL THEN '{who}_out_of_service_rate' ELSE '{topic}' END AS topic,
 CASE WHEN {i} IS NULL OR {r} IS NULL OR {n} IS NULL OR {i} = 0 THEN NULL WHEN {i} >= 20 AND {r} > {n} THEN 'legacy_constraint' ELSE 'unknown' END AS state, CASE WHEN {i} >= 20 THEN 'measured_result' ELSE 'weak_clue' END AS strength,
 CASE WHEN {i} < 20 THEN 0.4 ELSE confidence - CASE WHEN {i} < 100 THEN 0.1 ELSE 0 END END AS confidence, CASE WHEN {i} < 20 THEN concat({i}, ' inspections, below the 20-inspection floor') ELSE '' END AS low_grade,
 CASE WHEN {i} < 20 THEN {who}_oos ELSE round({r} - {n}, 2) END AS value, CASE WHEN {i} IS NULL OR {r} IS NULL OR {n} IS NULL THEN 'inspections or rates were not read' WHEN {i} = 0 THEN 'no inspection in the window' ELSE '' END AS skipped FROM s"""


@query(f"""WITH s AS (SELECT *, (data_as_of - filed_on) / 30.44 AS age, coalesce(power_units, 0) AS n, try_cast(employees AS INT) AS staff, CASE WHEN classes = '' THEN NULL ELSE NOT contains(lower(classes), 'for hire') END AS private,
 CASE WHEN family = '' THEN 0 ELSE len(string_split(family, ';')) END AS members, CASE WHEN family = '' THEN 0 ELSE len(list_filter(string_split(family, ';'), lambda x: x <> name_key)) END AS others FROM ({_SNAPSHOT})),
u AS (SELECT id, 'fleet_scale' AS emitter, 'fleet_scale' AS topic, 'unknown' AS state, 'weak_clue' AS strength, CASE WHEN n = 0 AND coalesce(drivers, 0) = 0 THEN 0.4 ELSE confidence - CASE WHEN age > 24 THEN 0.1 ELSE 0 END END AS confidence,
  CASE WHEN n = 0 AND coalesce(drivers, 0) = 0 THEN 'nil fleet return' ELSE '' END AS low_grade, power_units::DOUBLE AS value, CASE WHEN power_units IS NULL AND drivers IS NULL THEN 'neither power units nor drivers were read' ELSE '' END AS skipped FROM s
UNION ALL SELECT id, 'operating_model', 'operating_model', 'unknown', CASE WHEN n = 0 AND contains(coalesce(authorized_for, ''), 'Broker') THEN 'committed_action' ELSE 'weak_clue' END, confidence, '', n, CASE WHEN authorized_for IS NULL AND entity_type IS NULL THEN 'neither authority nor entity type was read' ELSE '' END FROM s
UNION ALL {_oos('vehicle', 'vehicle_maintenance_out_of_service_rate', 'vehicle_oos')} UNION ALL {_oos('driver', 'driver_compliance_out_of_service_rate', 'driver_oos')}
UNION ALL SELECT id, 'crash_exposure', 'crash_exposure_rate', 'unknown', CASE WHEN coalesce(crashes_total, 0) = 0 THEN 'weak_clue' ELSE 'measured_result' END, CASE WHEN coalesce(crashes_total, 0) = 0 THEN 0.4 ELSE confidence END,
  CASE WHEN coalesce(crashes_total, 0) = 0 THEN 'zero crashes in the window' ELSE '' END, CASE WHEN coalesce(crashes_total, 0) = 0 THEN 0 WHEN n >= 20 THEN round(crashes_total / n * 100, 1) END, '' FROM s WHERE n > 0
UNION ALL SELECT id, 'registry_maintenance', 'registry_record_maintenance_lag', CASE WHEN age > 24 THEN 'legacy_constraint' ELSE 'unknown' END, 'weak_clue', CASE WHEN age > 24 THEN greatest(confidence - 0.05, 0.3) ELSE 0.35 END,
  CASE WHEN age > 24 THEN '' ELSE concat('filing ', floor(age)::INT, ' months old, inside the 24-month window') END, floor(age), '' FROM s WHERE age >= 12 AND contains(upper(usdot_status), 'ACTIVE')
UNION ALL SELECT id, 'workforce_conflict', 'workforce_scale_conflict', 'unknown', 'weak_clue', CASE WHEN drivers <= staff * 1.25 THEN 0.35 ELSE confidence END, CASE WHEN drivers <= staff * 1.25 THEN 'drivers exceed employees by less than the 25% band' ELSE '' END, drivers - staff,
  CASE WHEN coalesce(employees, '') <> '' AND staff IS NULL THEN 'the number of employees is no number' WHEN coalesce(drivers, 0) = 0 OR coalesce(staff, 0) = 0 THEN 'drivers or employees are unknown' ELSE '' END
  FROM s WHERE coalesce(employees, '') <> '' AND staff IS NULL OR coalesce(drivers, 0) = 0 OR coalesce(staff, 0) = 0 OR drivers > staff
UNION ALL SELECT id, 'for_hire_authority_gap', 'for_hire_authority_not_active', 'legacy_constraint', 'measured_result', least(confidence, 0.7), '', NULL, CASE WHEN private IS NULL THEN 'no classification, so private carriage can''t be excluded' ELSE '' END
  FROM s WHERE contains(authority_status, 'NOT AUTHORIZED') AND (private IS NULL OR NOT private)
UNION ALL SELECT id, 'multi_entity_structure', 'multi_entity_operating_structure', 'unknown', 'repeated_pattern', 0.55, '', others + 1, CASE WHEN others = 0 THEN 'registrations under the same name are duplicates' ELSE '' END FROM s WHERE members > 0)
SELECT id, emitter, topic, skipped, CASE WHEN skipped = '' THEN state END AS state, CASE WHEN skipped = '' THEN strength END AS strength, CASE WHEN skipped = '' THEN CASE WHEN low_grade = '' THEN 'A' ELSE 'C' END END AS grade,
  CASE WHEN skipped = '' THEN round(CASE WHEN low_grade = '' THEN confidence ELSE least(confidence, 0.4) END, 2)::DOUBLE END AS confidence, CASE WHEN skipped = '' THEN low_grade END AS low_grade, CASE WHEN skipped = '' THEN coalesce(value, CASE WHEN low_grade = 'nil fleet return' THEN 0 END)::DOUBLE END AS value FROM u""")
def carrier_emitters(spark, sf):
    """Nine emitters over a snapshot of each customer: claims, low-grade claims with the bar that they miss, and reasons for silence."""
    standin(spark, sf)
    rows = spark.sql(_HERE).withColumns({"classes": F.filter(F.split("classes", ";"), lambda c: c != ""), "family": F.transform(F.filter(F.split("family", ";"), lambda c: c != ""), lambda c: F.struct(c.alias("name_key")))})
    return carriers.carrier_claims(rows, "id")


_VERDICT = """SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN 'supported' WHEN 1 THEN 'overgraded' WHEN 2 THEN 'overgraded' WHEN 3 THEN 'unsupported' WHEN 4 THEN 'wrong_entity' ELSE 'maybe' END AS verdict, concat('A', o_custkey % 3) AS auditor,
 CASE WHEN o_orderkey % 2 = 0 THEN concat('note ', o_orderkey) END AS notes, CASE WHEN o_orderkey % 9 = 1 THEN 'weak_clue' END AS signal_strength, CAST(NULL AS STRING) AS organizational_state, CASE WHEN o_orderkey % 18 = 1 THEN 'C' END AS source_grade, CAST(NULL AS DOUBLE) AS confidence_0_1
 FROM orders WHERE o_orderkey % 9 < 6 AND o_custkey % 2 = 0 UNION ALL SELECT -o_orderkey, 'supported', 'A1', NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 50 = 7"""
_JUDGED = """SELECT o_orderkey AS id, 'measured_result' AS signal_strength, 'unknown' AS organizational_state, 'A' AS source_grade, 0.8 AS confidence_0_1, CAST(NULL AS STRING) AS audit_verdict, CASE WHEN o_orderkey % 5 = 0 THEN 'machine' END AS review_source,
 CAST(NULL AS STRING) AS review_status, 'quarantined' AS publication_state, CASE o_orderkey % 4 WHEN 0 THEN 'earlier' WHEN 1 THEN ' ' END AS reviewer_notes FROM orders"""


@query(f"""WITH r AS ({_JUDGED}), v AS ({_VERDICT}), b AS (SELECT coalesce(r.id, v.id) AS id, r.id AS rid, v.id AS vid, r.* EXCLUDE (id), v.verdict, v.auditor, v.notes, v.signal_strength AS s2, v.organizational_state AS o2, v.source_grade AS g2, v.confidence_0_1 AS c2 FROM r FULL JOIN v ON r.id = v.id),
f AS (SELECT *, CASE WHEN verdict NOT IN ('supported', 'overgraded', 'unsupported', 'wrong_entity') THEN 'no such verdict' WHEN rid IS NULL THEN 'no such row' WHEN verdict IN ('unsupported', 'wrong_entity') THEN 'record it invalid instead'
  WHEN verdict = 'overgraded' AND s2 IS NULL AND o2 IS NULL AND g2 IS NULL AND c2 IS NULL THEN 'overgraded must lower something' ELSE '' END AS refused FROM b), g AS (SELECT *, verdict IS NOT NULL AND refused = '' AS done FROM f)
SELECT id, CASE WHEN done THEN coalesce(s2, signal_strength) ELSE signal_strength END AS signal_strength, organizational_state, CASE WHEN done THEN coalesce(g2, source_grade) ELSE source_grade END AS source_grade, confidence_0_1::DOUBLE AS confidence_0_1,
  CASE WHEN done THEN verdict END AS audit_verdict, CASE WHEN done THEN 'human' ELSE review_source END AS review_source, CASE WHEN done THEN 'accepted' END AS review_status, CASE WHEN done THEN 'released' ELSE publication_state END AS publication_state,
  CASE WHEN done THEN trim(concat_ws(' ', nullif(trim(reviewer_notes), ''), trim('[2024-06-01 audit by ' || auditor || '; verdict ' || verdict || '] ' || coalesce(notes, '')))) ELSE reviewer_notes END AS reviewer_notes, refused FROM g""")
def audit_verdicts(spark, sf):
    """A person's verdicts applied to all orders as rows of evidence: accepted ones with their downgrades and stamps, refused ones with the reason."""
    standin(spark, sf)
    return audit.judge_rows(spark.sql(_JUDGED).withColumn("confidence_0_1", F.col("confidence_0_1").cast("double")), spark.sql(_VERDICT), "id", "2024-06-01")
