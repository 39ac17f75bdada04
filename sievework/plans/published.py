"""Queries over published evidence: coverage, gaps, the evidence matrix, reach and reprocessing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import published as P
from .standin import ctes, standin

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: The numbers of a version as a list, in the other engine.
_V = "list_transform(string_split(substring({0}, 2), '.'), lambda x: CAST(x AS INT))"


@query(ctes("companies", "runs", "attempts") + """
SELECT a.event_id, a.company_id, a.signal, a.outcome FROM attempts a JOIN companies c ON a.company_id = c.company_id
WHERE a.run_id IN (SELECT run_id FROM runs WHERE publication = 'published') AND c.status <> 'provider_benchmark' AND substring(c.company_id, 1, 1) <> 'P'""")
def published_inputs(spark, sf):
    """Attempts of published runs on buyer companies: what every analysis starts from."""
    companies, runs, attempts = standin(spark, sf, "companies", "runs", "attempts")
    rows = P.published_attempts(attempts, runs).join(P.buyers(companies).select("company_id"), "company_id", "left_semi")
    return rows.select("event_id", "company_id", "signal", "outcome")


@query(ctes("harness_sources") + f""", v AS (SELECT *, {_V.format('version')} AS k FROM harness_sources), l AS (SELECT *, max(k) OVER (PARTITION BY harness_id) AS top FROM v)
SELECT harness_id, version, reach, months FROM l WHERE k = top AND role = 'primary'
QUALIFY row_number() OVER (PARTITION BY harness_id ORDER BY CASE reach WHEN 'current_only' THEN 0 WHEN 'bounded' THEN 1 WHEN 'archival' THEN 2 ELSE -1 END, turn) = 1""")
def weakest_reach(spark, sf):
    return P.weakest_reach(*standin(spark, sf, "harness_sources"))


_AUDITED = "SELECT DISTINCT harness_id, version FROM runs WHERE turn % 3 = 0"
_GRANDFATHERED = "SELECT DISTINCT harness_id, version FROM runs WHERE turn % 7 = 1"


@query(ctes("runs", "attempts", "signal_types", "observations", "invalid") + f""", i AS (SELECT DISTINCT observation_id FROM invalid),
o AS (SELECT o.*, i.observation_id IS NOT NULL AS bad FROM observations o LEFT JOIN i USING (observation_id)),
only_bad AS (SELECT harness_id, company_id FROM o WHERE publication = 'released' GROUP BY ALL HAVING bool_and(bad)),
a AS (SELECT a.*, r.harness_id FROM attempts a JOIN runs r USING (run_id) LEFT JOIN signal_types s USING (signal) WHERE scope = 'scoped' AND coalesce(s.signal_status, 'active') = 'active'),
c AS (SELECT run_id, count(*) AS scoped, count_if(outcome <> 'not_covered') AS covered,
  count_if(outcome IN ('covered', 'partial') AND (harness_id, company_id) IN (SELECT (harness_id, company_id) FROM only_bad)) AS covered_invalid_only FROM a GROUP BY run_id),
v AS (SELECT harness_id, version, count(*) AS n_obs, count_if(bad) AS n_obs_invalid FROM o GROUP BY ALL),
j AS (SELECT r.*, coalesce(scoped, 0) AS scoped, coalesce(covered, 0) AS covered, coalesce(covered_invalid_only, 0) AS covered_invalid_only,
  coalesce(n_obs, 0) AS n_obs, coalesce(n_obs_invalid, 0) AS n_obs_invalid FROM runs r LEFT JOIN c USING (run_id) LEFT JOIN v ON v.harness_id = r.harness_id AND v.version = r.version)
SELECT run_id, harness_id, version, publication, scoped, covered, covered_invalid_only, n_obs, n_obs_invalid,
 (harness_id, version) IN (SELECT (harness_id, version) FROM ({_AUDITED})) AS audited, (harness_id, version) IN (SELECT (harness_id, version) FROM ({_GRANDFATHERED})) AS grandfathered,
 CASE WHEN scoped > 0 THEN round(covered / scoped, 6) END AS rate, CASE WHEN scoped > 0 THEN round((covered - covered_invalid_only) / scoped, 6) END AS valid_rate,
 scoped > 0 AND stored_rate IS NOT NULL AND abs(covered / scoped - stored_rate) > 0.0001 AS diverges,
 publication = 'published' AND row_number() OVER (PARTITION BY harness_id, publication = 'published' ORDER BY {_V.format('version')} DESC, turn DESC) = 1 AS quoted FROM j""")
def published_coverage(spark, sf):
    runs, attempts, signals, observations, invalid = standin(spark, sf, "runs", "attempts", "signal_types", "observations", "invalid")
    audited, old = runs.where("turn % 3 = 0"), runs.where("turn % 7 = 1")
    return P.coverage_by_run(runs, attempts, signals, observations, invalid, audited, old)


#: Eleven themes, of which the last is seen by no instrument; rows of the topic T10 have no theme.
_THEMES = "themes AS (SELECT concat('T', CAST(k AS STRING)) AS theme FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) v(k))"
_LICENCE = """licence AS (SELECT theme, count(*) AS n_instruments, count_if(instrument_class IN ('IC3', 'IC4') AND NOT presence_only) AS n_licensing
 FROM instruments LEFT JOIN signal_types USING (signal) GROUP BY theme)"""
_LICENSED = """licensed AS (SELECT DISTINCT i.theme, a.company_id FROM attempts a JOIN runs r ON a.run_id = r.run_id AND r.publication = 'published'
 JOIN signal_types s ON s.signal = a.signal AND s.instrument_class IN ('IC3', 'IC4') AND NOT s.presence_only JOIN instruments i ON i.signal = a.signal
 WHERE a.scope = 'scoped' AND a.outcome IN ('covered', 'absent_confirmed', 'partial'))"""


def _themed(spark, sf):
    observations, instruments, signals = standin(spark, sf, "observations", "instruments", "signal_types")
    themes = spark.range(10).select(F.concat(F.lit("T"), "id").alias("theme"))
    return themes, observations.where("topic != 'T10'").withColumnRenamed("topic", "theme"), P.absence_licence(themes, instruments, signals)


@query(ctes("attempts", "runs", "signal_types", "instruments") + f", {_LICENSED} SELECT theme, company_id FROM licensed")
def licensed_absence(spark, sf):
    return P.licensed_companies(*standin(spark, sf, "attempts", "runs", "instruments", "signal_types"))


@query(ctes("companies", "attempts", "runs", "signal_types", "instruments", "observations", "invalid") + f""", {_THEMES}, {_LICENCE}, {_LICENSED},
r AS (SELECT o.topic AS theme, company_id, CASE WHEN role = 'provider_market_responds' THEN 'seller' ELSE 'buyer' END AS side, substring(excerpt, 1, 11) = '[low-grade:' AS low,
  observation_id IN (SELECT observation_id FROM invalid) AS bad FROM observations o WHERE publication = 'released' AND topic <> 'T10'),
s AS (SELECT theme, side, kind, company_id FROM (SELECT theme, side, company_id, unnest([CASE WHEN NOT bad AND NOT low THEN 'valid' END, CASE WHEN NOT low THEN 'total' END, CASE WHEN NOT bad AND low THEN 'low' END]) AS kind FROM r) WHERE kind IS NOT NULL GROUP BY ALL),
n AS (SELECT theme, side, kind, count(*) AS n, count_if((theme, side, 'valid', company_id) NOT IN (SELECT (theme, side, kind, company_id) FROM s)) AS without FROM s GROUP BY ALL),
t AS (SELECT theme, coalesce(max(n) FILTER (side = 'seller' AND kind = 'valid'), 0) AS sellers, coalesce(max(n) FILTER (side = 'seller' AND kind = 'total'), 0) AS sellers_total,
  coalesce(max(without) FILTER (side = 'seller' AND kind = 'total'), 0) AS sellers_invalid_only, coalesce(max(without) FILTER (side = 'seller' AND kind = 'low'), 0) AS sellers_low_grade_only,
  coalesce(max(n) FILTER (side = 'buyer' AND kind = 'valid'), 0) AS buyers, coalesce(max(n) FILTER (side = 'buyer' AND kind = 'total'), 0) AS buyers_total,
  coalesce(max(without) FILTER (side = 'buyer' AND kind = 'total'), 0) AS buyers_invalid_only, coalesce(max(without) FILTER (side = 'buyer' AND kind = 'low'), 0) AS buyers_low_grade_only
  FROM themes LEFT JOIN n USING (theme) GROUP BY theme),
x AS (SELECT (SELECT count(DISTINCT company_id) FROM s WHERE side = 'seller' AND kind = 'valid') AS providers, (SELECT count(*) FROM companies WHERE status <> 'provider_benchmark' AND substring(company_id, 1, 1) <> 'P') AS universe),
m AS (SELECT theme, count(*) AS n_licensed FROM licensed GROUP BY theme)
SELECT t.*, CASE WHEN providers > 0 THEN round(sellers / providers, 4) END AS provider_share,
 CASE WHEN coalesce(n_instruments, 0) = 0 THEN 'NO INSTRUMENT' WHEN buyers > 0 AND n_licensing > 0 THEN concat('covered (', coalesce(n_licensed, 0), ' of ', universe, ' under a licensed instrument)')
  WHEN buyers > 0 THEN 'covered' WHEN n_licensing = 0 THEN 'no absence license' WHEN coalesce(n_licensed, 0) > 0 THEN concat('buyer silent (', n_licensed, ' of ', universe, ' under a licensed instrument)')
  ELSE concat('licensed instrument unpublished (0 of ', universe, ')') END AS status
FROM t CROSS JOIN x LEFT JOIN licence USING (theme) LEFT JOIN m USING (theme)""")
def gap_report(spark, sf):
    themes, observations, licence = _themed(spark, sf)
    companies, invalid = standin(spark, sf, "companies", "invalid")
    covered = P.licensed_companies(*standin(spark, sf, "attempts", "runs", "instruments", "signal_types"))
    return P.gap_report(themes, observations, invalid, licence, covered, P.buyers(companies))


@query(ctes("signal_types", "instruments", "observations", "invalid", "tags") + f""", {_THEMES}, {_LICENCE},
k AS (SELECT *, topic AS theme, role <> 'provider_market_responds' AS buyer,
 CASE WHEN observation_id IN (SELECT observation_id FROM invalid) THEN CASE WHEN publication = 'released' THEN 'invalid' ELSE 'none' END WHEN publication <> 'released' THEN 'quarantined'
  WHEN role <> 'provider_market_responds' AND observation_id IN (SELECT observation_id FROM tags WHERE directionality = 'seller_side') THEN 'seller_side' ELSE 'valid' END AS kind FROM observations),
g AS (SELECT theme, count_if(kind = 'valid') AS n_valid, count_if(kind = 'valid' AND role = 'buyer_acts') AS buyer_acts, count_if(kind = 'valid' AND role = 'buyer_articulates') AS buyer_articulates,
 count_if(kind = 'valid' AND NOT buyer) AS provider_market_responds, count_if(kind = 'valid' AND grade = 'A') AS grade_a, count_if(kind = 'valid' AND grade = 'B') AS grade_b, count_if(kind = 'valid' AND grade = 'C') AS grade_c,
 count_if(kind = 'valid' AND buyer) AS n_buyer, count(DISTINCT CASE WHEN kind = 'valid' AND buyer THEN company_id END) AS n_buyer_companies, count_if(kind = 'valid' AND buyer AND excerpt LIKE '[low-grade:%') AS n_buyer_low_grade,
 count_if(kind = 'invalid') AS n_invalid_excluded, count_if(kind = 'quarantined') AS n_quarantined_excluded, count_if(kind = 'seller_side') AS n_seller_side_excluded FROM k GROUP BY theme)
SELECT themes.theme, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('n_valid', 'buyer_acts', 'buyer_articulates', 'provider_market_responds', 'grade_a', 'grade_b', 'grade_c', 'n_buyer', 'n_buyer_companies', 'n_buyer_low_grade', 'n_invalid_excluded', 'n_quarantined_excluded', 'n_seller_side_excluded'))},
 CASE WHEN coalesce(n_buyer, 0) > 2 THEN 'substantive_evidence' WHEN coalesce(n_buyer, 0) > 0 THEN 'thin_evidence' WHEN coalesce(n_licensing, 0) > 0 THEN 'confirmed_absence' ELSE 'zero_coverage' END AS state
FROM themes LEFT JOIN g USING (theme) LEFT JOIN licence USING (theme)""")
def theme_evidence_matrix(spark, sf):
    themes, observations, licence = _themed(spark, sf)
    invalid, tags = standin(spark, sf, "invalid", "tags")
    return P.evidence_matrix(themes, observations, invalid, tags, licence)


_ARTIFACTS = """SELECT concat('H', s_suppkey % 9) AS harness_id, concat('v', 1 + s_suppkey % 2, '.', CAST(floor(s_suppkey / 9) AS BIGINT)) AS version,
 CASE WHEN s_suppkey % 4 = 1 THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 5 ELSE 0 END AS wrong_entity,
 CASE WHEN s_suppkey % 6 = 0 THEN 'v1.0' END AS defect_introduced_in FROM supplier"""


@query(f"""WITH a AS (SELECT *, {_V.format('version')} AS k FROM ({_ARTIFACTS})), p AS (SELECT harness_id, max(k) AS top, arg_max(version, k) AS superseded_by FROM a WHERE verdict = 'pass' GROUP BY harness_id)
SELECT harness_id, version, wrong_entity, CASE WHEN defect_introduced_in IS NULL THEN version || ' and all prior versions of ' || harness_id
 ELSE defect_introduced_in || ' and later versions up to ' || version || ' (narrowed by defect_introduced_in)' END AS blast_radius, superseded_by
FROM a LEFT JOIN p USING (harness_id) WHERE wrong_entity > 0 AND (top IS NULL OR k >= top) QUALIFY row_number() OVER (PARTITION BY harness_id ORDER BY k) = 1""")
def reprocessing(spark, sf):
    standin(spark, sf)
    return P.reprocessing_required(spark.sql(_ARTIFACTS))
