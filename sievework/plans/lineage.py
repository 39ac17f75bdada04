"""Queries over ids, determinations and append-only tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lineage as L
from ..operators import merge as M
from ..operators.integrity import problems
from .standin import ctes, standin

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LIVE = "SELECT concat('O', o_orderkey) AS observation_id, concat('k', o_orderkey % 977) AS natural_key FROM orders WHERE o_orderkey % 10 < 6"
_REGISTRY = """SELECT concat('O', o_orderkey) AS observation_id, concat('k', o_orderkey % 977) AS natural_key, CASE WHEN o_orderkey % 10 < 6 THEN 'live' ELSE 'retired' END AS status,
 CASE WHEN o_custkey % 11 = 0 THEN 'O9' WHEN o_orderkey % 10 >= 6 AND o_custkey % 3 = 0 THEN concat('O', o_orderkey % 977) END AS current_id, o_orderkey AS seq FROM orders WHERE o_orderkey % 977 < 700 OR o_orderkey % 10 >= 6"""


@query(f"""WITH l AS ({_LIVE}), r AS ({_REGISTRY}), n AS (SELECT natural_key, count(*) AS n, min(observation_id) AS owner FROM l GROUP BY natural_key),
j AS (SELECT r.*, n.n, n.owner, coalesce(current_id, '') AS cur FROM r LEFT JOIN n USING (natural_key))
SELECT observation_id, CASE WHEN status <> 'retired' THEN 'live' WHEN n IS NULL THEN 'hard_deleted' ELSE 'renumbered' END AS state, CASE WHEN status = 'retired' THEN owner END AS live_as,
 CASE WHEN status = 'live' AND cur <> '' THEN 'live, but records current_id ' || cur WHEN status = 'retired' AND n = 1 AND cur <> owner THEN 'current_id ' || CASE WHEN cur = '' THEN '(blank)' ELSE cur END || ', but its claim is live as ' || owner
  WHEN status = 'retired' AND n IS NULL AND cur <> '' THEN 'current_id ' || cur || ', but its claim has no live row' END AS problem FROM j""")
def id_lineage(spark, sf):
    standin(spark, sf)
    return L.id_lineage(spark.sql(_REGISTRY), spark.sql(_LIVE))


@query(f"SELECT observation_id, natural_key FROM ({_REGISTRY}) WHERE status = 'retired' AND natural_key NOT IN (SELECT natural_key FROM ({_LIVE}))")
def hard_deletions(spark, sf):
    """Retired ids whose claim no live row makes: there should be none."""
    standin(spark, sf)
    registry = spark.sql(_REGISTRY)
    lost = L.id_lineage(registry, spark.sql(_LIVE)).where("state = 'hard_deleted'").select("observation_id")
    return registry.join(lost, "observation_id", "left_semi").select("observation_id", "natural_key")


_CITING = "SELECT concat('DR-', c_custkey) AS source, concat('O', c_custkey * 7, '; O', c_custkey * 3, ' ;;O', c_custkey + 100000, '; O', c_custkey * 7) AS ids FROM customer"


@query(ctes("invalid") + f""", l AS ({_LIVE}), r AS ({_REGISTRY}), v AS (SELECT observation_id, min(validity_status) AS s FROM invalid GROUP BY observation_id),
c AS (SELECT DISTINCT source, trim(x) AS observation_id FROM (SELECT source, unnest(string_split(ids, ';')) AS x FROM ({_CITING})) WHERE trim(x) <> '')
SELECT source, observation_id, CASE WHEN observation_id IN (SELECT observation_id FROM l) THEN coalesce('invalidated:' || s, 'valid') WHEN observation_id IN (SELECT observation_id FROM r WHERE status = 'retired') THEN 'deleted' ELSE 'never assigned' END AS state
FROM c LEFT JOIN v USING (observation_id)""")
def citation_states(spark, sf):
    from ..functions.text import id_list

    (invalid,) = standin(spark, sf, "invalid")
    current = invalid.groupBy("observation_id").agg(F.min("validity_status").alias("validity_status"))
    return L.citation_states(spark.sql(_CITING), id_list(F.col("ids")), spark.sql(_LIVE), spark.sql(_REGISTRY), current)


_CLAIMS = "SELECT DISTINCT concat('k', c_custkey % 1300) AS natural_key FROM customer"


@query(f"""WITH r AS ({_REGISTRY}), k AS (SELECT natural_key, arg_max(observation_id, seq) FILTER (status <> 'live') AS retired, bool_or(status = 'live') AS live FROM r GROUP BY natural_key),
a AS (SELECT p.natural_key, CASE WHEN retired IS NOT NULL THEN 'revived' WHEN live THEN 'refused' ELSE 'fresh' END AS action, retired FROM ({_CLAIMS}) p LEFT JOIN k USING (natural_key))
SELECT natural_key, action, CASE WHEN action = 'fresh' THEN printf('O%05d', (SELECT max(CAST(substring(observation_id, 2) AS INT)) FROM r) + row_number() OVER (PARTITION BY action ORDER BY natural_key)) ELSE retired END AS observation_id FROM a""")
def revived_ids(spark, sf):
    standin(spark, sf)
    return L.assign_ids(spark.sql(_CLAIMS), spark.sql(_REGISTRY))


#: A history with the faults that the rules name: repeated ids, pointers to nowhere, to another subject and back.
_OVH = """SELECT concat('OVH-', CAST(100000 + o_orderkey - CASE WHEN o_orderkey % 50 = 7 THEN 1 ELSE 0 END AS STRING)) AS id, concat('O', o_custkey) AS observation_id,
 CASE o_orderkey % 9 WHEN 0 THEN concat('OVH-', CAST(100003 + o_orderkey AS STRING)) WHEN 1 THEN concat('OVH-', CAST(99990 + o_orderkey AS STRING)) WHEN 2 THEN 'OVH-0' WHEN 3 THEN '' WHEN 4 THEN ' ' ELSE concat('OVH-', CAST(100000 + o_orderkey AS STRING)) END AS superseded_by FROM orders"""
_OVH_LIVE = "SELECT concat('O', c_custkey) AS observation_id FROM customer WHERE c_custkey % 4 <> 0"
_OVH_KNOWN = "SELECT concat('O', c_custkey) AS observation_id FROM customer WHERE c_custkey % 8 <> 0"


@query(f"""WITH h AS ({_OVH}), t AS (SELECT id, max(observation_id) AS about FROM h GROUP BY id)
SELECT id, 'duplicate id' AS problem FROM h GROUP BY id HAVING count(*) > 1
UNION ALL SELECT id, CASE WHEN observation_id IN (SELECT observation_id FROM ({_OVH_KNOWN})) THEN 'observation was hard-deleted' ELSE 'observation was never assigned' END FROM h WHERE observation_id NOT IN (SELECT observation_id FROM ({_OVH_LIVE}))
UNION ALL SELECT id, p FROM (SELECT h.id, CASE WHEN t.id IS NULL THEN 'superseded_by does not exist' WHEN t.about <> h.observation_id THEN 'superseded_by is about another observation' WHEN h.superseded_by <= h.id THEN 'superseded_by points backward' END AS p
 FROM h LEFT JOIN t ON t.id = h.superseded_by WHERE trim(h.superseded_by) <> '') WHERE p IS NOT NULL
UNION ALL SELECT min(id), 'more than one current determination' FROM h WHERE trim(superseded_by) = '' GROUP BY observation_id HAVING count(*) > 1""")
def history_problems(spark, sf):
    standin(spark, sf)
    return L.history_problems(spark.sql(_OVH), spark.sql(_OVH_LIVE), spark.sql(_OVH_KNOWN))


_DETERMINATIONS = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'wrong_entity' WHEN o_orderkey % 31 = 5 THEN 'odd' ELSE 'unsupported' END AS validity_status, CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'O1' END AS observation_id,
 CASE WHEN o_orderkey % 17 = 2 THEN '5/1/2026' ELSE '2026-05-01' END AS as_of_date, '2026-05-02' AS determined_at, CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE 'reviewer' END AS determined_by,
 CASE WHEN o_custkey % 23 = 0 THEN '' ELSE 'finding' END AS basis, CASE WHEN o_custkey % 29 = 1 THEN 'OVH-12' WHEN o_custkey % 2 = 0 THEN 'OVH-00012' END AS id FROM orders"""


@query(f"""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN validity_status NOT IN ('wrong_entity', 'unsupported') THEN 'unknown validity_status' END, CASE WHEN trim(observation_id) = '' THEN 'observation_id is required' END,
 CASE WHEN NOT regexp_full_match(as_of_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'as_of_date must be an ISO date' END, CASE WHEN coalesce(determined_by, '') = '' THEN 'determined_by is required' END, CASE WHEN basis = '' THEN 'basis is required' END,
 CASE WHEN id = 'OVH-12' THEN 'id is not of the form OVH-NNNN' END], lambda x: x IS NOT NULL), '; ') AS problems FROM ({_DETERMINATIONS})""")
def determination_rules(spark, sf):
    standin(spark, sf)
    rows = spark.sql(_DETERMINATIONS)
    return rows.select("o_orderkey", F.array_join(L.determination_problems(rows, ("wrong_entity", "unsupported")), "; ").alias("problems"))


_STATUS = "SELECT c_custkey AS company_id, CAST(c_custkey AS STRING) AS id, CASE WHEN c_acctbal > 3000 THEN '1-URGENT' ELSE '2-HIGH' END AS status, DATE '1996-06-01' AS as_of, CASE WHEN c_custkey % 9 = 0 THEN 'x' END AS superseded_by, 0 AS turn FROM customer"
_STATUS_BATCH = "SELECT o_custkey AS company_id, o_orderkey AS turn, CASE WHEN o_orderpriority < '3' THEN o_orderpriority ELSE '3-REST' END AS status, CAST(o_orderdate AS DATE) AS as_of FROM orders"


@query(f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY turn) AS n FROM ({_STATUS_BATCH})), h AS (SELECT * FROM ({_STATUS}) WHERE superseded_by IS NULL),
s AS (SELECT b.company_id, b.turn, b.n, CASE WHEN h.status = b.status THEN 'noop' WHEN b.as_of < h.as_of THEN 'refused' ELSE 'appended' END AS verdict,
  CASE WHEN h.status = b.status OR b.as_of < h.as_of THEN h.status ELSE b.status END AS cur, CASE WHEN h.status = b.status OR b.as_of < h.as_of THEN h.as_of ELSE b.as_of END AS at FROM b LEFT JOIN h USING (company_id) WHERE n = 1
 UNION ALL SELECT b.company_id, b.turn, b.n, CASE WHEN s.cur = b.status THEN 'noop' WHEN b.as_of < s.at THEN 'refused' ELSE 'appended' END,
  CASE WHEN s.cur = b.status OR b.as_of < s.at THEN s.cur ELSE b.status END, CASE WHEN s.cur = b.status OR b.as_of < s.at THEN s.at ELSE b.as_of END FROM s JOIN b ON b.company_id = s.company_id AND b.n = s.n + 1)
SELECT company_id, turn, verdict FROM s""")
def sec_status_sequence(spark, sf):
    """Determinations one after the other: a refused or unchanged one leaves the current row as it is."""
    standin(spark, sf)
    return L.sequential_status(spark.sql(_STATUS), spark.sql(_STATUS_BATCH), "company_id", "status", "as_of", "turn").select("company_id", "turn", "verdict")


_VALID_HISTORY = "SELECT concat('OVH-', o_orderkey) AS id, concat('O', o_custkey) AS observation_id, CASE WHEN o_orderkey % 2 = 0 THEN 'wrong_entity' ELSE 'unsupported' END AS validity_status, 'basis' AS basis, CAST(o_orderdate AS DATE) AS as_of_date, CASE WHEN o_orderstatus = 'P' THEN 'later' END AS superseded_by FROM orders"
_INVALIDATE = "SELECT concat('O', c_custkey) AS observation_id, CASE WHEN c_nationkey < 12 THEN 'wrong_entity' ELSE 'unsupported' END AS validity_status, CASE WHEN c_custkey % 5 = 0 THEN 'other basis' ELSE 'basis' END AS basis, DATE '1999-01-01' AS as_of_date FROM customer"


@query(f"""WITH c AS (SELECT * FROM ({_VALID_HISTORY}) WHERE superseded_by IS NULL QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY id DESC) = 1)
SELECT d.observation_id, d.validity_status, CASE WHEN c.validity_status = d.validity_status AND c.basis = d.basis THEN 'noop' WHEN d.as_of_date < c.as_of_date THEN 'late' ELSE 'appended' END AS verdict,
 CASE WHEN NOT coalesce(c.validity_status = d.validity_status AND c.basis = d.basis, false) AND NOT coalesce(d.as_of_date < c.as_of_date, false) THEN c.id END AS supersedes FROM ({_INVALIDATE}) d LEFT JOIN c USING (observation_id)""")
def invalidate_and_append(spark, sf):
    standin(spark, sf)
    rows = M.supersede(spark.sql(_VALID_HISTORY), spark.sql(_INVALIDATE), "observation_id", ["validity_status", "basis"], "as_of_date", "id")
    return rows.select("observation_id", "validity_status", "verdict", "supersedes")


_TAGS = "SELECT concat('O', c_custkey) AS observation_id, concat('R', c_custkey % 3) AS run_id, CASE WHEN c_nationkey < 9 THEN 'mixed' ELSE 'buyer_side' END AS value FROM customer WHERE c_custkey % 4 < 2"
_TAG_BATCH = """SELECT concat('O', c_custkey) AS observation_id, concat(CASE WHEN c_custkey % 8 = 7 THEN 'backfill_' ELSE '' END, 'R', c_custkey % 3) AS run_id,
 CASE WHEN c_nationkey < 12 THEN 'mixed' ELSE 'buyer_side' END AS value, CASE WHEN c_acctbal < 0 THEN '' ELSE 'why' END AS notes FROM customer"""


@query(f"""WITH b AS (SELECT n.*, t.value AS have, CASE WHEN n.value = 'mixed' AND notes = '' THEN 'a mixed tag needs notes giving the rationale' WHEN starts_with(n.run_id, 'backfill_') AND notes = '' THEN 'a backfilled tag needs notes citing the finding'
 WHEN t.value <> n.value THEN 'already ' || t.value || '; never overwritten' END AS problem FROM ({_TAG_BATCH}) n LEFT JOIN ({_TAGS}) t USING (observation_id, run_id))
SELECT observation_id, run_id, problem, CASE WHEN problem IS NOT NULL THEN 'refused' WHEN have IS NOT NULL THEN 'noop' ELSE 'append' END AS verdict, (SELECT count(problem) = 0 FROM b) AS accepted FROM b""")
def append_guards(spark, sf):
    """Tags are only ever added, and a batch with one fault adds none."""
    standin(spark, sf)
    notes = F.trim("notes") == ""
    rules = problems(((F.col("value") == "mixed") & notes, "a mixed tag needs notes giving the rationale"), (F.startswith("run_id", F.lit("backfill_")) & notes, "a backfilled tag needs notes citing the finding"))
    rows = M.append_only(spark.sql(_TAGS), spark.sql(_TAG_BATCH), ["observation_id", "run_id"], "value", rules)
    return rows.select("observation_id", "run_id", "problem", "verdict", "accepted")


_EXECUTIVES = """SELECT o_custkey AS company_id, concat('n', o_orderkey) AS name_key, o_orderpriority AS title, CASE WHEN o_totalprice < 90000 THEN ' Former' ELSE 'Active' END AS status,
 CASE WHEN o_orderkey % 6 = 0 THEN 'Accepted' WHEN o_orderkey % 6 = 1 THEN 'pending' END AS review_status FROM orders WHERE o_orderkey % 10 < 8"""
_PAGE = "SELECT o_custkey AS company_id, concat('n', o_orderkey) AS name_key, CASE WHEN o_orderkey % 4 = 0 THEN 'new title' ELSE o_orderpriority END AS title FROM orders WHERE o_orderkey % 5 < 3"
_AUTHORITATIVE = "SELECT c_custkey AS company_id FROM customer WHERE c_custkey % 3 = 0"


@query(f"""WITH e AS ({_EXECUTIVES}), p AS ({_PAGE}), j AS (SELECT coalesce(e.company_id, p.company_id) AS company_id, coalesce(e.name_key, p.name_key) AS name_key, e.title AS old, p.title AS new, e.name_key IS NOT NULL AS there, p.name_key IS NOT NULL AS listed,
 lower(coalesce(review_status, '')) IN ('accepted', 'corrected', 'rejected') AS held, lower(trim(status)) = 'active' AS active FROM e FULL JOIN p ON e.company_id = p.company_id AND e.name_key = p.name_key)
SELECT company_id, name_key, CASE WHEN NOT there THEN 'inserted' WHEN listed AND old = new THEN 'unchanged' WHEN listed AND held THEN 'conflict' WHEN listed THEN 'updated'
 WHEN NOT active OR company_id NOT IN (SELECT company_id FROM ({_AUTHORITATIVE})) THEN 'kept' WHEN held THEN 'conflict' ELSE 'superseded' END AS action FROM j""")
def merge_executives_departures(spark, sf):
    standin(spark, sf)
    return M.sync_executives(spark.sql(_EXECUTIVES), spark.sql(_PAGE), ["title"], spark.sql(_AUTHORITATIVE))


_TEXTS = "SELECT o_orderkey AS observation_id, concat('The plant runs ', o_orderpriority, ' lines') AS text, CASE WHEN o_orderkey % 2 = 0 THEN 'seen ' END AS notes FROM orders"
_CORRECTIONS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 3 THEN 'never there' ELSE o_orderpriority END AS old, 'four' AS new, 'reviewer' AS reviewer, '2026-05-01' AS day FROM orders WHERE o_orderkey % 3 = 0"


@query(f"""SELECT observation_id, CASE WHEN contains(text, old) THEN replace(text, old, new) ELSE text END AS text,
 CASE WHEN contains(text, old) THEN concat(CASE WHEN notes IS NULL THEN '' ELSE 'seen ' END, '[2026-05-01 reviewer] corrected text') ELSE notes END AS notes,
 CASE WHEN id IS NULL THEN 'untouched' WHEN contains(text, old) THEN 'corrected' ELSE 'refused' END AS correction FROM ({_TEXTS}) t LEFT JOIN ({_CORRECTIONS}) c ON c.id = t.observation_id""")
def point_corrections(spark, sf):
    standin(spark, sf)
    return M.correct(spark.sql(_TEXTS), spark.sql(_CORRECTIONS), "observation_id", "text", "notes")


_FAMILIES = """SELECT concat('F', s_suppkey % 20) AS family, CASE WHEN s_suppkey % 20 = 3 THEN 'all' ELSE concat(s_suppkey % 22 + 1, '; ', s_suppkey % 7 + 1, ': weak ;') END AS cell FROM supplier"""
_COPY = "SELECT concat('F', s_suppkey % 20) AS family, CAST(s_suppkey % 22 + 1 AS INT) AS dimension FROM supplier"


def _dimensions(spark, sf):
    """A delimited cell as (family, dimension) rows; a cross-cutting family has all 22 dimensions."""
    standin(spark, sf)
    parts = F.when(F.col("cell") == "all", F.transform(F.sequence(F.lit(1), F.lit(22)), lambda x: x.cast("string"))).otherwise(F.split("cell", ";"))
    rows = spark.sql(_FAMILIES).select("family", F.explode(parts).alias("part")).where("trim(part) != ''")
    return rows.select("family", F.trim(F.substring_index("part", ":", 1)).cast("int").alias("dimension"), F.when(F.contains("part", F.lit(":")), F.trim(F.substring_index("part", ":", -1))).alias("note"))


_CELLS = f"""c AS (SELECT family, unnest(CASE WHEN cell = 'all' THEN list_transform(range(1, 23), lambda x: CAST(x AS STRING)) ELSE string_split(cell, ';') END) AS part FROM ({_FAMILIES})),
d AS (SELECT family, CAST(trim(split_part(part, ':', 1)) AS INT) AS dimension, CASE WHEN contains(part, ':') THEN trim(split_part(part, ':', 2)) END AS note FROM c WHERE trim(part) <> '')"""


@query(f"WITH {_CELLS} SELECT family, dimension, note, count(*) AS n FROM d GROUP BY ALL")
def delimited_expand(spark, sf):
    return _dimensions(spark, sf).groupBy("family", "dimension", "note").agg(F.count("*").alias("n"))


@query(f"WITH {_CELLS}, a AS (SELECT DISTINCT family, dimension FROM d), b AS (SELECT DISTINCT * FROM ({_COPY})) SELECT *, 'left' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'right' FROM (FROM b EXCEPT FROM a)")
def batch_partition_check(spark, sf):
    """Two transcriptions of one table compared as sets, both ways."""
    own = _dimensions(spark, sf).select("family", "dimension").distinct()
    return L.set_differences(own, spark.sql(_COPY).distinct())


@query(f"WITH h AS (SELECT *, year(as_of_date) AS derivation FROM ({_VALID_HISTORY})) SELECT id, observation_id FROM h WHERE derivation = (SELECT max(derivation) FROM h)")
def latest_derivation(spark, sf):
    standin(spark, sf)
    rows = spark.sql(_VALID_HISTORY).withColumn("derivation", F.year("as_of_date"))
    return L.latest_partition(rows, "derivation").select("id", "observation_id")
