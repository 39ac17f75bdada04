"""Queries over driver tables that stand in for the evidence tables, first part: coverage, keys, merge, identity.

Each query is a function (spark, sf_dir) with the SQL that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scores import rate
from ..operators import coverage, integrity, merge, resolution, sequences
from ..sources.tables import dealt, known_rows, read_table, table_counts, vocabulary

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Events as attempts, in the words of both engines.
ATTEMPTS = """SELECT event_id, user_id AS company_id, concat('HR-', CAST(floor(value) AS BIGINT) % 7) AS run_id, ts,
 CASE event_type WHEN 'purchase' THEN 'covered' WHEN 'signup' THEN 'absent_confirmed' WHEN 'view' THEN 'partial' ELSE 'not_covered' END AS outcome,
 concat('S', CAST(floor(value) AS BIGINT) % 6) AS signal,
 CASE WHEN CAST(floor(value) AS BIGINT) % 6 = 5 THEN 'routing_only' WHEN CAST(floor(value) AS BIGINT) % 6 = 4 THEN NULL ELSE 'active' END AS signal_status,
 CASE WHEN value < 20 THEN 'probe' ELSE 'scoped' END AS scope,
 CASE event_type WHEN 'error' THEN 'HTTPError: 429 from CDX' WHEN 'view' THEN 'edge rate limiting; robots.txt on host disallows /'
  WHEN 'signup' THEN 'Web Page Blocked! attack id 8812' WHEN 'click' THEN 'homepage unreachable (status 403, )' ELSE NULL END AS detail
FROM events"""


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    read_table(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql(ATTEMPTS)


_A = f"WITH a AS ({ATTEMPTS}) "


@query(_A + """SELECT run_id, count(*) AS attempts_total, count(*) FILTER (outcome = 'covered') AS n_covered, count(*) FILTER (outcome = 'absent_confirmed') AS n_absent_confirmed,
 count(*) FILTER (outcome = 'partial') AS n_partial, count(*) FILTER (outcome = 'not_covered') AS n_not_covered,
 round(count(*) FILTER (outcome <> 'not_covered') / count(*), 4) AS coverage_rate FROM a WHERE scope = 'scoped' AND coalesce(signal_status, 'active') = 'active' GROUP BY run_id""")
def coverage_rollup(spark, sf):
    return coverage.coverage_rollup(attempts(spark, sf), ["run_id"])


@query(_A + """, d AS (SELECT c_custkey AS company_id, s.signal FROM customer, (VALUES ('S0'), ('S1'), ('S2')) s(signal))
SELECT d.company_id, d.signal, 'not_covered' AS outcome, 'discovery' AS failure_stage, 'source_not_found' AS failure_category
FROM d WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.company_id = d.company_id AND a.signal = d.signal)""")
def scope_closeout_missing(spark, sf):
    declared = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("company_id"), F.explode(F.array(*[F.lit(s) for s in ("S0", "S1", "S2")])).alias("signal"))
    return coverage.missing_scope(declared, attempts(spark, sf), ["company_id", "signal"])


@query(_A + """, g AS (SELECT detail, count(*) AS failures, list_sort(list(DISTINCT CAST(company_id AS VARCHAR))) AS l FROM a WHERE outcome IN ('partial', 'not_covered') GROUP BY detail)
SELECT detail, failures, array_to_string(l[1:6], ', ') || CASE WHEN len(l) > 6 THEN ' +' || (len(l) - 6) || ' more' ELSE '' END AS ids FROM g""")
def derived_known_issues(spark, sf):
    return coverage.known_issues(attempts(spark, sf).where("outcome IN ('partial', 'not_covered')"), "detail", "company_id")


@query(_A + """, c AS (SELECT *, CASE WHEN lower(detail) LIKE '%robots.txt%' THEN 'source_refusal' WHEN lower(detail) LIKE '%web page blocked%' THEN 'egress_blocked'
 WHEN lower(detail) LIKE '%429%' THEN 'rate_limited' ELSE 'unclassified' END AS access_class FROM a WHERE outcome <> 'covered')
SELECT access_class, count(*) AS n_rows, count(DISTINCT (company_id, signal)) AS n_units, count(DISTINCT company_id) AS n_companies FROM c GROUP BY access_class""")
def access_failure_classes(spark, sf):
    return coverage.access_report(attempts(spark, sf).where("outcome != 'covered'"), "detail", ["company_id", "signal"])


@query("""WITH r AS (SELECT *, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders), t AS (SELECT *, max(y * 100 + m) OVER (PARTITION BY o_orderpriority) AS top FROM r)
SELECT o_orderpriority AS harness_id, concat('v', y, '.', m) AS version, count(*) AS runs, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 4) AS share_final FROM t WHERE y * 100 + m = top GROUP BY ALL""")
def published_coverage_latest(spark, sf):
    runs = read_table(spark, sf, "orders").select(F.col("o_orderpriority").alias("harness_id"), F.concat(F.lit("v"), F.year("o_orderdate"), F.lit("."), F.month("o_orderdate")).alias("version"), "o_orderstatus")
    return coverage.latest_versions(runs, "harness_id", "version").groupBy("harness_id", "version").agg(F.count("*").alias("runs"), rate(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("share_final"))


@query(r"""SELECT l_orderkey, l_linenumber, concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), trim(l_returnflag)) AS natural_key,
 substring(sha256(concat_ws(chr(31), CAST(l_partkey AS VARCHAR), trim(l_linestatus), regexp_replace(printf('%.4f', l_extendedprice), '\.?0+$', ''), regexp_replace(printf('%.4f', l_discount), '\.?0+$', ''))), 1, 16) AS fingerprint FROM lineitem""")
def natural_key_fingerprint(spark, sf):
    c = F.col
    mark = T.fingerprint(c("l_partkey"), c("l_linestatus"), T.norm_number(c("l_extendedprice")), T.norm_number(c("l_discount")))
    return read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.natural_key(c("l_orderkey"), c("l_linenumber"), c("l_returnflag")).alias("natural_key"), mark.alias("fingerprint"))


def _merge_inputs(spark, sf):
    # Dealt once by their key: the proposals of an order, and what is stored of it, are judged and merged where it stands.
    orders = dealt(read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("t")), "k")
    existing = orders.where("t < 400000").select("k", "p", (F.col("s") == "F").alias("is_human"), (F.col("t") < 20000).alias("is_invalid"))
    turn = lambda n, holds, p: F.when(holds, F.struct(p.alias("p"), F.lit(n).alias("turn")))
    p, t = F.col("p"), F.col("t")
    first = turn(1, t > 10000, F.when(t % 2 < 1, F.concat(p, F.lit(" revised"))).otherwise(p))
    return existing, orders.select("k", F.inline(F.array(first, turn(2, t > 350000, F.concat(p, F.lit(" again"))), turn(3, t > 370000, p)))).where("turn IS NOT NULL")


_MERGE = """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, o_totalprice AS t FROM orders),
e AS (SELECT k, p, s = 'F' AS is_human, t < 20000 AS is_invalid FROM o WHERE t < 400000),
n AS (SELECT k, CASE WHEN t % 2 < 1 THEN p || ' revised' ELSE p END AS p, 1 AS turn FROM o WHERE t > 10000 UNION ALL SELECT k, p || ' again', 2 FROM o WHERE t > 350000 UNION ALL SELECT k, p, 3 FROM o WHERE t > 370000),
-- What is stored when a proposal comes: a person's row as it was; else the last proposal before, as each of those was written or was the same.
w AS (SELECT n.k, n.p, n.turn, e.k IS NULL AND NOT EXISTS (SELECT 1 FROM n x WHERE x.k = n.k AND x.turn < n.turn) AS is_new, e.is_human, e.is_invalid,
 CASE WHEN e.is_human THEN e.p ELSE coalesce((SELECT arg_max(x.p, x.turn) FROM n x WHERE x.k = n.k AND x.turn < n.turn), e.p) END AS stored FROM n LEFT JOIN e ON n.k = e.k),
d AS (SELECT k, p, turn, CASE WHEN is_new THEN 'inserted' WHEN is_invalid THEN 'invalid' WHEN trim(p) = trim(stored) THEN 'unchanged' WHEN is_human THEN 'conflict' ELSE 'updated' END AS action FROM w) """


@query(_MERGE + "SELECT k, p, turn, action FROM d")
def merge_actions(spark, sf):
    existing, proposed = _merge_inputs(spark, sf)
    return merge.sync_actions(existing, proposed, ["k"], ["p"], "turn").select("k", "p", "turn", "action")


@query(_MERGE + ", l AS (SELECT k, arg_max(p, turn) AS p FROM d WHERE action IN ('inserted', 'updated') GROUP BY k) SELECT k, p FROM l UNION ALL SELECT k, p FROM e WHERE k NOT IN (SELECT k FROM l)")
def merge_result(spark, sf):
    existing, proposed = _merge_inputs(spark, sf)
    return merge.apply_actions(existing, merge.sync_actions(existing, proposed, ["k"], ["p"], "turn"), ["k"], ["p"], "turn")


@query(_MERGE + "SELECT k, p, is_human, is_invalid, CASE WHEN is_human THEN 'held' ELSE 'eligible' END AS verdict FROM e WHERE k NOT IN (SELECT k FROM n)")
def unreproduced_split(spark, sf):
    existing, proposed = _merge_inputs(spark, sf)
    return merge.unreproduced(existing, proposed, ["k"])


@query("""WITH a AS (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal >= 0), b AS (SELECT c_custkey, CASE WHEN c_nationkey < 5 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_acctbal < 9000)
SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'lost' WHEN a.c_mktsegment = b.c_mktsegment THEN 'same' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.c_custkey = b.c_custkey""")
def snapshot_diff(spark, sf):
    c = read_table(spark, sf, "customer")
    after = c.where("c_acctbal < 9000").withColumn("c_mktsegment", F.when(F.col("c_nationkey") < 5, "MOVED").otherwise(F.col("c_mktsegment")))
    return merge.snapshot_diff(c.where("c_acctbal >= 0"), after, ["c_custkey"], ["c_mktsegment"])


_H = "WITH h AS (SELECT o_orderkey, o_custkey, o_orderpriority AS status, CAST(o_orderdate AS DATE) AS as_of, CASE WHEN o_orderstatus = 'P' THEN 'x' ELSE NULL END AS superseded_by FROM orders) "


def _history(spark, sf):
    return read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("status"), F.col("o_orderdate").cast("date").alias("as_of"), F.when(F.col("o_orderstatus") == "P", "x").alias("superseded_by"))


@query(_H + "SELECT o_custkey, o_orderkey, status, as_of FROM h WHERE superseded_by IS NULL QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY as_of DESC, o_orderkey DESC) = 1")
def current_determination(spark, sf):
    return merge.current_rows(_history(spark, sf), "o_custkey", ["as_of", "o_orderkey"]).select("o_custkey", "o_orderkey", "status", "as_of")


@query(_H + """, c AS (SELECT *, lag(status) OVER (PARTITION BY o_custkey ORDER BY as_of, o_orderkey) AS p FROM h), k AS (SELECT * FROM c WHERE p IS DISTINCT FROM status)
SELECT o_custkey, o_orderkey, status, as_of, lead(as_of) OVER (PARTITION BY o_custkey ORDER BY as_of, o_orderkey) AS superseded_at FROM k""")
def sec_status_changes(spark, sf):
    return merge.status_changes(_history(spark, sf), "o_custkey", "status", ["as_of", "o_orderkey"]).select("o_custkey", "o_orderkey", "status", "as_of", "superseded_at")


@query(_H + "SELECT o_custkey, o_orderkey, as_of FROM h QUALIFY as_of < max(as_of) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def late_rows(spark, sf):
    return merge.late_rows(_history(spark, sf), "o_custkey", "o_orderkey", "as_of").select("o_custkey", "o_orderkey", "as_of")


@query("WITH top AS (SELECT max(s_suppkey) AS t FROM supplier) SELECT c_custkey, printf('O%05d', t + row_number() OVER (ORDER BY c_custkey)) AS observation_id FROM customer, top")
def assign_surrogate_ids(spark, sf):
    known = read_table(spark, sf, "supplier").select(F.format_string("O%05d", "s_suppkey").alias("observation_id"))
    return merge.surrogate_ids(read_table(spark, sf, "customer").select("c_custkey"), known, "observation_id", "O", F.col("c_custkey"))


@query(r"""SELECT p_partkey, array_to_string(list_filter(string_split(trim(regexp_replace(upper(p_name || ' Supply Co., Inc.'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ('INC', 'CO')), ' ') AS tokens, upper(p_name) || ' SUPPLY' AS stripped FROM part""")
def name_tokens(spark, sf):
    full = F.concat("p_name", F.lit(" Supply Co., Inc."))
    return read_table(spark, sf, "part").select("p_partkey", F.array_join(T.name_tokens(full), " ").alias("tokens"), F.upper(T.strip_legal_suffix(full)).alias("stripped"))


_STATED = (("OH", "OH"), ("Chicago, IL", "IL"), ("Salt Lake City, UT", "UT"), ("Foreign Nation", ""), ("XX", ""), ("Texas", "TX"))


@query(f"SELECT place, state, count(*) AS suppliers FROM supplier JOIN (VALUES {', '.join(str((k, *v)) for k, v in enumerate(_STATED))}) t(k, place, state) ON s_suppkey % {len(_STATED)} = k GROUP BY place, state")
def state_code_parse(spark, sf):
    """Suppliers by the place that each states, and the state it is read as."""
    place = F.get(F.array(*[F.lit(p) for p, _ in _STATED]), (F.col("s_suppkey") % len(_STATED)).cast("int"))
    rows = read_table(spark, sf, "supplier").select(place.alias("place"))
    return rows.groupBy("place", T.state_code(F.col("place")).alias("state")).agg(F.count("*").alias("suppliers"))


#: Forms of a place and the state that each names.
_PLACES = {", OH": "OH", ", Michigan": "MI", ", Idaho": "ID", ", Wash.": "WA", ", Texas (US Ops)": "TX", " Columbus OH 43004": "OH", ", Ontario": "", " PR": "PR", ", West Virginia": "WV"}


@query(f"SELECT c_custkey, state FROM customer JOIN (VALUES {', '.join(str((k, v)) for k, v in enumerate(_PLACES.values()))}) t(k, state) ON c_custkey % {len(_PLACES)} = k")
def state_code_places(spark, sf):
    """Over the whole table: each customer in a place of some form."""
    form = F.get(F.array(*map(F.lit, _PLACES)), (F.col("c_custkey") % len(_PLACES)).cast("int"))
    return read_table(spark, sf, "customer").select("c_custkey", T.state_code(F.concat("c_name", form)).alias("state"))


_PAIRS = """WITH n AS (SELECT p_name AS id, list_distinct(string_split(upper(p_name), ' ')) AS t FROM (SELECT DISTINCT p_name FROM part)),
c AS (SELECT id || ' x' AS id, list_distinct(list_append(t, CASE WHEN length(id) % 2 = 0 THEN 'FREIGHT' ELSE 'ZEBRA' END)) AS t FROM n),
s AS (SELECT n.id AS query_id, c.id AS candidate_id, n.t AS q, c.t AS c, len(list_intersect(n.t, c.t)) AS shared FROM n JOIN c ON len(list_intersect(n.t, c.t)) > 0),
w AS (SELECT query_id, candidate_id, round(greatest(0.0, shared / len(q) - 0.35 * list_sum(list_transform(list_filter(c, lambda x: NOT list_contains(q, x)), lambda x: CASE WHEN x = 'FREIGHT' THEN 0.35 ELSE 1.0 END))
 / list_sum(list_transform(c, lambda x: CASE WHEN x = 'FREIGHT' THEN 0.35 ELSE 1.0 END))), 4) AS score FROM s) """


def _names(spark, sf):
    n = read_table(spark, sf, "part").select(F.col("p_name").alias("id")).distinct()
    c = n.select(F.concat("id", F.lit(" x")).alias("id"), F.concat("id", F.when(F.length("id") % 2 == 0, F.lit(" freight")).otherwise(F.lit(" zebra"))).alias("name"))
    return n.select("id", F.col("id").alias("name")), c


@query(_PAIRS + "SELECT query_id, candidate_id, score FROM w")
def token_overlap_score(spark, sf):
    return resolution.scored_pairs(*_names(spark, sf))


@query(_PAIRS + """, b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM w), g AS (SELECT query_id, max(score) AS score, count(*) FILTER (score >= 0.55 AND score >= best - CAST(0.12 AS DOUBLE)) AS ties, min(candidate_id) FILTER (score = best) AS win FROM b GROUP BY query_id),
r AS (SELECT *, CASE WHEN score < 0.55 THEN 'below_threshold' WHEN ties > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM g)
SELECT query_id, status, CASE WHEN status = 'resolved' THEN win END AS winner_id, score, ties FROM r""")
def resolve_candidates(spark, sf):
    return resolution.resolve(*_names(spark, sf))


def _customers(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    form = F.get(F.array(*[F.lit(x) for x in (" Freight Inc.", " Zebra Trucking", " LLC", " West East North")]), (F.col("id") % 4).cast("int"))
    return c, c.where("id % 7 != 3").select("id", F.concat("name", form).alias("name"))


@query("""WITH q AS (SELECT c_custkey AS id, string_split(upper(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g')), ' ') AS t FROM customer),
c AS (SELECT id, list_concat(t, CASE id % 4 WHEN 0 THEN ['FREIGHT'] WHEN 1 THEN ['ZEBRA', 'TRUCKING'] WHEN 2 THEN [] ELSE ['WEST', 'EAST', 'NORTH'] END) AS t,
      CASE id % 4 WHEN 0 THEN 0.35 WHEN 1 THEN 1.35 WHEN 2 THEN 0.0 ELSE 3.0 END AS more FROM q WHERE id % 7 <> 3),
p AS (SELECT q.id AS query_id, c.id AS candidate_id, round(greatest(0.0, len(list_intersect(q.t, c.t)) / len(q.t) - 0.35 * (len(q.t) - len(list_intersect(q.t, c.t)) + more) / (len(q.t) + more)), 4) AS score FROM q JOIN c ON len(list_intersect(q.t, c.t)) > 0),
g AS (SELECT query_id, max(score) AS score FROM p GROUP BY query_id), r AS (SELECT g.query_id, g.score, count(*) FILTER (p.score >= 0.55 AND p.score >= g.score - CAST(0.12 AS DOUBLE)) AS ties, min(candidate_id) FILTER (p.score = g.score) AS win FROM g JOIN p USING (query_id) GROUP BY g.query_id, g.score)
SELECT query_id, CASE WHEN score < 0.55 THEN 'below_threshold' WHEN ties > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN score >= 0.55 AND ties = 1 THEN win END AS winner_id, CASE WHEN score >= 0.55 THEN score END AS score, ties FROM r""")
def resolve_common_word(spark, sf):
    """All customers against registered names, though one word stands in every name: it is joined for no query."""
    return resolution.resolve(*_customers(spark, sf))


@query("""WITH q AS (SELECT c_custkey AS id, string_split(upper(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g')), ' ') AS t FROM customer), f AS (SELECT t, count(*) AS df FROM (SELECT unnest(t) AS t FROM q WHERE id % 7 <> 3) GROUP BY t),
e AS (SELECT id, unnest(t) AS t, len(t) AS n FROM q) SELECT f.t, f.df, count(*) AS joined FROM e JOIN f USING (t) JOIN (SELECT id, min(df) AS least FROM e JOIN f USING (t) GROUP BY id) m ON m.id = e.id AND f.df = m.least
WHERE e.n = 2 AND (f.df < (SELECT max(df) FROM f)) GROUP BY f.t, f.df""")
def resolution_prefixes(spark, sf):
    """The tokens by which customers look for candidates, with their frequencies: the word that all names have is not among them."""
    q, c = (resolution.token_sets(x) for x in _customers(spark, sf))
    df = c.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    return resolution.query_prefixes(q, df, resolution.FLOOR).join(df, "t").groupBy("t", "df").agg(F.count("*").alias("joined"))


@query("""SELECT p_partkey, CASE WHEN p_type LIKE 'PROMO BURNISHED%' THEN 'burnished' WHEN p_type LIKE 'PROMO%' THEN 'promo' WHEN p_type LIKE 'STANDARD%' THEN 'standard' WHEN p_type LIKE 'S%' THEN 'small' END AS mapped FROM part""")
def naics_longest_prefix(spark, sf):
    rules = [("S", "small"), ("PROMO", "promo"), ("PROMO BURNISHED", "burnished"), ("STANDARD", "standard")]
    return resolution.longest_prefix(read_table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", rules).select("p_partkey", "mapped")


@query("""WITH g AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY l_suppkey) AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS r FROM g)
SELECT l_suppkey, CASE WHEN round(n / a, 4) >= 0.35 THEN l_returnflag END AS decided, round(n / a, 4) AS share, CASE WHEN round(n / a, 4) >= 0.35 THEN 'decided' ELSE 'no_majority' END AS reason FROM t WHERE r = 1""")
def modal_industry(spark, sf):
    return resolution.modal_value(read_table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag"), "l_suppkey", "l_returnflag", share=0.35)


@query("""WITH f AS (SELECT 'order_customer' AS "check", CAST(o_custkey AS VARCHAR) AS subject FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -500)
 UNION ALL SELECT 'line_order', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
 UNION ALL SELECT 'line_repeat', concat_ws('|', l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
 UNION ALL SELECT 'status_vocabulary', s FROM (SELECT DISTINCT trim(o_orderstatus) AS s FROM orders) WHERE s NOT IN ('O', 'F'))
SELECT "check", count(*) AS findings, min(subject) AS first FROM f GROUP BY "check" """)
def integrity_findings(spark, sf):
    orders, lines, customers = (read_table(spark, sf, t) for t in ("orders", "lineitem", "customer"))
    allowed = spark.createDataFrame([("O",), ("F",)], "value string")
    return integrity.findings(
        integrity.orphans(orders, "o_custkey", customers.where("c_acctbal > -500"), "c_custkey", "order_customer"),
        integrity.orphans(lines, "l_orderkey", orders, "o_orderkey", "line_order"),
        integrity.duplicates(lines, ["l_orderkey", "l_linenumber"], "line_repeat"),
        integrity.outside_vocabulary(orders, "o_orderstatus", allowed, "status_vocabulary"),
    )


@query(_A + """, p AS (SELECT event_id, concat_ws('; ', CASE WHEN outcome IN ('partial', 'not_covered') AND detail IS NULL THEN 'needs a failure' END, CASE WHEN outcome = 'covered' AND detail IS NOT NULL THEN 'must not carry a failure' END,
 CASE WHEN outcome = 'absent_confirmed' AND scope = 'probe' THEN 'absence outside scope' END, CASE WHEN signal_status IS NULL THEN 'unknown signal' END) AS problems FROM a) SELECT event_id, problems FROM p WHERE problems <> ''""")
def constraint_findings(spark, sf):
    c = F.col
    rules = (
        (c("outcome").isin("partial", "not_covered") & c("detail").isNull(), "needs a failure"),
        ((c("outcome") == "covered") & c("detail").isNotNull(), "must not carry a failure"),
        ((c("outcome") == "absent_confirmed") & (c("scope") == "probe"), "absence outside scope"),
        (c("signal_status").isNull(), "unknown signal"),
    )
    return attempts(spark, sf).select("event_id", integrity.problems(*rules).alias("p")).where(F.size("p") > 0).select("event_id", F.array_join("p", "; ").alias("problems"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey IS NOT NULL AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def typed_scan_filter(spark, sf):
    return known_rows(read_table(spark, sf, "customer"), "c_custkey", "c_mktsegment", ("BUILDING", "MACHINERY")).select("c_custkey", "c_name", "c_mktsegment")


@query("""WITH l AS (SELECT DISTINCT 'segment' AS field, trim(c_mktsegment) AS v FROM customer UNION SELECT DISTINCT 'priority', trim(o_orderpriority) FROM orders) SELECT field, string_agg(v, ',' ORDER BY v) AS allowed FROM l WHERE v <> '' GROUP BY field""")
def vocabulary_readback(spark, sf):
    lookups = read_table(spark, sf, "customer").select(F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value")).union(read_table(spark, sf, "orders").select(F.lit("priority"), "o_orderpriority"))
    return vocabulary(lookups).select("field", F.array_join("values", ",").alias("allowed"))


@query("SELECT 'customer' AS \"table\", count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def all_table_counts(spark, sf):
    return table_counts({t: read_table(spark, sf, t) for t in ("customer", "orders", "lineitem", "events", "documents")})


@query(_A + "SELECT run_id, count(DISTINCT company_id) AS companies, count(*) AS n FROM a GROUP BY run_id")
def distinct_entities_processed(spark, sf):
    return attempts(spark, sf).groupBy("run_id").agg(F.count_distinct("company_id").alias("companies"), F.count("*").alias("n"))


@query(_A + "SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS seq FROM a")
def run_sequence_ids(spark, sf):
    return sequences.sequence_numbers(attempts(spark, sf), "run_id", "ts", "event_id").select("run_id", "event_id", "seq")


@query(_A + """, f AS (SELECT *, sum(CASE WHEN outcome = 'not_covered' THEN 0 ELSE 1 END) OVER (PARTITION BY company_id ORDER BY event_id) AS island FROM a),
s AS (SELECT *, count(*) FILTER (outcome = 'not_covered') OVER (PARTITION BY company_id, island ORDER BY event_id) AS streak FROM f) SELECT company_id, min(event_id) AS stopped_at FROM s WHERE streak = 3 AND outcome = 'not_covered' GROUP BY company_id""")
def circuit_breaker_runs(spark, sf):
    return sequences.breaker_stops(attempts(spark, sf), "company_id", "event_id", F.col("outcome") == "not_covered", 3)


@query(_A + "SELECT company_id, signal, event_id, outcome FROM a QUALIFY row_number() OVER (PARTITION BY company_id, signal ORDER BY ts, event_id) = 1")
def first_per_key(spark, sf):
    return sequences.first_per_key(attempts(spark, sf), ["company_id", "signal"], "ts", "event_id").select("company_id", "signal", "event_id", "outcome")


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) > 3 AS truncated FROM orders QUALIFY rank <= 3""")
def capped_listing(spark, sf):
    return sequences.top_per_key(read_table(spark, sf, "orders"), "o_custkey", 3, F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey", "rank", "truncated")


@query("""WITH c AS (SELECT user_id, CAST(floor(value / 12) AS BIGINT) AS path, day(ts) AS d FROM events), l AS (SELECT user_id, path, max(d) AS y FROM c GROUP BY ALL), g AS (SELECT user_id, count(*) AS paths, count(*) FILTER (y < 15) AS gone FROM l GROUP BY user_id),
m AS (SELECT user_id, y, count(*) AS n FROM l WHERE y < 15 GROUP BY user_id, y QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, y) = 1)
SELECT g.user_id, paths, gone, m.y AS modal_year, CASE WHEN gone < 8 THEN 'individual' WHEN gone / paths >= 0.7 THEN 'wholesale' WHEN m.n / gone >= 0.6 THEN 'clustered' ELSE 'individual' END AS pattern FROM g LEFT JOIN m ON g.user_id = m.user_id""")
def disappeared_paths(spark, sf):
    captures = read_table(spark, sf, "events").select("user_id", F.floor(F.col("value") / 12).alias("path"), "ts")
    return sequences.disappeared_paths(captures, "user_id", "path", F.dayofmonth("ts"), 15)
