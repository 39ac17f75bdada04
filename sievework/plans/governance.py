"""Queries over what may be written: determinations, reviews, relations, migrations, publication, identity verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..operators import governance as G
from ..sources.tables import read_table
from .articles import cases
from .standin import ctes, standin

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CUSTOMER = StructType([StructField(n, t()) for n, t in (("c_custkey", LongType), ("c_name", StringType), ("c_nationkey", IntegerType), ("c_acctbal", DoubleType), ("c_mktsegment", StringType))])


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def schema_contract(spark, sf):
    """A table read under its declared columns; one that is missing or of another type is an error."""
    return read_table(spark, sf, "customer", CUSTOMER).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


_SEC = """SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'active_reporter' WHEN 1 THEN 'never_registered' WHEN 2 THEN 'entity_unresolved' WHEN 3 THEN 'status_uncertain' WHEN 4 THEN 'other' ELSE 'ceased_reporting' END AS status, CASE WHEN c_custkey % 5 = 0 THEN '5/1/2026' ELSE '2026-05-01' END AS as_of,
 CASE WHEN c_custkey % 11 = 0 THEN ' ' WHEN c_custkey % 2 = 0 THEN '15-15D of CIK 12' ELSE 'a filing' END AS reference, CASE WHEN c_custkey % 3 = 0 THEN 'why' END AS notes, CASE WHEN c_custkey % 4 = 0 THEN '15-15D' END AS filing FROM customer"""


@query(f"""SELECT c_custkey, array_to_string(list_filter([CASE WHEN status = 'other' THEN 'unknown status' END, CASE WHEN as_of <> '2026-05-01' THEN 'as_of must be an ISO date' END, CASE WHEN reference = ' ' THEN 'reference is required' END,
 CASE WHEN status = 'entity_unresolved' AND notes IS NULL THEN 'identity doubt needs notes' END, CASE WHEN status = 'status_uncertain' AND NOT contains(reference, 'CIK') THEN 'status doubt needs the filer''s CIK' END,
 CASE WHEN status = 'status_uncertain' AND notes IS NULL THEN 'status doubt needs notes' END, CASE WHEN status = 'never_registered' AND notes IS NULL THEN 'never registered needs notes' END,
 CASE WHEN status NOT IN ('other', 'never_registered') AND filing IS NULL THEN 'filing type is required' END], lambda x: x IS NOT NULL), '; ') AS problems FROM ({_SEC})""")
def sec_status_rules(spark, sf):
    standin(spark, sf)
    return spark.sql(_SEC).select("c_custkey", F.array_join(G.sec_problems(), "; ").alias("problems"))


_REVIEWS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN 'other' ELSE 'buyer_acts' END AS role, CASE o_orderkey % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'buyer_acts' ELSE 'buyer_articulates' END AS verdict, CASE WHEN o_orderkey % 9 = 0 THEN 'model' ELSE 'human' END AS source,
 CASE WHEN o_orderkey % 10 = 0 THEN 'HR-1' ELSE 'RR-1' END AS run, CASE o_orderkey % 3 WHEN 0 THEN 'census' WHEN 1 THEN 'stratified' ELSE 'other' END AS design, 30 + o_orderkey % 2 * 10 AS sample_n, 30 + o_orderkey % 5 * 5 AS population_n, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'said' END AS words FROM orders"""


@query(f"""SELECT id, array_to_string(list_filter([CASE WHEN role = 'other' THEN 'unknown role' END, CASE WHEN verdict = role THEN 'the verdict repeats the role' END, CASE WHEN source = 'model' THEN 'a verdict is a person''s' END, CASE WHEN run = 'HR-1' THEN 'a review is no harness run' END,
 CASE WHEN design = 'other' THEN 'unknown design' END, CASE WHEN sample_n > population_n THEN 'sample exceeds population' END, CASE WHEN design = 'census' AND sample_n <> population_n THEN 'census without all rows' END,
 CASE WHEN design <> 'census' AND sample_n = population_n THEN 'all rows reviewed, yet no census' END, CASE WHEN verdict <> 'correct' AND words = '' THEN 'the reviewer''s words are missing' END], lambda x: x IS NOT NULL), '; ') AS problems FROM ({_REVIEWS})""")
def role_review_rules(spark, sf):
    standin(spark, sf)
    return spark.sql(_REVIEWS).select("id", F.array_join(G.review_problems(), "; ").alias("problems"))


_BATCHES = """SELECT concat('R', o_custkey % 40) AS run, o_orderkey % 500 AS observation_id, concat('S', o_orderkey % 3) AS stratum, CASE WHEN o_custkey % 40 = 7 AND o_orderkey % 2 = 0 THEN 'census' ELSE 'stratified' END AS design,
 CASE WHEN o_custkey % 40 < 20 THEN count(*) OVER (PARTITION BY o_custkey % 40) ELSE 30 END AS sample_n, 900 AS population_n, CASE WHEN o_custkey % 40 = 3 THEN o_orderkey % 2 ELSE count(*) OVER (PARTITION BY o_custkey % 40, o_orderkey % 3) END AS stratum_n, 300 AS stratum_population FROM orders"""


@query(f"""WITH b AS ({_BATCHES}), s AS (SELECT run, stratum, count(*) AS held, min(stratum_n) AS n, min(stratum_n) <> max(stratum_n) AS torn FROM b GROUP BY ALL),
p AS (SELECT run, bool_or(torn) AS torn, bool_or(NOT torn AND held <> n) AS short, sum(CASE WHEN NOT torn THEN n END) AS sampled, sum(CASE WHEN NOT torn THEN 300 END) AS pop FROM s GROUP BY run),
r AS (SELECT run, count(*) AS n, count(DISTINCT observation_id) AS ids, count(DISTINCT design) AS designs, count(DISTINCT sample_n) AS sizes, min(sample_n) AS sample_n FROM b GROUP BY run)
SELECT run, unnest(list_filter([CASE WHEN designs > 1 THEN 'design differs' END, CASE WHEN sizes > 1 THEN 'sample_n differs' END, CASE WHEN ids <> n THEN 'an observation twice' END, CASE WHEN n <> sample_n THEN 'rows are not sample_n' END, CASE WHEN torn THEN 'a stratum states more than one size' END,
 CASE WHEN short THEN 'a stratum holds another number of rows' END, CASE WHEN sampled IS DISTINCT FROM sample_n THEN 'strata don''t add up to the sample' END, CASE WHEN pop IS DISTINCT FROM 900 THEN 'strata don''t add up to the population' END], lambda x: x IS NOT NULL)) AS problem FROM r JOIN p USING (run)""")
def review_batches(spark, sf):
    """Runs of a review as wholes: the strata partition the sample and the population."""
    standin(spark, sf)
    return G.review_batches(spark.sql(_BATCHES))


@query("""WITH c(name, key) AS (SELECT 'line_order', CAST(l_orderkey AS STRING) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'line_part', CAST(l_partkey AS STRING) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
 UNION ALL SELECT 'line_supplier', CAST(l_suppkey AS STRING) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'order_customer', CAST(o_custkey AS STRING) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT 'customer_nation', CAST(c_nationkey AS STRING) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'nation_region', CAST(n_regionkey AS STRING) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
 UNION ALL SELECT 'event_customer', CAST(user_id AS STRING) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT 'event_supplier', CAST(user_id AS STRING) FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier))
SELECT name AS check, count(*) AS n, min(key) AS first FROM c GROUP BY name""")
def integrity_relations(spark, sf):
    """Eight relations, each with the references that have no parent."""
    standin(spark, sf)
    t = spark.table
    return G.broken_relations([
        ("line_order", t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"), ("line_part", t("lineitem"), "l_partkey", t("part"), "p_partkey"), ("line_supplier", t("lineitem"), "l_suppkey", t("supplier"), "s_suppkey"),
        ("order_customer", t("orders"), "o_custkey", t("customer"), "c_custkey"), ("customer_nation", t("customer"), "c_nationkey", t("nation"), "n_nationkey"), ("nation_region", t("nation"), "n_regionkey", t("region"), "r_regionkey"),
        ("event_customer", t("events"), "user_id", t("customer").where("c_custkey % 2 = 0"), "c_custkey"), ("event_supplier", t("events"), "user_id", t("supplier"), "s_suppkey"),
    ])


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'T-URGENT' ELSE o_orderpriority END AS topic, CASE WHEN o_orderkey % 3 = 0 THEN concat('kept ', o_orderkey) ELSE 'filled' END AS note, 'new' AS added FROM orders")
def schema_migration(spark, sf):
    """A column added, blanks filled, keys renamed; run again it changes nothing."""
    standin(spark, sf)
    rows = spark.table("orders").select("o_orderkey", F.col("o_orderpriority").alias("topic"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("kept "), "o_orderkey")).when(F.col("o_orderkey") % 3 == 1, F.lit(" ")).alias("note"), F.lit(False).alias("human"))
    step = lambda d: G.migrate(d, {"note": F.lit("filled"), "added": F.lit("new")}, {"topic": {"1-URGENT": "T-URGENT"}}, "human")
    return step(step(rows)).drop("human")


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'stale' ELSE 'base' END AS origin FROM customer")
def snapshot_rebuild(spark, sf):
    """A table from two snapshots, whose row counts are asserted first."""
    standin(spark, sf)
    rows = spark.table("customer").select("c_custkey", "c_name")
    base, stale = rows.where("c_custkey % 3 != 0"), rows.where("c_custkey % 2 = 0 OR c_custkey % 3 = 0")
    return G.rebuild(base, base.count(), stale, stale.count(), "c_custkey")


@query(ctes("runs", "observations") + """, go AS (SELECT DISTINCT harness_id, version FROM runs WHERE turn % 2 = 0 AND (harness_id, version) IN (SELECT (harness_id, version) FROM runs WHERE turn % 3 = 0))
SELECT 'run' AS kind, run_id AS id, CASE WHEN (harness_id, version) IN (SELECT (harness_id, version) FROM go) THEN 'published' ELSE publication END AS publication FROM runs
UNION ALL SELECT 'observation', observation_id, CASE WHEN (harness_id, version) IN (SELECT (harness_id, version) FROM go) THEN 'released' ELSE publication END FROM observations""")
def publish_version(spark, sf):
    """Runs and observations of a version are published together, and never without an audit."""
    runs, observations = standin(spark, sf, "runs", "observations")
    return G.publish(runs, observations, runs.where("turn % 2 = 0"), runs.where("turn % 3 = 0"))


@query("""WITH p AS (SELECT c_custkey, CAST(1 + c_custkey % 60 AS INT) AS pop, CAST(1 + c_custkey % 17 AS INT) AS n FROM customer),
k AS (SELECT c_custkey, pop, n, unnest(range(0, pop + 1)) AS k FROM p), c AS (SELECT *, list_product(list_transform(range(0, n), lambda i: greatest(0.0, (pop - k - i) / (pop - i)::DOUBLE))) AS miss FROM k WHERE n < pop)
SELECT p.c_custkey, coalesce(max(k) FILTER (miss >= 0.05), 0) AS bound FROM p LEFT JOIN c ON p.c_custkey = c.c_custkey GROUP BY p.c_custkey""")
def hypergeometric_bound(spark, sf):
    standin(spark, sf)
    pop, n = (1 + F.col("c_custkey") % 60).cast("int"), (1 + F.col("c_custkey") % 17).cast("int")
    return spark.table("customer").select("c_custkey", G.zero_found_bound(pop, n).alias("bound"))


@cases(("candidate",), ("verdict",), [
    ("{w} Freight Company", "refused: a person said so"),
    ("MA {w} CO", "match: verified form"),
    ("{w} Trucking", "refused: unverified form of one word"),
    ("The {w} Group", "match: exact form"),
    ("{w} Hydraulics", "near_miss"),
    ("Marl", "nothing_in_common"),
], (QUERIES, SQL))
def identity_forms(rows):
    """A record's name against a company of one word, with names that people have refused or verified."""
    refused, verified = F.array(F.concat("w", F.lit(" Freight"))), F.array(F.concat(F.lit("M. A. "), "w", F.lit(" Company")))
    return rows.withColumn("verdict", G.identity_verdict(F.concat("w", F.lit(" Inc.")), F.col("candidate"), refused, verified))


@cases(("text",), ("found",), [("Then Ed {w} spoke", "Ed {w}"), ("Edward T. {w} spoke", "Edward {w}"), ("Alan {w} spoke", ""), ("Bill {w} spoke", ""), ("Edward {w} spoke", "Edward {w}"), ("nobody", "")], (QUERIES, SQL))
def name_in_text(rows):
    """The form in which a text writes a person's name: the surname, and a first name of which one is the start of the other."""
    from ..functions.passages import surname

    full = F.concat(F.lit("Edward "), "w")
    pairs = F.regexp_extract_all("text", F.concat(F.lit(r"\b([A-Z][a-z]+)\.?\s+(?:[A-Z]\.?\s+)?\Q"), surname(full), F.lit(r"\E\b")), F.lit(1))
    good = F.filter(pairs, lambda c: (F.length(c) >= 2) & (F.startswith(F.lit("Edward"), c) | F.startswith(c, F.lit("Edward"))))
    return rows.withColumn("found", F.coalesce(F.concat(F.get(good, F.lit(0)), F.lit(" "), surname(full)), F.lit("")))
