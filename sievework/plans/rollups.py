"""Queries over roll-ups: access, postings, inspections, permits, people, links, robots rules, refusals and allocations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import access_classes
from ..operators import rollups as R
from .standin import ctes, standin

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_DETAILS = """SELECT event_id, concat('H', event_id % 4) AS harness_id, event_type AS category, CASE event_id % 6 WHEN 0 THEN 'robots.txt disallows; then 429' WHEN 1 THEN 'Web Page Blocked!; edge rate limiting' WHEN 2 THEN 'status 403'
 WHEN 3 THEN 'paywall' WHEN 4 THEN 'too many requests; certificate_verify_failed' ELSE '[access_class=rate_limited] robots.txt' END AS detail FROM events"""


@query(f"""SELECT harness_id, category, CASE event_id % 6 WHEN 0 THEN 'source_refusal' WHEN 1 THEN 'egress_blocked' WHEN 2 THEN 'unclassified' WHEN 3 THEN 'source_refusal' WHEN 4 THEN 'egress_blocked' ELSE 'rate_limited' END AS access_class,
 CASE WHEN event_id % 6 IN (0, 1, 4) THEN 'rate_limited' ELSE '' END AS also, count(*) AS n FROM ({_DETAILS}) GROUP BY ALL""")
def access_combinations(spark, sf):
    """Access failures by binding class, with the classes that the same text shows besides."""
    standin(spark, sf)
    return R.access_combinations(spark.sql(_DETAILS), "detail", ["harness_id", "category"])


_POSTINGS = "SELECT o_custkey AS company_id, o_orderpriority AS signal, o_orderkey AS place, concat('Role ', o_orderkey) AS title, o_totalprice > 440000 AS leadership, o_custkey % 3 = 0 AS truncated FROM orders"


@query(f"""WITH g AS (SELECT company_id, signal, count(*) AS n, bool_or(leadership) AS leadership, bool_or(truncated) AS truncated, list(title ORDER BY place) AS t FROM ({_POSTINGS}) GROUP BY ALL)
SELECT company_id, signal, n, leadership, CASE WHEN leadership THEN 'committed_action' WHEN n >= 3 THEN 'repeated_pattern' ELSE 'weak_clue' END AS strength,
 CAST(round(greatest(0.3, least(0.95, CASE WHEN n = 1 THEN 0.55 WHEN n < 3 THEN 0.70 ELSE 0.85 END + CASE WHEN leadership THEN 0.05 ELSE 0 END - CASE WHEN truncated THEN 0.05 ELSE 0 END)), 2) AS DOUBLE) AS confidence, array_to_string(t[1:4], '; ') AS titles FROM g""")
def signal_strength(spark, sf):
    standin(spark, sf)
    return R.signal_claims(spark.sql(_POSTINGS), ["company_id", "signal"])


_INSPECTIONS = """SELECT o_custkey AS company_id, CASE o_orderkey % 5 WHEN 0 THEN 'Complaint' WHEN 1 THEN 'Referral' ELSE 'Planned' END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 3 AS INT) END AS violations, CAST(o_orderdate AS DATE) AS opened FROM orders"""


@query(f"""WITH a AS (SELECT *, (2001 - year(opened)) * 12 + 6 - month(opened) AS age FROM ({_INSPECTIONS})),
g AS (SELECT company_id, count(*) AS n, count_if(age <= 36) AS recent, coalesce(sum(violations), 0)::BIGINT AS violations, count_if(violations IS NULL) AS unknown_violations, count_if(kind IN ('Complaint', 'Referral')) AS escalated, min(age) AS newest_months FROM a GROUP BY company_id)
SELECT *, CASE WHEN violations > 0 THEN 'legacy_constraint' ELSE 'unknown' END AS state, CASE WHEN violations > 0 AND n > 1 THEN 'repeated_pattern' ELSE 'weak_clue' END AS strength, CAST(CASE WHEN violations > 0 AND n > 1 THEN 0.7 WHEN violations > 0 THEN 0.55 ELSE 0.5 END AS DOUBLE) AS confidence FROM g""")
def inspection_profile(spark, sf):
    from ..functions.dates import months_before

    standin(spark, sf)
    return R.inspection_profile(spark.sql(_INSPECTIONS), "company_id", months_before(F.col("opened"), F.lit("2001-06-15").cast("date")))


_FACILITIES = "SELECT l_suppkey AS company_id, CASE l_returnflag WHEN 'A' THEN 'No Violation Identified' WHEN 'N' THEN 'Unknown' ELSE CASE WHEN l_linenumber = 1 THEN 'Violation w/in 1 Year' ELSE '' END END AS status, CASE WHEN l_quantity > 49 THEN 'Y' ELSE 'N' END AS snc, CASE WHEN l_linenumber = 7 THEN '' ELSE concat('S', l_partkey % 9) END AS state, CAST(l_quantity AS INT) AS inspections FROM lineitem"


@query(f"""WITH g AS (SELECT company_id, count(*) AS n, count_if(status LIKE 'Violation%') AS violating, count_if(snc = 'Y') AS significant, count(DISTINCT nullif(state, '')) AS states, sum(inspections)::BIGINT AS inspections FROM ({_FACILITIES}) GROUP BY company_id)
SELECT *, CASE WHEN significant > 0 OR violating > 1 THEN 'repeated_pattern' ELSE 'weak_clue' END AS strength FROM g""")
def facility_profile(spark, sf):
    standin(spark, sf)
    return R.facility_profile(spark.sql(_FACILITIES), "company_id")


_PERMITS = """SELECT o_orderkey AS permit, CAST(o_orderdate AS DATE) AS day, concat('N', o_custkey % 50) AS name_1, CASE o_orderkey % 3 WHEN 0 THEN 'Contractor-General' WHEN 1 THEN 'Owner' ELSE NULL END AS type_1,
 concat('N', o_orderkey % 50) AS name_2, CASE WHEN o_orderkey % 2 = 0 THEN 'OWNER AS GENERAL CONTRACTOR' ELSE 'TENANT' END AS type_2 FROM orders"""
_ACCEPTED = "SELECT DISTINCT c_custkey % 30 AS company_id, concat('N', c_custkey % 30) AS name FROM customer"


@query(f"""WITH u AS (SELECT permit, day, name_1 AS name, upper(coalesce(type_1, '')) AS type FROM ({_PERMITS}) UNION ALL SELECT permit, day, name_2, upper(type_2) FROM ({_PERMITS})),
r AS (SELECT company_id, permit, day, max(CASE WHEN contains(type, 'CONTRACTOR') THEN 2 WHEN contains(type, 'OWNER') THEN 1 ELSE 0 END) AS role FROM u JOIN ({_ACCEPTED}) USING (name) GROUP BY ALL)
SELECT company_id, count_if(role = 2) AS contractor_permits, count_if(role = 1) AS owner_permits, max(day) FILTER (role = 2) AS latest FROM r GROUP BY company_id""")
def permit_role_precedence(spark, sf):
    """Permits by the role of a company: contractor before owner where a permit names it twice."""
    standin(spark, sf)
    return R.permit_roles(spark.sql(_PERMITS), ["name_1", "name_2"], ["type_1", "type_2"], spark.sql(_ACCEPTED))


_PEOPLE = """SELECT o_custkey AS company_id, concat('P', o_orderkey) AS name, CASE o_orderkey % 5 WHEN 0 THEN 'unconfirmed' WHEN 1 THEN 'secondary' ELSE 'primary' END AS relevance, CASE o_orderpriority WHEN '1-URGENT' THEN 'coo' WHEN '2-HIGH' THEN 'president' WHEN '5-LOW' THEN 'ceo' ELSE 'other' END AS title,
 CASE o_orderstatus WHEN 'F' THEN 'superseded' WHEN 'O' THEN 'active' END AS status FROM orders"""


@query(f"""WITH r AS (SELECT *, relevance = 'unconfirmed' AS low_grade, row_number() OVER (PARTITION BY company_id, relevance = 'unconfirmed' ORDER BY CASE title WHEN 'ceo' THEN 0 WHEN 'coo' THEN 1 WHEN 'president' THEN 4 ELSE 99 END, name) AS rank
 FROM ({_PEOPLE}) WHERE relevance <> 'secondary' AND coalesce(status, 'active') = 'active') SELECT company_id, name, low_grade, rank FROM r WHERE rank <= CASE WHEN low_grade THEN 4 ELSE 2 END""")
def top_people(spark, sf):
    standin(spark, sf)
    return R.people_to_search(spark.sql(_PEOPLE), "company_id").select("company_id", "name", "low_grade", "rank")


_LINKS = """SELECT c_custkey AS page, 'x.com' AS host, concat('http', CASE WHEN n % 2 = 0 THEN 's' ELSE '' END, '://', CASE WHEN n = 9 THEN 'www.linkedin.com/team' WHEN n = 8 THEN 'x.com/jobs/leadership' WHEN n = 7 THEN 'x.com/who-we-are/history' WHEN n = 6 THEN 'www.x.com/team.pdf' WHEN n = 5 THEN 'x.com/about/'
 WHEN n = 4 THEN 'x.com/team#top' WHEN n = 3 THEN 'www.x.com/leadership' ELSE concat('x.com/p', c_custkey % 7) END) AS url, CASE WHEN n = 2 THEN 'Executive team' ELSE 'go' END AS text FROM customer CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9)) v(n)"""


@query("""SELECT c_custkey AS page, u.url, u.score, u.rank FROM (SELECT *, concat('https://x.com/p', c_custkey % 7) AS p FROM customer), LATERAL (VALUES (p, 10, 1), ('https://www.x.com/leadership', 10, 2), ('https://x.com/team', 6, 3), ('https://x.com/about', 3, 4), ('https://x.com/who-we-are/history', 2, 5)) u(url, score, rank)""")
def ranked_links(spark, sf):
    """Own pages that may name leaders, the best first."""
    standin(spark, sf)
    # Customers are dealt over several tasks a core before they have links, as one small file may hold them all and what is asked of links would be asked there.
    spark.table("customer").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey").createOrReplaceTempView("customer")
    return R.leadership_links(spark.sql(_LINKS), "page").select("page", "url", "score", "rank")


_ROBOTS = "User-agent: Other\nDisallow: /all\n\nUser-agent: MyBot # us\nUser-Agent: second\nDisallow: /de\nAllow: /de/ok\nCrawl-delay: 2\nUser-agent: *\nDisallow: /fr/1\nDisallow: /*/3*ref=\nDisallow:\nDisallow: /en/25$\n"


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]+(/.*)$', 1) AS path FROM pages), r AS (SELECT * FROM (VALUES ('/de', '^/de'), ('/fr/1', '^/fr/1'), ('/*/3*ref=', '^/.*/3.*ref='), ('/en/25$', '^/en/25$')) v(rule, rx)),
m AS (SELECT page_id, rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS n FROM p JOIN r ON regexp_matches(path, rx)) SELECT p.page_id, coalesce(rule, '') AS rule FROM p LEFT JOIN m ON p.page_id = m.page_id AND n = 1""")
def robots_wildcards(spark, sf):
    """The rules of a robots.txt for us and for all, and the longest that each path meets."""
    standin(spark, sf)
    path = F.regexp_extract("url", "://[^/]+(/.*)$", 1)
    return spark.table("pages").select("page_id", R.blocking_rule(R.disallowed(F.lit(_ROBOTS), ("mybot",)), path).alias("rule"))


@query("""WITH p AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'workday' END AS system, page_id % 6 AS inline, length(html) % 6000 AS chars, page_id % 2 = 0 AS framework, page_id % 7 = 1 AS off FROM pages)
SELECT CASE WHEN system IS NOT NULL THEN 'ats:workday' WHEN inline >= 3 THEN 'inline_static_list' WHEN chars < 2500 AND framework THEN 'js_rendered_shell_framework' WHEN chars < 2500 THEN 'js_rendered_shell' WHEN off THEN 'apply_link_offsite' ELSE 'static_page_no_list' END AS bucket, count(*) AS n FROM p GROUP BY bucket""")
def page_buckets(spark, sf):
    """Careers pages in exactly one bucket each."""
    standin(spark, sf)
    key = F.col("page_id")
    hosts = F.when(key % 7 == 1, F.array(F.lit("apply.example.com"))).otherwise(F.array().cast("array<string>"))
    bucket = R.page_bucket(F.when(key % 5 == 0, "workday"), key % 6, F.length("html") % 6000, key % 2 == 0, hosts)
    return spark.table("pages").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


_REFUSED = "SELECT url, CASE page_id % 5 WHEN 0 THEN 'stale: 4000 days old' WHEN 1 THEN 'http : 404' WHEN 2 THEN 'not_about_company: x: y' WHEN 3 THEN '' END AS rejected FROM pages"


@query(f"""WITH r AS (SELECT trim(split_part(rejected, ':', 1)) AS reason, regexp_replace(regexp_extract(lower(url), '://([^/:?#]+)', 1), '^www[.]', '') AS host FROM ({_REFUSED}) WHERE coalesce(rejected, '') <> '')
SELECT reason, count(*) AS n, count(DISTINCT host) AS hosts, reason IN ('stale', 'not_about_company') AS evidentiary FROM r GROUP BY reason""")
def refusal_report(spark, sf):
    """Why pages were refused: on their evidence, or because they were never read."""
    standin(spark, sf)
    return R.refusals(spark.sql(_REFUSED), ("stale", "not_about_company"))


_VARIANTS = "SELECT c_custkey AS company_id, n, concat('v', n) AS variant, CASE WHEN (c_custkey + n) % 4 = 0 THEN n * 2 ELSE 0 END AS hits, c_custkey % 9 = 0 AND n = 2 AS failed FROM customer CROSS JOIN (VALUES (1), (2), (3)) v(n)"


@query(f"""WITH g AS (SELECT company_id, min(n) FILTER (hits > 0) AS won, count(*) AS tried, bool_or(failed) AS failed FROM ({_VARIANTS}) GROUP BY company_id)
SELECT company_id, 'v' || won AS variant, CAST(won * 2 AS INT) AS hits, tried, CASE WHEN won IS NOT NULL THEN 'covered' WHEN failed THEN 'not_covered' ELSE 'absent_confirmed' END AS outcome FROM g""")
def first_nonempty_variant(spark, sf):
    """The first variant that finds anything; absence only when every one came back empty."""
    standin(spark, sf)
    return R.first_variant(spark.sql(_VARIANTS), "company_id", "n")


@query("""WITH g AS (SELECT CASE WHEN o_totalprice > 470000 THEN 'rare' ELSE o_orderpriority END AS key, count(*) AS n FROM orders GROUP BY key), a AS (SELECT *, n * 40.0 / sum(n) OVER () AS q FROM g), low AS (SELECT key, least(n, 6) AS give FROM a WHERE floor(q) + 1 < least(n, 6)),
r AS (SELECT key, n, (40 - (SELECT coalesce(sum(give), 0) FROM low)) AS room, sum(n) OVER () AS whole FROM g WHERE key NOT IN (SELECT key FROM low)),
f AS (SELECT *, n * room // whole AS f, (n * room) % whole AS rest FROM r), d AS (SELECT key, n, f + CASE WHEN row_number() OVER (ORDER BY rest DESC, key) <= max(room) OVER () - sum(f) OVER () THEN 1 ELSE 0 END AS allotted FROM f)
SELECT key, n, CAST(allotted AS BIGINT) AS allotted FROM d UNION ALL SELECT g.key, g.n, CAST(give AS BIGINT) FROM low JOIN g USING (key)""")
def allocation_with_floor(spark, sf):
    standin(spark, sf)
    sizes = spark.table("orders").groupBy(F.when(F.col("o_totalprice") > 470000, "rare").otherwise(F.col("o_orderpriority")).alias("key")).agg(F.count("*").alias("n"))
    return R.allocate_with_floor(sizes, 40, 6)


@query(r"""SELECT c_custkey, concat('a?b', chr(10), 'c?', c_custkey) AS text FROM customer""")
def control_characters(spark, sf):
    """What a cell may not hold is replaced before it is appended; line ends stay."""
    standin(spark, sf)
    return spark.table("customer").select("c_custkey", R.clean_text(F.concat(F.lit("a\x00b\nc\x1f"), F.col("c_custkey").cast("string"))).alias("text"))


@query("""WITH g AS (SELECT l_suppkey, count(*) AS n, count_if(l_returnflag = 'R') AS r FROM lineitem WHERE l_linenumber <> 1 GROUP BY l_suppkey) SELECT l_suppkey, n, CASE WHEN n >= 20 THEN round(r / n - CAST(0.21 AS DOUBLE), 4) END AS delta FROM g""")
def relative_rates(spark, sf):
    """A rate against the national one, stated only from twenty cases on."""
    standin(spark, sf)
    g = spark.table("lineitem").where("l_linenumber != 1").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return g.select("l_suppkey", "n", R.relative_risk(F.col("r"), F.col("n"), F.lit(0.21)).alias("delta"))


@query(ctes("observations") + """, r AS (SELECT *, row_number() OVER (PARTITION BY company_id, topic ORDER BY published_on DESC, grade, observation_id) AS n FROM observations WHERE publication = 'released')
SELECT company_id, topic, observation_id, published_on, grade FROM r WHERE n = 1""")
def latest_evidence_per_cell(spark, sf):
    (rows,) = standin(spark, sf, "observations")
    best = F.min_by(F.struct("observation_id", "published_on", "grade"), F.struct(-F.unix_date("published_on"), "grade", "observation_id"))
    return rows.where("publication = 'released'").groupBy("company_id", "topic").agg(best.alias("o")).select("company_id", "topic", "o.*")


@query(ctes("observations") + "SELECT observation_id, published_on BETWEEN DATE '1996-02-28' AND DATE '2001-02-28' AS in_window FROM observations")
def five_year_window(spark, sf):
    from ..functions.dates import in_five_years

    (rows,) = standin(spark, sf, "observations")
    return rows.select("observation_id", in_five_years(F.col("published_on"), F.lit("2001-02-28").cast("date")).alias("in_window"))


@query("""WITH s AS (SELECT *, CASE WHEN starts_with(url, 'https://') THEN 0 ELSE 1 END AS p, regexp_replace(regexp_extract(lower(url), '://([^/:?#]+)', 1), '^www[.]', '') AS host FROM pages)
SELECT host, page_id, n - 1 AS suppressed FROM (SELECT *, count(*) OVER (PARTITION BY host) AS n, row_number() OVER (PARTITION BY host ORDER BY p, url, page_id) AS r FROM s) WHERE r = 1""")
def priority_pick(spark, sf):
    """Of copies the one of the best kind of source, then by address, with the number of those it stands for."""
    from ..functions.text import host

    standin(spark, sf)
    kind = F.when(F.startswith("url", F.lit("https://")), 0).otherwise(1)
    g = spark.table("pages").groupBy(host(F.col("url")).alias("host")).agg(F.min(F.struct(kind.alias("p"), "url", "page_id")).alias("best"), (F.count("*") - 1).alias("suppressed"))
    return g.select("host", F.col("best.page_id").alias("page_id"), "suppressed")


@query("""WITH a AS (SELECT event_id % 7 AS theme, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS hit, event_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY event_id) AS n, sum(hit) OVER (PARTITION BY theme ORDER BY event_id) AS found FROM a)
SELECT theme, min(n) FILTER (found >= 5) AS stopped_after, count(*) AS planned FROM r GROUP BY theme""")
def stop_rule(spark, sf):
    """The place in each series where enough has been found; what follows need not be tried."""
    from pyspark.sql import Window

    standin(spark, sf)
    w = Window.partitionBy("theme").orderBy("event_id")
    rows = spark.table("events").select((F.col("event_id") % 7).alias("theme"), "event_id", (F.col("event_type") == "purchase").cast("int").alias("hit"))
    rows = rows.withColumns({"n": F.row_number().over(w), "found": F.sum("hit").over(w)})
    return rows.groupBy("theme").agg(F.min(F.when(F.col("found") >= 5, F.col("n"))).alias("stopped_after"), F.count("*").alias("planned"))


@query(f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'source_refusal,rate_limited' WHEN 1 THEN 'egress_blocked,rate_limited' WHEN 2 THEN '' WHEN 3 THEN 'source_refusal' WHEN 4 THEN 'egress_blocked,rate_limited' ELSE 'rate_limited' END AS classes FROM ({_DETAILS})")
def strategy_dispatch(spark, sf):
    """A classifier picked by name, as a function that gives a column; a name that isn't there is an error."""
    standin(spark, sf)
    return spark.sql(_DETAILS).select("event_id", F.array_join(CLASSIFIERS["access"](F.col("detail")), ",").alias("classes"))


#: Classifiers by name.
CLASSIFIERS = {"access": access_classes}


@query("SELECT n_name, printf('%,d', CAST(n_nationkey * 12345 AS BIGINT)) AS money, concat(n_nationkey, CASE WHEN n_nationkey = 1 THEN ' case' ELSE ' cases' END) AS counted, concat('sha256:', sha256(concat(n_name, chr(31), n_regionkey))) AS definition FROM nation")
def text_builders(spark, sf):
    """Numbers with separators, plurals, and the hash of a definition."""
    standin(spark, sf)
    n = F.col("n_nationkey")
    return spark.table("nation").select(
        "n_name", F.format_number(n * 12345, 0).alias("money"), F.concat(n, F.when(n == 1, " case").otherwise(" cases")).alias("counted"), F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\x1f", "n_name", "n_regionkey"), 256)).alias("definition")
    )
