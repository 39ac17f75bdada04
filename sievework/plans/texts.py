"""Queries over documents, pages, time and the audit gate."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import text as T
from ..functions.scores import rate
from ..functions.themes import PROSE_THEMES, THEMES, classify
from ..operators import audit, coverage, merge, sequences, temporal
from ..operators.matching import nearest_pairs
from ..sources.tables import archived, read_feed, read_table
from .evidence import _A, attempts

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _rx(p: str) -> str:
    return f"regexp_matches(t, '(?i){p}')"


def _theme_sql(t) -> str:
    """SQL over column `text`: specific hits, generic hits and admission of one theme."""
    text = "text"
    for p in t.exclusions:
        text = f"regexp_replace({text}, '(?i){p}', ' ', 'g')"
    count = lambda ps: " + ".join(f"CAST({_rx(p)} AS INT)" for p in ps) or "0"
    return f"SELECT doc_id, '{t.key}' AS theme, {count(t.specific)} AS s, {count(t.generic)} AS g, {'true' if t.generic_admits else 'false'} AS any FROM (SELECT doc_id, {text} AS t FROM documents)"


_T = "WITH c AS (" + " UNION ALL ".join(map(_theme_sql, PROSE_THEMES)) + "), h AS (SELECT doc_id, theme, s > 0 OR (\"any\" AND g >= 2) AS admitted, s + g AS n_hits FROM c WHERE s + g > 0) "


def _classified(spark, sf, themes=PROSE_THEMES):
    found = read_table(spark, sf, "documents").select("doc_id", "source", "lang", F.explode(classify(F.col("text"), themes)).alias("t"))
    return found.select("doc_id", "source", "lang", "t.theme", "t.admitted", F.size("t.hits").cast("long").alias("n_hits"))


@query(_T + "SELECT doc_id, theme, n_hits FROM h WHERE admitted")
def theme_classify(spark, sf):
    return _classified(spark, sf).where("admitted").select("doc_id", "theme", "n_hits")


@query(_T + """SELECT theme, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM h JOIN documents d ON h.doc_id = d.doc_id WHERE admitted GROUP BY theme""")
def theme_matrix(spark, sf):
    langs = ["en", "de", "fr", "es"]
    return _classified(spark, sf).where("admitted").groupBy("theme").pivot("lang", langs).count().na.fill(0, langs)


_R2 = " + ".join(f"CAST({_rx(p)} AS INT)" for p in PROSE_THEMES[1].generic[1:])


@query(_T + f""", b AS (SELECT doc_id, 'stems_der' AS theme, {_rx(PROSE_THEMES[1].specific[0])} OR {_rx(PROSE_THEMES[1].generic[1])} AS now FROM (SELECT doc_id, text AS t FROM documents))
SELECT b.doc_id, coalesce(h.admitted, false) AS before, b.now AS after FROM b LEFT JOIN h ON b.doc_id = h.doc_id AND h.theme = b.theme WHERE coalesce(h.admitted, false) <> b.now""")
def routing_regression(spark, sf):
    """Documents that a changed rule routes elsewhere: one generic term is made specific."""
    old, new = PROSE_THEMES[1], PROSE_THEMES[1]
    new = type(old)(old.key, old.theme_id, old.since, old.specific + old.generic[1:])
    docs = read_table(spark, sf, "documents").select("doc_id", classify(F.col("text"), (old,)).alias("a"), classify(F.col("text"), (new,)).alias("b"))
    is_in = lambda c: F.exists(c, lambda t: t.admitted)
    return docs.select("doc_id", is_in("a").alias("before"), is_in("b").alias("after")).where("before != after")


@query("""WITH k AS (SELECT *, count(*) OVER (PARTITION BY md5(text)) - 1 AS suppressed, row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS r FROM documents) SELECT doc_id, source, suppressed FROM k WHERE r = 1""")
def syndication_collapse(spark, sf):
    return sequences.collapse_copies(read_table(spark, sf, "documents").select("doc_id", "source", F.md5("text").alias("k")), ["k"], F.col("source"), "doc_id").select("doc_id", "source", "suppressed")


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split_regex(text, '[.!?;]')) AS s FROM documents) SELECT doc_id, count(*) AS sentences, count(*) FILTER (regexp_matches(s, '(^|\s)the(\s|$)') AND regexp_matches(s, '(^|\s)of(\s|$)')) AS both FROM s GROUP BY doc_id""")
def process_cause_sentence(spark, sf):
    """Two cues count only inside one sentence."""
    rows = read_table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "[.!?;]")).alias("s"))
    both = F.col("s").rlike(r"(^|\s)the(\s|$)") & F.col("s").rlike(r"(^|\s)of(\s|$)")
    return rows.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.count_if(both).alias("both"))


@query("SELECT regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)), '^www\\.', '') AS host, count(*) AS pages FROM pages GROUP BY host".replace("\\\\", "\\"))
def host_pages(spark, sf):
    return read_table(spark, sf, "pages").groupBy(T.host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


@query("""WITH h AS (SELECT page_id, string_split(regexp_extract(url, '://([^/:?#]+)', 1), '.') AS p FROM pages) SELECT page_id, CASE WHEN len(p) >= 2 THEN p[-2] || '.' || p[-1] ELSE p[1] END AS registrable FROM h""")
def host_registrable(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", T.registrable(T.host(F.col("url"))).alias("registrable"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def page_title(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", T.page_title(F.col("html")).alias("title"))


@query(r"SELECT page_id, regexp_replace(substring(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 40), '^_+|_+$', '', 'g') AS slug FROM pages")
def slug_keys(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", T.slug(F.col("url"), 40).alias("slug"))


@query("""WITH p AS (SELECT page_id, url, DATE '2024-01-01' + CAST(length(html) % 60 AS INT) AS day FROM pages), h AS (SELECT regexp_replace(regexp_extract(url, '://([^/:?#]+)', 1), '^www[.]', '') AS host, page_id, day FROM p WHERE day <= DATE '2024-02-10')
SELECT host, page_id, day FROM h QUALIFY day = max(day) OVER (PARTITION BY host)""")
def archive_latest_partition(spark, sf):
    pages = read_table(spark, sf, "pages").select(T.host(F.col("url")).alias("host"), "page_id", F.expr("date_add(DATE'2024-01-01', length(html) % 60)").alias("day"))
    return archived(pages, "host", "day", datetime.date(2024, 2, 10)).select("host", "page_id", "day")


@query("SELECT CAST(json_extract(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY k")
def json_feed_union(spark, sf):
    return read_feed(spark, read_table(spark, sf, "events").select("props"), "props", "k int").groupBy("k").agg(F.count("*").alias("n"))


_ROBOTS = (("/de", True), ("/fr/1", True), ("/fr/15", False), ("/en/2", True))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]+(/.*)$', 1) AS path FROM pages), r AS (SELECT * FROM (VALUES ('/de', true), ('/fr/1', true), ('/fr/15', false), ('/en/2', true)) v(rule, blocks)),
m AS (SELECT page_id, blocks, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, blocks) AS n FROM p JOIN r ON starts_with(path, rule)) SELECT p.page_id, coalesce(m.blocks, false) AS blocked FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1""")
def robots_longest_rule(spark, sf):
    """The longest rule that a path starts with decides; of equally long ones the one that allows."""
    path = F.regexp_extract("url", "://[^/]+(/.*)$", 1)
    rules = sorted(_ROBOTS, key=lambda r: (-len(r[0]), r[1]))
    return read_table(spark, sf, "pages").select("page_id", F.coalesce(*[F.when(path.startswith(p), F.lit(b)) for p, b in rules], F.lit(False)).alias("blocked"))


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS d FROM events), r AS (SELECT min(d) AS a, max(d) AS b FROM e), w AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('week', a) AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS s FROM r)
SELECT strftime(s, '%G-W%V') AS bucket_id, s AS bucket_start, s + 6 AS bucket_end, (SELECT count(*) FROM e WHERE e.d BETWEEN w.s AND w.s + 6) AS events FROM w""")
def week_buckets(spark, sf):
    """Every week between the first event and the last, whether or not it has events."""
    days = read_table(spark, sf, "events").select(F.to_date("ts").alias("day"))
    return temporal.weeks_between(days, "day").withColumnRenamed("n", "events")


_INSTRUMENTS = [("covered", "stems_the", "IC4", False, "archival", 12, "2024-01-01"), ("absent_confirmed", "stems_der", "IC4", False, "bounded", 1, "2024-01-01"), ("partial", "stems_der", "IC3", True, "current_only", 0, "2024-01-08"), ("absent_confirmed", "stems_que", "IC3", False, "current_only", 0, "2024-01-01")]
_HISTORY = """WITH co AS (SELECT DISTINCT user_id AS company_id FROM events), th AS (SELECT * FROM (VALUES ('stems_the', DATE '2024-01-01'), ('stems_der', DATE '2024-01-08'), ('stems_que', DATE '2024-01-15')) t(theme, since)),
bu AS (SELECT strftime(d, '%G-W%V') AS bucket_id, CAST(d AS DATE) AS bs, CAST(d + INTERVAL 6 DAY AS DATE) AS be FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 7 DAY) g(d)),
i AS (SELECT * FROM (VALUES ('covered', 'stems_the', 'IC4', false, 'archival', 12, DATE '2024-01-01'), ('absent_confirmed', 'stems_der', 'IC4', false, 'bounded', 1, DATE '2024-01-01'), ('partial', 'stems_der', 'IC3', true, 'current_only', 0, DATE '2024-01-08'), ('absent_confirmed', 'stems_que', 'IC3', false, 'current_only', 0, DATE '2024-01-01')) t(signal, theme, cls, po, reach, months, eff)),
a AS (SELECT company_id, outcome AS signal, outcome, CAST(ts AS DATE) AS seen FROM tries WHERE outcome <> 'not_covered'),
r AS (SELECT a.company_id, i.theme, bu.bucket_id, max(i.cls) FILTER (a.outcome = 'absent_confirmed' AND NOT i.po) AS lic FROM a JOIN i ON a.signal = i.signal JOIN bu ON bu.bs <= a.seen AND i.eff <= a.seen AND CASE i.reach WHEN 'archival' THEN true WHEN 'current_only' THEN a.seen <= bu.be ELSE a.seen - bu.be <= floor(i.months * 30.44) END GROUP BY ALL),
o AS (SELECT event_id, user_id AS company_id, 'stems_the' AS theme, CASE WHEN event_id % 5 <> 0 THEN CAST(ts AS DATE) END AS pub, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) ELSE DATE '2024-01-30' END AS seen,
 CASE event_id % 4 WHEN 1 THEN 'bounded' WHEN 2 THEN 'current_only' ELSE 'archival' END AS reach, CASE WHEN value > 100 THEN 'active' ELSE 'planned' END AS state,
 CASE WHEN value > 200 THEN 'A' ELSE NULL END AS grade, value AS conf FROM events WHERE event_type = 'purchase' AND value > 30),
f AS (SELECT company_id, theme, bucket_id, count(*) AS n, arg_max(state, (conf, coalesce(pub, seen), event_id)) AS state, max(coalesce(grade, 'C')) AS grade FROM o JOIN bu
 ON coalesce(o.pub, o.seen) <= bu.be AND bu.be - coalesce(o.pub, o.seen) <= 1825 AND bu.bs <= o.seen AND DATE '2024-01-05' <= o.seen
 AND CASE o.reach WHEN 'archival' THEN true WHEN 'current_only' THEN o.seen <= bu.be ELSE o.seen - bu.be <= 30 END GROUP BY ALL),
s AS (SELECT co.company_id, th.theme, bu.bucket_id, CASE WHEN bu.be < th.since THEN 'theme_not_detectable' WHEN f.n > 0 THEN 'observed' WHEN r.company_id IS NULL THEN 'no_reach' WHEN r.lic IS NOT NULL THEN 'absence_licensed_' || r.lic ELSE 'no_absence_license' END AS reason, f.state AS st, f.n, f.grade AS gr
 FROM co CROSS JOIN th CROSS JOIN bu LEFT JOIN r ON r.company_id = co.company_id AND r.theme = th.theme AND r.bucket_id = bu.bucket_id LEFT JOIN f ON f.company_id = co.company_id AND f.theme = th.theme AND f.bucket_id = bu.bucket_id),
h AS (SELECT company_id, theme, bucket_id, CASE WHEN reason = 'observed' THEN 'observed' WHEN starts_with(reason, 'absence') THEN 'absent' ELSE 'null' END AS status, reason, CASE WHEN reason = 'observed' THEN st END AS state, coalesce(CASE WHEN reason = 'observed' THEN n END, 0) AS evidence_count, CASE WHEN reason = 'observed' THEN gr END AS lowest_grade FROM s) """
_HISTORY = _A.replace("WITH a AS", "WITH tries AS").rstrip() + ", " + _HISTORY.removeprefix("WITH ")


def _history(spark, sf):
    events = read_table(spark, sf, "events")
    themes = spark.createDataFrame([("stems_the", "2024-01-01"), ("stems_der", "2024-01-08"), ("stems_que", "2024-01-15")], "theme string, since string").withColumn("since", F.to_date("since"))
    instruments = spark.createDataFrame(_INSTRUMENTS, "signal string, theme string, instrument_class string, presence_only boolean, reach string, months int, effective string").withColumn("effective", F.to_date("effective"))
    tried = attempts(spark, sf).where("outcome != 'not_covered'").select("company_id", F.col("outcome").alias("signal"), "outcome", F.to_date("ts").alias("seen"))
    found = events.where("event_type = 'purchase' AND value > 30").select(
        F.col("event_id").alias("observation_id"), F.col("user_id").alias("company_id"), F.lit("stems_the").alias("theme"),
        F.when(F.col("event_id") % 5 != 0, F.to_date("ts")).alias("published"), F.when(F.col("event_id") % 3 == 0, F.to_date("ts")).otherwise(F.lit("2024-01-30").cast("date")).alias("seen"),
        F.when(F.col("event_id") % 4 == 1, "bounded").when(F.col("event_id") % 4 == 2, "current_only").otherwise("archival").alias("reach"), F.lit(1).alias("months"), F.lit("2024-01-05").cast("date").alias("effective"),
        F.when(F.col("value") > 100, "active").otherwise("planned").alias("state"), F.when(F.col("value") > 200, "A").alias("grade"), F.col("value").alias("confidence"), F.lit(True).alias("valid"),
    )
    return temporal.state_history(events.select(F.col("user_id").alias("company_id")).distinct(), themes, temporal.week_buckets(spark, "2024-01-01", "2024-01-30"), tried, found, instruments)


@query(_HISTORY + "SELECT * FROM h")
def temporal_state_history(spark, sf):
    return _history(spark, sf)


@query(_HISTORY + "SELECT coalesce(theme, '*') AS theme, coalesce(bucket_id, '*') AS bucket_id, reason, count(*) AS cells, sum(evidence_count)::BIGINT AS evidence FROM h GROUP BY GROUPING SETS ((reason), (theme, reason), (bucket_id, reason))")
def state_history_summary(spark, sf):
    _history(spark, sf).createOrReplaceTempView("state_history")
    return spark.sql("SELECT coalesce(theme, '*') AS theme, coalesce(bucket_id, '*') AS bucket_id, reason, count(*) AS cells, sum(evidence_count) AS evidence FROM state_history GROUP BY GROUPING SETS ((reason), (theme, reason), (bucket_id, reason))")


@query(_HISTORY + ", g AS (SELECT * REPLACE (CASE WHEN evidence_count = 1 THEN 'no_reach' ELSE reason END AS reason) FROM h) SELECT h.company_id, h.theme, h.bucket_id, CASE WHEN h.reason = g.reason THEN 'same' ELSE 'changed' END AS change FROM h JOIN g USING (company_id, theme, bucket_id)")
def state_history_diff(spark, sf):
    h = _history(spark, sf)
    g = h.withColumn("reason", F.when(F.col("evidence_count") == 1, "no_reach").otherwise(F.col("reason")))
    return merge.snapshot_diff(h, g, ["company_id", "theme", "bucket_id"], ["reason"])


@query("SELECT doc_id, source FROM documents ORDER BY md5('20260831:' || doc_id), doc_id LIMIT 30")
def hash_control_sample(spark, sf):
    return audit.hash_sample(read_table(spark, sf, "documents").select("doc_id", "source"), "doc_id")


@query("""SELECT s.stratum, s.n FROM (SELECT count(*) FILTER (length(text) < 200) AS a, count(*) FILTER (source = 'src0') AS b, count(*) FILTER (lang = 'xx') AS c FROM documents) x, LATERAL (VALUES ('short', x.a), ('hot_source', x.b), ('unknown_language', x.c)) s(stratum, n)""")
def audit_strata_counts(spark, sf):
    c = F.col
    return audit.strata_counts(read_table(spark, sf, "documents"), {"short": F.length("text") < 200, "hot_source": c("source") == "src0", "unknown_language": c("lang") == "xx"})


_GATE = """WITH v AS (SELECT d.source, CASE WHEN l.toxic = 1 AND l.quality = 0 THEN 'wrong_entity' WHEN l.quality = 0 THEN 'excluded' WHEN l.toxic = 1 THEN 'partial' ELSE 'supported' END AS verdict FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT source, count(*) AS n, round(count(*) FILTER (verdict = 'supported') / count(*), 4) AS precision, round(count(*) FILTER (verdict = 'excluded') / count(*), 4) AS exclusion, CASE WHEN count(*) < 20 THEN 0.15::DOUBLE ELSE 0.10::DOUBLE END AS threshold,
CASE WHEN count(*) FILTER (verdict = 'wrong_entity') > 0 OR round(count(*) FILTER (verdict = 'excluded') / count(*), 4) > CASE WHEN count(*) < 20 THEN 0.15 ELSE 0.10 END THEN 'fail' ELSE 'pass' END AS verdict FROM v GROUP BY source"""


@query(_GATE)
def precision_exclusion(spark, sf):
    c = F.col
    kind = F.when((c("toxic") == 1) & (c("quality") == 0), "wrong_entity").when(c("quality") == 0, "excluded").when(c("toxic") == 1, "partial").otherwise("supported")
    judged = read_table(spark, sf, "documents").select("doc_id", "source").join(read_table(spark, sf, "labels"), "doc_id").select("source", kind.alias("verdict"))
    return audit.gate(judged, "source")


@query("""WITH g AS (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY p), q AS (SELECT *, n * 100 / sum(n) OVER () AS q FROM g), f AS (SELECT *, floor(q) AS f, 100 - sum(floor(q)) OVER () AS rest FROM q)
SELECT p AS priority, n, CAST(least(n, f + CASE WHEN row_number() OVER (ORDER BY round(q - f, 9) DESC, p) <= rest THEN 1 ELSE 0 END) AS BIGINT) AS allotted FROM f""")
def proportional_allocation(spark, sf):
    groups = read_table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return audit.allocate(groups, "priority", "n", 100)


@query()
def matched_cohorts(spark, sf):
    c = read_table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal", "c_mktsegment")
    return nearest_pairs(c.where("c_mktsegment = 'BUILDING'"), c.where("c_mktsegment = 'MACHINERY'"), "c_nationkey", "c_acctbal", "c_custkey")


@query("""SELECT l_suppkey, count(DISTINCT l_orderkey) AS awards, CAST(round(sum(l_quantity)) AS BIGINT) AS amount, max(CAST(l_shipdate AS DATE)) FILTER (CAST(l_shipdate AS DATE) <= DATE '1998-01-01') AS latest FROM lineitem GROUP BY l_suppkey""")
def award_rollup(spark, sf):
    day = F.to_date("l_shipdate")
    return read_table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("awards"), F.round(F.sum("l_quantity")).cast("long").alias("amount"), F.max(F.when(day <= "1998-01-01", day)).alias("latest"))


@query("""WITH g AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, sum(l_quantity) AS q FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, 'scale' AS claim, round(q / 1.0, 4) AS value FROM g WHERE n >= 20 UNION ALL SELECT l_suppkey, 'return_rate', round(r / n, 4) FROM g WHERE n >= 20 UNION ALL SELECT l_suppkey, 'no_returns', 1.0 FROM g WHERE r = 0""")
def registry_emitters(spark, sf):
    """Each emitter states a claim or nothing; rates need twenty rows."""
    n, r, q = F.col("n"), F.col("r"), F.col("q")
    g = read_table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.sum("l_quantity").alias("q"))
    claim = lambda name, ok, value: F.when(ok, F.struct(F.lit(name).alias("claim"), value.cast("double").alias("value")))
    claims = F.array_compact(F.array(claim("scale", n >= 20, F.round(q, 4)), claim("return_rate", n >= 20, rate(r, n)), claim("no_returns", r == 0, F.lit(1.0))))
    return g.select("l_suppkey", F.explode(claims).alias("c")).select("l_suppkey", "c.*")


@query("""WITH f AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT o_orderkey, d AS parsed, strftime(d, '%G-W%V') AS week, (2001 - year(d)) * 12 + 6 - month(d) AS months, d >= DATE '1996-06-15' AND d <= DATE '2001-06-15' AS in_window FROM f""")
def date_parse(spark, sf):
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey") % 3
    text = F.when(key == 0, F.date_format(day, "yyyy-MM-dd")).when(key == 1, F.date_format(day, "M/d/yyyy")).otherwise(F.date_format(day, "yyyyMMdd"))
    ref = F.lit("2001-06-15").cast("date")
    rows = read_table(spark, sf, "orders").select("o_orderkey", D.parse_date(text).alias("parsed"))
    return rows.select("o_orderkey", "parsed", D.week_id(F.col("parsed")).alias("week"), D.months_before(F.col("parsed"), ref).alias("months"), D.in_five_years(F.col("parsed"), ref).alias("in_window"))


@query("WITH g AS (SELECT o_custkey, unnest(list_distinct(list(o_orderpriority))) AS id FROM orders GROUP BY o_custkey) SELECT o_custkey, count(*) AS ids, min(id) AS first FROM g GROUP BY o_custkey")
def split_id_lists(spark, sf):
    cells = read_table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_set("o_orderpriority"), " ; ").alias("cell"))
    return cells.select("o_custkey", F.explode(T.id_list(F.col("cell"))).alias("id")).groupBy("o_custkey").agg(F.count("*").alias("ids"), F.min("id").alias("first"))


@query("""SELECT d.doc_id, d.source, CASE WHEN l.quality = 0 THEN 'invalid' ELSE 'valid' END AS validity_status, coalesce(l.toxic = 1, false) AS is_low_grade FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def export_with_status(spark, sf):
    rows = read_table(spark, sf, "documents").select("doc_id", "source").join(read_table(spark, sf, "labels"), "doc_id", "left")
    return rows.select("doc_id", "source", F.when(F.col("quality") == 0, "invalid").otherwise("valid").alias("validity_status"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_low_grade"))


_REVIEW = r"""WITH r AS (SELECT conv_id, turn, regexp_matches(text, '(^|\s)the(\s|$)') AS a, regexp_matches(text, '(^|\s)and(\s|$)') AS b FROM conversations WHERE length(text) >= 40), t AS (SELECT conv_id, count(*) FILTER (a OR b) AS reviews, CAST(bool_or(a) AS INT) + CAST(bool_or(b) AS INT) AS terms FROM r GROUP BY conv_id)
SELECT conv_id, reviews, terms, reviews >= 2 OR terms >= 2 AS admitted FROM t WHERE reviews > 0"""
