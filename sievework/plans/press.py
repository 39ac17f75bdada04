"""Queries over whole pages and documents as articles: shape, reprints, kinds, lists, subjects, bodies, dates and boards; the other engine evaluates the same patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import passages as P
from ..functions import text as T
from ..functions.themes import THEMES, classify
from ..operators import passages as O
from ..sources import feeds
from .markup import _BLOCK_TAGS, _NAMES, _PAGES, unescape_sql
from .planted import planted, quoted
from .signals import REMARKS, themes_sql
from .standin import standin

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


PRESS = (
    "CHICAGO, May 1 /PRNewswire/ -- {w} opens. By Ann Lee", "The following press release came from {w}.", "{w} opens a plant. Sponsored content", "By Ann Lee. {w} opens a plant. Paid post", "{w} opens. About Zeta Works: a maker of things", "For more information, contact {w}",
    "A reported article on {w}, staff writer", "This op-ed on {w}", "By Ann {w} for us", "At a conference, {w} said during her remarks", "a guest column", "Forward-looking statements of Business Wire", "| Press release | {w}", "published by our own newsroom staff; sponsored by no one",
    "Acme Inc and {w} LLC, Beta Corp, Gamma Group, Delta Builders, Omega Associates", "Acme Inc, {w} LLC, Acme  Inc, Beta Corp., Acme Inc", "a keynote at a trade show of Zeta Construction", "Globe Newswire {w}",
)
_URL = "CASE k % 7 WHEN 0 THEN 'https://x.com/opinion/a' WHEN 1 THEN 'https://x.com/rankings/1' WHEN 2 THEN 'https://x.com/news/' WHEN 3 THEN 'https://x.com/2024/a' ELSE 'https://x.com/a' END AS url"
_TITLE = "CASE k % 6 WHEN 0 THEN 'Top 40 firms' WHEN 1 THEN 'Latest News Releases' WHEN 2 THEN concat('New analytics at ', w) WHEN 3 THEN 'By Ann Lee' WHEN 4 THEN '' ELSE 'Plain' END AS title"
_PRESS = f"SELECT k, w, text, {_URL}, {_TITLE} FROM ({planted(PRESS)})"
_LIKE = lambda column, rx: f"regexp_matches({column}, {quoted(rx)})"


@query(f"""WITH d AS ({_PRESS}), b AS (SELECT *, title || chr(10) || substr(text, 1, 4000) AS blob FROM d)
SELECT k, CASE WHEN {_LIKE('blob', P.WIRE)} THEN 'wire' WHEN {_LIKE('blob', P.RELEASE_LABEL)} THEN 'label' WHEN ({_LIKE('blob', P.SPONSORED)} OR {_LIKE('text', P.FOOTER)}) AND NOT {_LIKE('blob', P.BYLINE)} THEN 'unsigned' ELSE '' END AS verdict FROM b""")
def wire_verdict(spark, sf):
    """Reprinted press releases among whole documents: by wire, by label, or by boilerplate that no reporter signs."""
    standin(spark, sf)
    return spark.sql(_PRESS).select("k", P.reprint(F.col("text"), F.col("title")).alias("verdict"))


@query(f"""WITH d AS ({_PRESS}) SELECT k, CASE WHEN {_LIKE('url', P.COLUMN_URL)} OR {_LIKE('substr(text, 1, 1500)', P.COLUMN_TEXT)} OR {_LIKE('right(text, 2500)', P.COLUMN_TEXT)}
  OR regexp_matches(title || chr(10) || substr(text, 1, 600), '(?i)\\bby\\s+Ann ' || w || '\\b') THEN 'ST-EXECCOLUMN' WHEN k % 2 = 0 THEN CASE WHEN {_LIKE('text', P.PANEL)} THEN 'ST-EXECPANEL' ELSE 'ST-EXECQUOTE-REPORTED' END ELSE 'ST-PRESSPROFILE' END AS kind FROM d""")
def article_type(spark, sf):
    """What kind of article each document is; every second one quotes somebody."""
    standin(spark, sf)
    people = F.array(F.concat(F.lit("Ann "), "w"))
    return spark.sql(_PRESS).select("k", P.article_kind(F.col("text"), F.col("title"), F.col("url"), people, F.col("k") % 2 == 0).alias("kind"))


@query(f"""WITH d AS ({_PRESS}), o AS (SELECT k, url, title, list_distinct(list_filter(list_transform(regexp_extract_all(text, {quoted(P.ORGANISATION)}),
  lambda m: lower(regexp_replace(regexp_replace(m, '\\s+', ' ', 'g'), '^[ .,]+|[ .,]+$', '', 'g'))), lambda n: length(n) >= 6)) AS names FROM d)
SELECT k, len(names) AS n_names, CASE WHEN {_LIKE('url', P.LISTING_URL)} THEN 'list url' WHEN {_LIKE('title', P.LISTING_TITLE)} THEN 'list title' WHEN len(names) >= 6 THEN 'many organisations' ELSE '' END AS why FROM o""")
def multi_subject_docs(spark, sf):
    """Documents without a single subject: lists, rankings, features of many organisations."""
    standin(spark, sf)
    return spark.sql(_PRESS).select("k", F.size(P.organisations(F.col("text"))).cast("long").alias("n_names"), P.several_subjects(F.col("text"), F.col("title"), F.col("url")).alias("why"))


_TOLD = f"SELECT k, w, text, CASE k % 3 WHEN 0 THEN 'New ERP and analytics' WHEN 1 THEN '' ELSE 'Cybersecurity at {{w}}' END AS title FROM ({planted(REMARKS)})"


@query(f"""WITH d AS ({_TOLD}), {themes_sql('d', THEMES, 'h')},
s AS (SELECT x.k, x.theme, count(DISTINCT regexp_replace(lower(regexp_extract(own, rx)), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')) AS terms, bool_or(d.title <> '' AND contains(lower(d.title), regexp_replace(lower(regexp_extract(own, rx)), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g'))) AS titled FROM h_x x JOIN d ON d.k = x.k WHERE regexp_matches(own, rx) GROUP BY x.k, x.theme)
SELECT s.k, s.theme, terms >= 2 OR titled AS subject FROM s JOIN h ON h.k = s.k AND h.theme = s.theme WHERE admitted""")
def theme_subject(spark, sf):
    """Each admitted theme of each document, and whether it is its subject: two different terms, or one that the title has."""
    standin(spark, sf)
    rows = spark.sql(_TOLD).select("k", "title", F.explode(F.filter(classify(F.col("text")), lambda t: t["admitted"])).alias("t"))
    return rows.select("k", "t.theme", P.is_subject(F.col("t.hits"), F.col("title")).alias("subject"))


_SENTENCE = "The {w} plant was opened by a crowd of people who had come from afar to see how it works and to hear what its makers say."
BODIES = (
    f"<p>{_SENTENCE} {_SENTENCE}</p><p>Recommended Reading</p><p>{_SENTENCE}</p>", f"<p>ANN LEE:</p><p>{_SENTENCE}</p><p>BOB RAY:</p><p>News</p>", f"<p>Editors&rsquo; picks</p><p>{_SENTENCE}</p>", f"<li>{_SENTENCE}</li><p>More from us</p>",
    "<p>short</p><p>Filed Under: plants</p>", f"<p>{_SENTENCE * 3}</p>", "<h2>A headline about {w} of ninety characters or so that stands alone and goes no further</h2>" * 9, f"<p>Q.A. POE-RAY:</p><p>{_SENTENCE[:50]}.</p><p>keep up with the story now</p>",
)
_BODY_PAGES = planted(BODIES, more=", url", **_PAGES)
_BLOCKS = rf"""p AS ({_BODY_PAGES}), a AS (SELECT k, w, text, regexp_replace(regexp_replace(text, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS h FROM p),
b AS (SELECT k, w, text, regexp_replace(regexp_replace(h, '(?i)</?({_BLOCK_TAGS})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a), u AS (SELECT k, w, text, {unescape_sql('t')} AS t FROM b, e),
l AS (SELECT k, w, text, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM u)"""


@query(f"""WITH {_NAMES}, {_BLOCKS}, d AS (SELECT k, l, trim(regexp_replace(regexp_extract(text, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS own, {_URL}, {_TITLE.replace('w)', 'w)')} FROM l),
t AS (SELECT k, l, url, CASE WHEN k % 6 = 1 THEN title ELSE own END AS title FROM d)
SELECT k, CASE WHEN {_LIKE('title', P.INDEX_TITLE)} THEN 'index title' WHEN {_LIKE('url', P.INDEX_URL)} THEN 'index url' WHEN coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) < 700 THEN 'too short'
  WHEN coalesce(list_max(list_transform(l, lambda x: length(x))), 0) < 180 THEN 'no paragraph' ELSE '' END AS refusal FROM t""")
def article_shape(spark, sf):
    """Whether each page reads as one article, or why not."""
    standin(spark, sf)
    rows = spark.sql(f"SELECT k, w, text, {_URL}, {_TITLE} FROM ({_BODY_PAGES.replace(', url', '')})")
    title = F.when(F.col("k") % 6 == 1, F.col("title")).otherwise(T.page_title(F.col("text")))
    return rows.select("k", P.article_refusal(T.block_lines(F.col("text")), title, F.col("url")).alias("refusal"))


@query(rf"""WITH {_NAMES}, {_BLOCKS}, r AS (SELECT k, unnest(range(len(l))) AS no, unnest(l) AS line FROM l),
f AS (SELECT *, length(line) >= 110 OR length(line) >= 45 AND regexp_matches(line, '[.!?]["”’'']?$') AS prose FROM r),
g AS (SELECT *, prose OR regexp_matches(line, '^{O.SPEAKER.replace(chr(39), chr(39) * 2)}$') AND coalesce(lead(prose) OVER (PARTITION BY k ORDER BY no), false) AS keep FROM f),
h AS (SELECT *, coalesce(max(keep::INT) OVER (PARTITION BY k ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AND regexp_matches(trim(line), {quoted(O.END_OF_ARTICLE)}) AS ends FROM g),
i AS (SELECT *, max(ends::INT) OVER (PARTITION BY k ORDER BY no) AS over_ FROM h)
SELECT k, count(*) AS kept, sum(length(line))::BIGINT AS n_chars, md5(string_agg(line, chr(10) ORDER BY no)) AS digest FROM i WHERE keep AND over_ = 0 GROUP BY k""")
def article_body(spark, sf):
    """The prose of each page up to the first end marker behind it, with speakers' labels where prose follows."""
    standin(spark, sf)
    lines = spark.sql(_BODY_PAGES).select("k", F.posexplode(T.block_lines(F.col("text"))).alias("no", "line"))
    body = O.body_lines(lines, "k", "no", "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n")
    return body.groupBy("k").agg(F.count("*").alias("kept"), F.sum(F.length("line")).cast("long").alias("n_chars"), F.md5(text).alias("digest"))


DATES = (
    '<script type="application/ld+json">{"datePublished": "2024-05-11T01:02"}</script>', '<meta property="article:published_time" content="2023-02-30"><meta name="date" content="2023-02-28">', '<meta content="2022-11-05T00:00Z" property="article:published_time">',
    '<time class="t" datetime="2021-01-09">', "May 5, 2020 and 2020-05-05", '{"datePublished": "yesterday it was", "datePublished":"2019-09-09T"}', "<meta name='pubdate' content='on 2018-07-31'>", '<time datetime="soon"><time datetime="2017-13-01"><time datetime="2017-12-01">',
)


def _date_sql() -> str:
    parts = [f"list_filter(list_transform(regexp_extract_all(text, {quoted(rx)}, 1), lambda x: try_cast(regexp_extract(x, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1) AS DATE)), lambda d: d IS NOT NULL)[1]" for rx in feeds.DATE_PATTERNS]
    return f"coalesce(CAST(coalesce({', '.join(parts)}) AS VARCHAR), '')"


@query(f"SELECT k AS id, {_date_sql()} AS published FROM ({planted(DATES, **_PAGES)})")
def published_date(spark, sf):
    """Only what the markup of a page states; a date in prose is no publication date, and an impossible one is passed over."""
    standin(spark, sf)
    return spark.sql(planted(DATES, **_PAGES)).select(F.col("k").alias("id"), feeds.published_date(F.col("text")).alias("published"))


BOARDS = (
    "https://acme.wd5.myworkdayjobs.com/x", "careers-{w}.icims.com", "login.icims.com", "https://job-boards.greenhouse.io/embed/job_board?for=acme", "https://example.com/myworkdayjobs", "jobs.lever.co/{w}", "a typical workday at icims", "https://x.recruiting2.ultipro.com",
    "https://workforcenow.adp.com/m?cid=12345678-1234-1234-1234-123456789abc", "recruiting.adp.com", "paycomonline.net", "https://zeta.bamboohr.com/jobs", "https://www.icims.com and careers.smartrecruiters.com/Zeta", "intelliapp.driverapponline.com", "zeta.taleo.net zeta.driverreach.com", "jobs.jobvite.com/zeta",
)


def _board_sql() -> str:
    """System and tenant; the board whose pattern looks around itself is read by what stands before a name, and its own shared hosts are passed over."""
    system, tenant = [], []
    for name, rx in feeds.ATS_FINGERPRINTS:
        hit, key = f"regexp_matches(text, {quoted('(?i)' + rx)})", f"regexp_extract(text, {quoted('(?i)' + rx)}, 1)" if "([" in rx else "''"
        if "(?<!" in rx:
            own = "list_filter(regexp_extract_all(text, '(?i)(?:^|[^a-zA-Z0-9.-])([a-z0-9-]+)\\.icims\\.com', 1), lambda x: lower(x) NOT IN ('login', 'www', 'secure'))"
            hit, key = f"len({own}) > 0", f"{own}[1]"
        system.append(f"WHEN {hit} THEN '{name}'")
        tenant.append(f"WHEN {hit} THEN {key}")
    return f"CASE {' '.join(system)} END AS system, CASE {' '.join(tenant)} END AS tenant"


@query(f"SELECT *, CASE WHEN system IS NOT NULL THEN system IN ('workday', 'icims', 'paylocity', 'greenhouse', 'lever', 'adp') END AS readable FROM (SELECT k AS id, {_board_sql()} FROM ({planted(BOARDS, ' ', **_PAGES)}))")
def fingerprints(spark, sf):
    """The applicant system that each page names by its host, with its tenant, and whether its postings can be read."""
    standin(spark, sf)
    return spark.sql(planted(BOARDS, " ", **_PAGES)).select(F.col("k").alias("id"), feeds.applicant_system(F.col("text")).alias("s")).select("id", "s.*")
