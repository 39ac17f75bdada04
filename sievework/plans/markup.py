"""Queries over the markup of whole pages into which references, anchors and consent boxes are set."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import text as T
from ..sources import feeds
from ..sources.tables import read_table
from .planted import planted, quoted

QUERIES, SQL = {}, {}


def pages(spark, sf) -> None:
    read_table(spark, sf, "pages").createOrReplaceTempView("pages")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


REFERENCES = (
    "R&#38;D &lt;x&gt; caf&eacute;&nbsp;A &quot;b&quot;", "tom &amp; jerry &AMP; co, &amp;amp; &copy2020 &notit; &notin; A&B & C", "&#128; &#x80; &#0; &#xD800; &#1114112; &#99999999999999999999; &#xfffe;",
    "&bogus; &#; &#x; &#xG; &Eacute &frac12; &hellip; &lsquo;{w}&rsquo;", "<p title='&lt;'>{w} &NotEqualTilde; &#x1F600; &#8364;</p>", "&", "no reference of {w}", "<b>&lt;script&gt;</b> &#60;i&#62; &ampamp; &ltgt;",
)
ANCHORS = (
    "<a href='/a/../b/./c.html?x=1&amp;y=2#z'>one</a>", '<A class="k" HREF="d/e">two</A><a href="../../f">up</a>', "<a href=g.html>three</a><a name=x>none</a>", '<a\nhref = "https://{w}.example/p">far</a>',
    '<a href="//cdn.example/q">same scheme</a>', '<a href="?page=2">next</a><a href="#top">top</a>', "<a href=''>self</a><a href=\"mailto:x@{w}.example\">mail</a>", '<abbr href="/no">x</abbr><a data-href="/no" href="/yes">y</a>', '<a href="/h/..">.</a><a href="./">.</a>',
)
BOXES = (
    '<div id="cookie-banner"><div class="a"><p>We use cookies, {w}</p></div><DIV>more</DIV></div>', "<section class='gdpr box'><div>never ends", '<div class="x" aria-label="Cookie consent"><span class="cookie">a</span></div><p>after</p>',
    "<img class=\"cookie\"><input id=consent /><p id=onetrust>{w}</p>", "<main class=\"cookie\"><div id='cmplz-box'><div>in</div></div></main>", '</div><div class="cli-bar">bar<div/></div>', '<div class="consent">' + "long " * 4000 + '<p class="gdpr">p</p></div>',
    '<div class="content"><div class="cookie-a">a</div><div class="cookie-b">b<div>c</div></div></div>', "<p>a cookie is food</p>",
)

_PAGES = {"table": "pages", "key": "page_id", "text": "html", "before": "<"}


def unescape_sql(column: str) -> str:
    """The standard's rules for character references; `names` is the map of named ones."""
    special = ", ".join(f"{n}: {quoted(c)}" for n, c in M._RENUMBERED.items() if c) or "-1: ''"
    dropped = ", ".join(str(n) for n, c in M._RENUMBERED.items() if not c)
    legacy = "^(?:" + "|".join(M._LEGACY) + ")"
    number = """CASE WHEN r.num ^@ '#x' OR r.num ^@ '#X' THEN list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(lower(r.digits), ''), lambda c: (instr('0123456789abcdef', c) - 1)::HUGEINT)), lambda a, d: least(a, 9999999999) * 16 + d)
        ELSE list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(r.digits, ''), lambda c: (instr('0123456789', c) - 1)::HUGEINT)), lambda a, d: least(a, 9999999999) * 10 + d) END"""
    char = f"""CASE WHEN v.n = 0 OR v.n > 1114111 OR v.n BETWEEN 55296 AND 57343 THEN chr(65533) WHEN v.n BETWEEN 64976 AND 65007 OR v.n % 65536 >= 65534 OR v.n IN ({dropped}) THEN ''
        ELSE coalesce((MAP {{{special}}})[v.n::INT], chr(v.n::INT)) END"""
    parts = f"""list_transform(string_split({column}, '&')[2:], lambda x: {{'x': x, 'num': regexp_extract(x, '^#(?:[0-9]+|[xX][0-9a-fA-F]+);?'), 'digits': regexp_extract(substr(regexp_extract(x, '^#(?:[0-9]+|[xX][0-9a-fA-F]+)'), 2), '[0-9a-fA-F]+'),
        'name': regexp_extract(x, '^[^\\t\\n\\f <&#;]{{1,32}};?'), 'start': regexp_extract(x, {quoted(legacy)})}})"""
    one = f"""CASE WHEN r.num <> '' THEN list_transform([{{'n': {number}}}], lambda v: {char})[1] || substr(r.x, length(r.num) + 1)
        WHEN names[r.name] IS NOT NULL THEN names[r.name] || substr(r.x, length(r.name) + 1) WHEN r.start <> '' THEN names[r.start] || substr(r.x, length(r.start) + 1) ELSE '&' || r.x END"""
    return f"(string_split({column}, '&')[1] || array_to_string(list_transform({parts}, lambda r: {one}), ''))"


_NAMES = "e AS (SELECT map_from_entries([" + ", ".join(f"({quoted(n)}, {quoted(c)})" for n, c in html5.items()) + "]) AS names)"


@query(rf"""WITH {_NAMES}, p AS ({planted(REFERENCES, **_PAGES)}),
a AS (SELECT k, regexp_replace(regexp_replace(regexp_replace(text, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS h FROM p),
b AS (SELECT k, trim(regexp_replace({unescape_sql('h')}, '\s+', ' ', 'g')) AS v FROM a, e) SELECT k AS page_id, length(v) AS n_chars, md5(v) AS digest FROM b""")
def html_visible_text(spark, sf):
    """The text of each page, with references of every kind set into it."""
    pages(spark, sf)
    v = spark.sql(planted(REFERENCES, **_PAGES)).select("k", T.visible_text(F.col("text")).alias("v"))
    return v.select(F.col("k").alias("page_id"), F.length("v").cast("long").alias("n_chars"), F.md5("v").alias("digest"))


_BLOCK_TAGS = "p|div|li|ul|ol|h[1-6]|br|article|nav|footer|header|section|tr|td|th|table|title|body|html|head"


@query(rf"""WITH {_NAMES}, a AS (SELECT k AS page_id, regexp_replace(regexp_replace(text, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS h FROM ({planted(REFERENCES, **_PAGES)})),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)</?({_BLOCK_TAGS})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
u AS (SELECT page_id, {unescape_sql('t')} AS t FROM b, e),
l AS (SELECT page_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM u),
r AS (SELECT page_id, CAST(unnest(range(len(l))) AS INT) AS no, unnest(l) AS line FROM l)
SELECT page_id, no, length(line) AS n_chars, length(line) >= 110 OR (length(line) >= 45 AND regexp_matches(line, '[.!?]$')) AS is_prose FROM r""")
def page_block_lines(spark, sf):
    """The text of each block of each page, in order, and whether it reads as prose."""
    pages(spark, sf)
    lines = spark.sql(planted(REFERENCES, **_PAGES)).select(F.col("k").alias("page_id"), F.posexplode(T.block_lines(F.col("text"))).alias("no", "line"))
    prose = (F.length("line") >= 110) | ((F.length("line") >= 45) & F.col("line").rlike(r"[.!?]$"))
    return lines.select("page_id", "no", F.length("line").alias("n_chars"), prose.alias("is_prose"))


_RESOLVED = r"""l AS (SELECT k, url, list_transform(regexp_extract_all(text, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1), lambda h: trim(regexp_replace(h, '^["'']|["'']$', '', 'g'))) AS raw FROM p),
f AS (SELECT k, url, unnest(range(len(raw))) AS place, unnest(raw) AS raw FROM l),
u AS (SELECT k, place, regexp_replace(url, '#.*$', '') AS bare, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS site, {href} AS href FROM f, e),
q AS (SELECT *, regexp_replace(bare, '\?.*$', '') AS page, regexp_extract(href, '^[^?#]*') AS path, regexp_extract(href, '[?#].*$') AS tail FROM u),
s AS (SELECT *, CASE WHEN path ^@ '/' THEN path ELSE coalesce(nullif(regexp_extract(substr(page, length(site) + 1), '^(.*/)[^/]*$', 1), ''), '/') || path END AS full_path FROM q),
w AS (SELECT *, list_reduce(list_prepend('', string_split(full_path, '/')[2:]), lambda a, x: CASE x WHEN '.' THEN a WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END)
      || CASE WHEN regexp_matches(full_path, '/\.{1,2}$') THEN '/' ELSE '' END AS walked FROM s),
r AS (SELECT k, place, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href ^@ '//' THEN scheme || ':' || href WHEN href = '' THEN bare WHEN href ^@ '#' THEN bare || href
      WHEN href ^@ '?' THEN page || href ELSE site || walked || tail END AS link FROM w)"""
_ANCHORED = planted(ANCHORS, more=", url", **_PAGES)
_HREFS = f"WITH {_NAMES}, p AS (SELECT page_id AS k, url, html AS text FROM pages), " + _RESOLVED[: _RESOLVED.index(",\nq AS (")].replace("{href}", unescape_sql("raw"))


@query(_HREFS + """, c AS (SELECT k, count(*) AS n_links, count(DISTINCT href) AS n_distinct FROM u GROUP BY k), a AS (SELECT p.k AS page_id, coalesce(n_links, 0) AS n_links, coalesce(n_distinct, 0) AS n_distinct FROM p LEFT JOIN c USING (k))
SELECT *, count(*) OVER (PARTITION BY n_links) AS pages_alike FROM a""")
def page_links(spark, sf):
    """How many links each page has, how many different ones, and how many pages have as many. The links themselves are page_link_rows."""
    rows = read_table(spark, sf, "pages").select("page_id", M.hrefs(F.col("html")).alias("l")).select("page_id", F.size("l").cast("long").alias("n_links"), F.size(F.array_distinct("l")).cast("long").alias("n_distinct"))
    alike = rows.groupBy("n_links").agg(F.count("*").alias("pages_alike"))
    return rows.join(alike, "n_links").select("page_id", "n_links", "n_distinct", "pages_alike")


@query(_HREFS + " SELECT k AS page_id, place, href AS link FROM u")
def page_link_rows(spark, sf):
    """A row for each link of each page, in order, as the page states it; pages without links have none."""
    return read_table(spark, sf, "pages").select("page_id", F.posexplode(M.hrefs(F.col("html"))).alias("place", "link")).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {_NAMES}, p AS ({_ANCHORED}), " + _RESOLVED.replace("{href}", unescape_sql("raw")) + " SELECT k AS page_id, place, link FROM r")
def resolved_links(spark, sf):
    """A row for each link of each page, in order, where it leads from there: anchors of every form are set into the pages."""
    pages(spark, sf)
    found = spark.sql(_ANCHORED).select(F.col("k").alias("page_id"), M.links(F.col("text"), F.col("url")).alias("l"))
    return found.select("page_id", F.posexplode("l").alias("place", "link")).withColumn("place", F.col("place").cast("long"))


@query(rf"""WITH RECURSIVE p AS ({planted(BOXES, **_PAGES)}),
l AS (SELECT k, length(text) AS size, regexp_extract_all(text, {quoted(M.TAG)}) AS tags, string_split_regex(text, {quoted(M.TAG)}) AS texts FROM p),
o AS (SELECT k, size, unnest(range(len(texts))) AS i, unnest(texts) AS txt, unnest(list_concat(tags, [''])) AS tag FROM l),
t AS (SELECT *, lower(regexp_extract(tag, {quoted(M.TAG)}, 2)) AS name, CASE WHEN regexp_extract(tag, {quoted(M.TAG)}, 4) = '/' THEN 0 WHEN regexp_extract(tag, {quoted(M.TAG)}, 1) = '/' THEN -1 ELSE 1 END AS step,
      sum(length(txt) + length(tag)) OVER (PARTITION BY k ORDER BY i) AS stop FROM o),
d AS (SELECT *, sum(step) OVER (PARTITION BY k, name ORDER BY i) AS depth FROM t WHERE tag <> '' AND step <> 0),
m AS (SELECT *, lead(i) OVER w AS j, lead(step) OVER w AS closes, lead(stop) OVER w AS ends FROM d WINDOW w AS (PARTITION BY k, name, depth - least(step, 0) ORDER BY i)),
c AS (SELECT k, i, j FROM m WHERE step = 1 AND closes = -1 AND ends - (stop - length(tag)) <= size // 2 AND name NOT IN ({', '.join(map(quoted, (*M.VOID, *M.ROOTS)))})
      AND len(list_filter(regexp_extract_all(regexp_extract(tag, {quoted(M.TAG)}, 3), {quoted(M.NAMING)}, 1), lambda v: regexp_matches(v, {quoted(M.CONSENT)}))) > 0),
g(k, i, j) AS (SELECT DISTINCT k, -1::BIGINT, -1::BIGINT FROM c UNION ALL
      SELECT k, x.i, x.j FROM (SELECT g.k, min(struct_pack(i := c.i, j := c.j)) AS x FROM g JOIN c ON c.k = g.k AND c.i > g.j GROUP BY g.k)),
h AS (SELECT t.k, string_agg(CASE WHEN n.inside THEN '' ELSE t.txt END || CASE WHEN n.inside OR n.opens THEN '' ELSE t.tag END, '' ORDER BY t.i) AS html
      FROM t, LATERAL (SELECT coalesce(bool_or(g.i < t.i AND t.i <= g.j), false) AS inside, coalesce(bool_or(g.i = t.i AND g.i >= 0), false) AS opens FROM g WHERE g.k = t.k) n GROUP BY t.k)
SELECT h.k AS page_id, (SELECT count(*) FROM g WHERE g.k = h.k AND g.i >= 0) AS removed, length(h.html) AS n_chars, md5(h.html) AS digest FROM h""")
def consent_boxes(spark, sf):
    """Pages without their consent boxes, nested ones included: what each box holds goes with it, wrappers of the page stay."""
    pages(spark, sf)
    r = spark.sql(planted(BOXES, **_PAGES)).select("k", M.remove_elements(F.col("text")).alias("r"))
    return r.select(F.col("k").alias("page_id"), F.col("r.removed").cast("long").alias("removed"), F.length("r.html").cast("long").alias("n_chars"), F.md5("r.html").alias("digest"))


LISTS = (
    "<a href='/jobs/12'>Plant Engineer, Reno</a><a href=\"/jobs/13?x=1\">Data Analyst II</a><a href='/jobs/14'>Truck Driver (Class A)</a><a href='/jobs/14'>again Driver</a>", '<a href="/careers/all-jobs">View all jobs</a><a href="/jobs/1">Learn more</a>',
    "<a href='/openings/a.pdf'>Plant Manager form, 1</a><a href='https://{w}.example/job-77'>Night Dispatcher - Erie</a>", '<a href="/positions/9"><b>Senior</b>&nbsp;Buyer &amp; Planner</a><a href="/about">Estimator, Ohio</a>',
    "<a href='?job=5'>Welder / Fitter</a><a href='?jobid=6'>Short</a><a href='?req=7'>Field Nurse | Days</a>", "<a href='https://x.example/jobs/501/Job?m=1'>  Requisition Title  AI Systems&#x20;Engineer </a><a href='https://x.example/jobs/501/other'>again</a>",
    '<a class="z" href="https://x.example/jobs/77/estimator/job?in=1"><span>External Job Title</span> Estimator II</a>', '<a href="https://x.example/jobs/78/t">Title</a><a href="https://x.example/jobs/79/u">Job title: Foreman</a>',
    "nothing for {w}", "<a href='/career/crane-operator'>Crane Operator 2</a>" * 2,
)
_LISTED = planted(LISTS, more=", url", **_PAGES)


@query(rf"""WITH {_NAMES}, p AS ({_LISTED}),
m AS (SELECT k, url, unnest(range(len(a))) AS i, unnest(a) AS href, unnest(b) AS body FROM (SELECT k, url, regexp_extract_all(text, {quoted(feeds.INLINE_ANCHOR)}, 1) AS a, regexp_extract_all(text, {quoted(feeds.INLINE_ANCHOR)}, 2) AS b FROM p)),
c AS (SELECT k, url, i, href, regexp_replace(body, '<[^>]+>', ' ', 'g') AS body FROM m), t AS (SELECT k, url, i, href AS raw, trim(regexp_replace({unescape_sql('body')}, '\s+', ' ', 'g')) AS title FROM c, e),
j AS (SELECT * FROM t WHERE regexp_matches(raw, {quoted(feeds.INLINE_HREF)}) AND length(title) BETWEEN 8 AND 90 AND NOT regexp_matches(title, {quoted(feeds.INLINE_NAV)}) AND NOT regexp_matches(title, {quoted(feeds.INLINE_LEADING_NAV)})
      AND contains(title, ' ') AND regexp_matches(title, {quoted(feeds.INLINE_ROLE)}) AND NOT regexp_matches(raw, {quoted(feeds.INLINE_FILE)})),
u AS (SELECT k, i AS place, title, regexp_replace(url, '#.*$', '') AS bare, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS site, raw AS href FROM j),
{_RESOLVED[_RESOLVED.index("q AS (SELECT *, regexp_replace(bare"):].replace("r AS (SELECT k, place, CASE", "r AS (SELECT k, place, title, CASE")},
s AS (SELECT k, place, title, string_split(link, '?')[1] AS link FROM r), d AS (SELECT *, row_number() OVER (PARTITION BY k, link ORDER BY place) AS turn FROM s),
f AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, count(*) FILTER (regexp_matches(title, {quoted(feeds.INLINE_QUALIFIER)})) OVER (PARTITION BY k) AS q FROM d WHERE turn = 1)
SELECT k AS page_id, title, link AS url, left(string_split(link, '/')[-1], 40) AS job_id FROM f WHERE n >= 3 AND q * 2 >= n""".replace("s AS (SELECT *, CASE WHEN path", "z AS (SELECT *, CASE WHEN path").replace("AS walked FROM s)", "AS walked FROM z)"))
def inline_postings(spark, sf):
    """The postings that pages list themselves; a page with fewer than three, or with titles that name no place or level, is navigation."""
    pages(spark, sf)
    jobs = spark.sql(_LISTED).select("k", F.explode(feeds.inline_jobs(F.col("text"), F.col("url"))).alias("j"))
    return jobs.select(F.col("k").alias("page_id"), "j.title", "j.url", "j.job_id")


@query(rf"""WITH {_NAMES}, p AS ({_LISTED}), m AS (SELECT k, unnest(range(len(a))) AS i, unnest(a) AS link, unnest(b) AS job_id, unnest(c) AS body FROM (SELECT k, regexp_extract_all(text, {quoted(feeds.ICIMS_ANCHOR)}, 1) AS a,
regexp_extract_all(text, {quoted(feeds.ICIMS_ANCHOR)}, 2) AS b, regexp_extract_all(text, {quoted(feeds.ICIMS_ANCHOR)}, 3) AS c FROM p)), x AS (SELECT *, regexp_replace(body, '<[^>]+>', ' ', 'g') AS plain FROM m),
t AS (SELECT k, i, string_split(link, '?')[1] AS url, job_id, trim(regexp_replace(regexp_replace({unescape_sql('plain')}, {quoted(feeds.ICIMS_LABEL)}, ''), '\s+', ' ', 'g')) AS title FROM x, e)
SELECT k AS page_id, title, url, job_id FROM t WHERE title <> '' QUALIFY row_number() OVER (PARTITION BY k, job_id ORDER BY i) = 1""")
def results_page_postings(spark, sf):
    """The postings of pages of results, one for each number, under their own titles."""
    pages(spark, sf)
    jobs = spark.sql(_LISTED).select("k", F.explode(feeds.icims_jobs(F.col("text"))).alias("j"))
    return jobs.select(F.col("k").alias("page_id"), "j.title", "j.url", "j.job_id")


#: A careers page that links to postings, with what was archived of them, and a paged list of requisitions, both made from whole pages.
_ARCHIVES = """SELECT page_id AS id, 'paylocity' AS board, to_json(named_struct('careers', concat(html, '<a href="https://recruiting.paylocity.com/Recruiting/Jobs/Details/', page_id, '">a</a> recruiting.paylocity.com/Recruiting/Jobs/Details/900000007',
 ' recruiting.paylocity.com/Recruiting/Jobs/Details/', page_id, ' recruiting.paylocity.com/Recruiting/Jobs/Details/900000008'), 'details', map(CAST(page_id AS STRING), concat('{"jobTitle" : "Planner &amp; Buyer ', page_id, '"}'), '900000007', '<title>Zeta - Shift Lead - Nights</title>', '900000008', '<title>X - Job Not Found</title>'))) AS body FROM pages WHERE page_id % 2 = 0
 UNION ALL SELECT page_id, 'adp', concat('{"jobRequisitions":[{"requisitionTitle":" Clerk ', page_id, ' ","requisitionLocations":[{"nameCode":{"shortName":"Reno"}}],"postDate":"2024-05-06T00:00","itemID":"', page_id, '"},{"requisitionTitle":"Lead","itemID":5}],"meta":{"totalNumber":', page_id, '}}') FROM pages WHERE page_id % 2 = 1"""


@query("""SELECT page_id AS id, 'paylocity' AS board, concat('Planner & Buyer ', page_id) AS title, '' AS location, '' AS posted, concat('https://recruiting.paylocity.com/Recruiting/Jobs/Details/', page_id) AS url, CAST(page_id AS VARCHAR) AS job_id, false AS truncated FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 'paylocity', 'Shift Lead - Nights', '', '', 'https://recruiting.paylocity.com/Recruiting/Jobs/Details/900000007', '900000007', false FROM pages WHERE page_id % 2 = 0
UNION ALL SELECT page_id, 'adp', concat('Clerk ', page_id), 'Reno', '2024-05-06', CAST(page_id AS VARCHAR), CAST(page_id AS VARCHAR), page_id > 40 FROM pages WHERE page_id % 2 = 1 UNION ALL SELECT page_id, 'adp', 'Lead', '', '', '5', '5', page_id > 40 FROM pages WHERE page_id % 2 = 1""")
def linked_postings(spark, sf):
    """Postings behind links of a careers page, those that are gone left out, and those of a paged list, marked where more exist than were read."""
    pages(spark, sf)
    return feeds.postings(spark.sql(_ARCHIVES), 40).drop("place")
