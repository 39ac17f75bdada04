"""The pipelines as composed queries: archived text of each company -> rows -> identity -> classification -> claim -> what the claim does to the stored one.

Each customer is a company under a coined word and has one of the archives below. The other engine is told the claim that the rules
give, and works out the merge itself: even keys have a claim on file, every third of these set by a person.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import passages as P
from ..functions import text as T
from ..functions.postings import classify_posting
from ..functions.scores import overlap_score
from ..functions.themes import classify
from ..operators import merge, parties, rollups, sequences
from ..operators import passages as O
from ..sources import feeds
from .articles import _WORDS, _quoted, words, worked_out
from .standin import standin

QUERIES, SQL = {}, {}


def pipeline(rows: list[tuple[str, str | None]]):
    """A query over all customers: archive (with {w} for the company's word) and claim."""

    def add(f):
        n = len(rows)
        values = ", ".join(f"({i}, {_quoted(claim)})" for i, (_, claim) in enumerate(rows))
        SQL[f.__name__] = f"""WITH c AS (SELECT k, replace(claim, '{{w}}', w) AS claim FROM ({_WORDS}) JOIN (VALUES {values}) t(i, claim) ON k % {n} = i WHERE claim IS NOT NULL)
SELECT k, claim, CASE WHEN k % 2 = 1 THEN 'inserted' WHEN k % 3 = 0 THEN 'conflict' ELSE 'updated' END AS action FROM c"""

        def run(spark, sf):
            standin(spark, sf)
            body = F.replace(F.get(F.array(*[F.lit(a) for a, _ in rows]), (F.col("k") % n).cast("int")), F.lit("{w}"), F.col("w"))
            companies = words(spark)
            claims = f(worked_out(companies, body=body)).select("k", "claim")
            stored = companies.where("k % 2 = 0").select("k", F.lit("an older claim").alias("claim"), (F.col("k") % 3 == 0).alias("is_human"), F.lit(False).alias("is_invalid"))
            return merge.sync_actions(stored, claims.withColumn("turn", F.lit(1)), ["k"], ["claim"], "turn").select("k", "claim", "action")

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        return run

    return add


def _joined(rows: DataFrame, part, *order) -> DataFrame:
    """One claim for each company of its parts, in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, part.alias("_part")))), lambda x: x["_part"]), "; ")
    return rows.groupBy("k").agg(text.alias("claim"))


@pipeline([
    ("USDOT Number:|9|Legal Name:|{w} INC|DBA Name:|Physical Address:|x|Operating Authority Status:|NOT AUTHORIZED|Power Units:|12", "authority_gap=NOT AUTHORIZED; fleet_scale=12"),
    ("USDOT Number:|9|Legal Name:|South{w} Express|DBA Name:|Physical Address:|x|Operating Authority Status:|NOT AUTHORIZED|Power Units:|12", None),
    ("USDOT Number:|9|Legal Name:|Other|DBA Name:|{w} Freight|Physical Address:|x|Operating Authority Status:|AUTHORIZED FOR:|Property|Power Units:|0", None),
    ("Record Not Found", None),
    ("USDOT Number:|9|Legal Name:|{w}|DBA Name:|Physical Address:|x|Operating Authority Status:|AUTHORIZED FOR:|Property|Power Units:|1,200", "fleet_scale=1200"),
])
def pipeline_carrier_registry(rows):
    """Registry pages: labels, score of the names, and emitters that each state a claim or nothing."""
    page = feeds.carrier_snapshot(rows.select(F.struct("k", "w").alias("id"), F.split("body", r"\|").alias("lines")))
    c = F.col
    score = N.registry_score(c("id.w"), c("legal_name"), c("dba_name"), c("authority") == "AUTHORIZED", c("power_units"), F.lit(12))
    claims = F.array_compact(F.array(F.when(c("authority") != "AUTHORIZED", F.concat(F.lit("authority_gap="), "authority")), F.when(c("power_units") > 0, F.concat(F.lit("fleet_scale="), "power_units"))))
    return page.where(score >= 55).select(c("id.k").alias("k"), F.explode(claims).alias("part")).transform(lambda d: _joined(d, F.col("part"), "part"))


@pipeline([
    ('{"jobs":[{"title":"WMS Analyst {w}","location":{"name":"A"}},{"title":"wms analyst {w} ","location":{"name":"a"}},{"title":"WMS Analyst","location":{"name":"B"}},{"title":"Warehouse Associate, WMS","location":{"name":"C"}}]}', "warehouse_systems_automation_hiring: 2 weak_clue"),
    ('{"jobs":[{"title":"Director of Analytics"},{"title":"Data Engineer"},{"title":"Forklift driver"}]}', "data_analytics_ai_hiring: 2 committed_action"),
    ('{"jobs":[]}', None),
    ('{"jobs":[{"title":"BI developer {w}"},{"title":"AI engineer"},{"title":"Data analyst"}]}', "data_analytics_ai_hiring: 3 repeated_pattern"),
])
def pipeline_job_postings(rows):
    """Job boards: one shape, duplicates of title and place once, signals, strength."""
    found = feeds.postings(rows.select(F.col("k").alias("id"), F.lit("greenhouse").alias("board"), "body"), 100)
    first = sequences.first_per_key(found, ["id", F.lower(F.trim("title")), F.lower(F.trim("location"))], "place")
    c = classify_posting(F.col("title"))
    signals = first.select(F.col("id").alias("k"), F.explode(c["signals"]).alias("signal"), "place", "title", c["leadership"].alias("leadership"), "truncated")
    claims = rollups.signal_claims(signals, ["k", "signal"])
    return _joined(claims, F.concat("signal", F.lit(": "), "n", F.lit(" "), "strength"), "signal")


_CDX = '[["original","timestamp","statuscode"]' + ",".join(["", *[f'["/p{i}","2019{i:02d}01000000","200"]' for i in range(1, 10)]])


@pipeline([(_CDX + ',["/live","20240101000000","200"]]', "10 paths, 9 gone, wholesale"), (_CDX + "".join(f',["/l{i}","20240101000000","200"]' for i in range(9)) + "]", "18 paths, 9 gone, clustered"), ('[["original","timestamp","statuscode"],["/a","20190101000000","200"],["/b","20240101000000","200"]]', "2 paths, 1 gone, individual"), ("[]", None)])
def pipeline_archive_removals(rows):
    """Archived captures: the last one of each path, what is gone, and whether it went together."""
    caps = feeds.captures(rows.select(F.col("k").alias("id"), "body"), 1000).where("status = '200'")
    gone = sequences.disappeared_paths(caps, "id", "original", F.substring("timestamp", 1, 4).cast("int"), 2023)
    return gone.select(F.col("id").alias("k"), F.format_string("%d paths, %d gone, %s", "paths", "gone", "pattern").alias("claim"))


def _osha(kind: str, violations: str, name: str = "{w} Works Inc") -> str:
    cells = ["1", "1", '<a href="inspection_detail?id=1">A1</a>', "05/01/2024", "r", "PA", kind, "P", "", "48", violations, name]
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


@pipeline([
    (_osha("Complaint", "3") + _osha("Planned", "") + "#", "2 inspections, 3 violations, 1 escalated, repeated_pattern"),
    ("#" + _osha("Planned", "0"), "1 inspections, 0 violations, 0 escalated, weak_clue"),
    ("did not return any results#did not return any results", "absent_confirmed"),
    (_osha("Planned", "5", "South{w} Works") + "#did not return any results", None),
])
def pipeline_safety_environment(rows):
    """Two name variants in turn, the first that finds anything counts; inspections of the company by its name; absence only if all are empty."""
    tried = rows.select("k", "w", F.posexplode(F.split("body", "#")).alias("n", "html"))
    found = feeds.inspections(tried.select(F.struct("k", "w", "n").alias("id"), "html")).select("id.*", "kind", "violations", "establishment")
    hits = found.groupBy("k", "n").agg(F.count("*").alias("hits"))
    tries = tried.join(hits, ["k", "n"], "left").select("k", "n", F.concat(F.lit("v"), "n").alias("variant"), F.coalesce("hits", F.lit(0)).alias("hits"), (F.col("hits").isNull() & ~F.contains("html", F.lit("did not return")) & (F.col("html") != "")).alias("failed"))
    outcome = rollups.first_variant(tries, "k", "n")
    own = found.where(N.starts_with_name(F.col("establishment"), F.array("w")))
    profile = rollups.inspection_profile(own, "k", F.lit(5))
    seen = profile.select("k", F.format_string("%d inspections, %d violations, %d escalated, %s", "n", "violations", "escalated", "strength").alias("claim"))
    return seen.unionByName(outcome.where("outcome = 'absent_confirmed'").select("k", F.lit("absent_confirmed").alias("claim")))


@pipeline([
    ("<p>{w} sells warehouse robotics</p>#<p>goods-to-person <script>ERP</script>systems</p>", "warehouse_automation: 2 pages"),
    ("<nav>Home</nav><p>{w} and an ERP with zero trust</p>#<p>ransomware</p>", "cybersecurity: 2 pages; erp_core_systems: 1 pages"),
    ("<p>{w} has an API</p>#<p>nothing</p>", None),
])
def pipeline_seller_pages(rows):
    """Pages of a seller: visible text, themes, and on how many pages each is claimed."""
    pages = rows.select("k", F.explode(F.split("body", "#")).alias("html"))
    themes = pages.select("k", F.explode(F.filter(classify(T.visible_text(F.col("html"))), lambda t: t["admitted"])).alias("t")).groupBy("k", F.col("t.theme").alias("theme")).agg(F.count("*").alias("n"))
    return _joined(themes, F.concat("theme", F.lit(": "), "n", F.lit(" pages")), "theme")


@pipeline([("Our Team|Ann Lee|CEO|Bo Ray|President", "Ann Lee=inserted; Bo Ray=unchanged"), ("Bo Ray|CEO", "Bo Ray=updated"), ("Ann Lee|CEO", "Ann Lee=inserted; Bo Ray=superseded"), ("Page not found", None)])
def pipeline_executives(rows):
    """Leadership pages: people by neighbouring lines; who is missing has left only if the page was read with success."""
    lines = rows.select("k", F.posexplode(F.split("body", r"\|")).alias("no", "line"))
    people = O.roster(lines, "k", "no", "line", F.array(F.lit("ACME"))).where("refused = '' AND layout NOT LIKE 'low_grade%'")
    proposed = people.select(F.col("k").alias("company_id"), F.col("name").alias("name_key"), "title")
    stored = rows.select(F.col("k").alias("company_id"), F.lit("Bo Ray").alias("name_key"), F.lit("President").alias("title"), F.lit("active").alias("status"), F.lit(None).cast("string").alias("review_status"))
    actions = merge.sync_executives(stored, proposed, ["title"], proposed.select("company_id").distinct()).where("action != 'kept'").withColumnRenamed("company_id", "k")
    return _joined(actions, F.concat("name_key", F.lit("="), "action"), "name_key")


_SAID = "We moved every order of the company off spreadsheets and into one system of record at last"


@pipeline([
    (f'{{w}} grew. Ann Lee leads it. "{_SAID}," Lee said.', "erp_core_systems: weak_clue"),
    (f'{{w}} grew. Ann Lee leads it. "{_SAID}, and we deployed it in May," Lee said.', "erp_core_systems: committed_action"),
    (f'{{w}} grew. Bob Poe leads it. "{_SAID}," Poe said.', None),
    ('{w} grew. Ann Lee leads it. "It was a very good year for all of us here and for our many friends," Lee said.', None),
])
def pipeline_executive_quotes(rows):
    """Quotes of a known executive on a page, on a theme, with the strength they support."""
    q = worked_out(rows.select("k", "w", "body"), q=P.quotes(F.col("body"), F.lit("Ann Lee"), F.array("w"))).where("size(q) > 0")
    on = worked_out(q.select("k", "q"), on=F.transform("q", lambda x: P.voice_themes(x["body"])))
    rows = on.withColumn("q", F.filter("q", lambda x, i: F.size(F.get("on", i)) > 0)).where("size(q) > 0")
    themes = rows.select("k", F.explode(F.array_distinct(F.flatten("on"))).alias("theme"), P.claim_strength(F.col("q")).alias("strength")).where("theme = 'erp_core_systems'")
    return _joined(themes, F.concat("theme", F.lit(": "), "strength"), "theme")


_ARTICLE = "This paragraph tells how the plant in the north was built over many months, who built it, and what was learned from it all in the end. " * 3


@pipeline([
    (f'<meta name="date" content="2024-05-01"><title>{{w}} goes on</title><p>{{w}} has a new ERP and S/4HANA. {_ARTICLE}</p><p>{_ARTICLE}</p>', "erp_core_systems 2024-05-01"),
    (f'<meta name="date" content="2009-05-01"><title>{{w}}</title><p>{{w}} has a new ERP and S/4HANA. {_ARTICLE}</p><p>{_ARTICLE}</p>', None),
    (f'<meta name="date" content="2024-05-01"><title>Other</title><p>Another firm has a new ERP and S/4HANA. {_ARTICLE}</p><p>{_ARTICLE}</p>', None),
    (f'<meta name="date" content="2024-05-01"><title>{{w}} opens</title><p>{{w}} has a new ERP. {_ARTICLE}</p><p>{_ARTICLE}</p>', None),
    ('<meta name="date" content="2024-05-01"><title>{w} ERP</title><p>{w} has a new ERP.</p>', None),
])
def pipeline_first_party(rows):
    """A company's announcements: dated by markup and within five years, an article, about the company, with a theme as its subject."""
    html, text = F.col("body"), F.array_join("lines", " ")
    dated = worked_out(rows, day=feeds.published_date(html)).where("day >= '2019-06-01'")
    pages = worked_out(dated, title=T.page_title(html), lines=T.block_lines(html)).where((P.article_refusal(F.col("lines"), F.col("title"), F.lit("https://x.com/a")) == "") & N.about_company(text, F.col("w"), F.col("title")))
    hits = pages.select("k", "day", "title", F.explode(F.filter(classify(text), lambda t: t["admitted"])).alias("t")).where(P.is_subject(F.col("t.hits"), F.col("title")))
    return _joined(hits, F.concat("t.theme", F.lit(" "), "day"), "t.theme")


@pipeline([
    ("t|By Ann Poe. {w} deployed a new warehouse management system across nine sites in the state of Ohio last year. Recommended Reading", "warehouse_automation"),
    ("t|/PRNewswire/ {w} deployed a new warehouse management system across nine sites in the state of Ohio last year.", None),
    ("Top 40 firms|{w} deployed a new warehouse management system across nine sites in the state of Ohio last year.", None),
    ("t|{w} deployed telematics in all of its many trucks across nine sites in the state of Ohio last year, it was said.", None),
])
def pipeline_trade_press(rows):
    """Reported actions in articles on one subject that are no reprints, less what the company has claimed itself (telematics)."""
    r = rows.select("k", "w", F.substring_index("body", "|", 1).alias("title"), F.substring_index("body", "|", -1).alias("text"))
    r = r.where((P.reprint(F.col("text"), F.col("title")) == "") & (P.several_subjects(F.col("text"), F.col("title"), F.lit("u")) == ""))
    acts = r.select("k", F.explode(F.filter(P.reported(F.col("text"), F.col("w")), lambda x: x["kind"] == "action")).alias("a"))
    themes = acts.select("k", F.explode(F.filter(classify(F.col("a.sentence")), lambda t: t["admitted"])).alias("t")).select("k", F.col("t.theme").alias("theme")).distinct()
    claimed = rows.select("k", F.lit("transportation_fleet_systems").alias("theme"))
    return _joined(themes.join(claimed, ["k", "theme"], "left_anti"), F.col("theme"), "theme")


def _reviews(name: str, *texts: str) -> str:
    return f'<div itemtype="http://schema.org/Organization"><meta itemprop="name" content="{name}">' + "".join(f'<p itemprop="reviewBody">{t}</p>' for t in texts)


_R1, _R2, _R3 = "Everything here is done on spreadsheets and by hand all day", "The tools are old, all is paper-based and slow to use at work", "Great people and good food in the canteen every single day"


@pipeline([
    (_reviews("{w} Quill", _R1, _R2, _R3, _R3, _R3), "digital_transformation_process: 2 reviews, legacy_constraint"),
    (_reviews("Marl", _R1, _R2, _R3, _R3, _R3), None),
    (_reviews("{w} Quill", _R1, _R2, "short", "short", "short"), None),
    (_reviews("{w} Quill", _R3, _R3, _R3, _R3, _R3), None),
])
def pipeline_employee_reviews(rows):
    """Review pages of the right company with five usable reviews: themes of two reviews or two terms, and the state they tell of."""
    page = worked_out(rows, r=feeds.review_page(F.col("body")))
    r = worked_out(page, own=T.name_tokens(F.concat("w", F.lit(" Quill"))), declared=T.name_tokens(F.col("r.declared_name")), texts=F.filter("r.reviews", lambda x: F.length(x) >= 40)).where("size(texts) >= 5")
    r = worked_out(r.where(overlap_score(F.col("own"), F.col("declared")) >= 0.55), state=P.state_of(F.array_join("texts", " || "), "employee")["state"])
    each = r.select("k", "state", F.explode("texts").alias("text")).select("k", "state", F.explode(P.voice_themes(F.col("text"))).alias("theme"))
    themes = each.groupBy("k", "state", "theme").agg(F.count("*").alias("n")).where("n >= 2")
    return _joined(themes, F.concat("theme", F.lit(": "), "n", F.lit(" reviews, "), "state"), "theme")


@pipeline([
    ('{"count":1,"results":[{"docket_id":1,"caseName":"Cordant Systems v. {w} Inc","suitNature":"Contract","party":["{w} Inc","Cordant Systems, Inc."]}]}', "Cordant Systems, Inc."),
    ('{"count":1,"results":[{"docket_id":1,"caseName":"Poe v. {w} Inc","suitNature":"Contract","party":["{w} Inc","Cordant Systems, Inc."]}]}', None),
    ('{"count":1,"results":[{"docket_id":1,"caseName":"Cordant Systems v. Certified {w}","party":["Certified {w}","Cordant Systems Health Plan"]}]}', None),
    ('{"count":0,"results":[]}', None),
])
def pipeline_litigation(rows):
    """Dockets in which a vendor opposes the company in the caption."""
    found = feeds.dockets(rows.select(F.struct("k", "w").alias("id"), "body"))
    cases = found.where(F.exists("parties", lambda p: N.starts_with_name(p, F.array("id.w")))).select(F.col("id.k").alias("k"), F.col("id.w").alias("company"), F.col("case_name").alias("caption"), "parties", F.col("suit_nature").rlike("(?i)contract").alias("commercial"))
    vendors = rows.sparkSession.createDataFrame([("cordant systems",)], "vendor string")
    return parties.opposing_vendors(cases, vendors, "k").select("k", F.col("party").alias("claim"))


@pipeline([
    ('{"results":[{"recalling_firm":"{w} Inc","reason_for_recall":"A software error stopped it","recall_initiation_date":"20240501"}]}', "digital_transformation_process strong 2024-05-01"),
    ('{"results":[{"recalling_firm":"Certified {w}","reason_for_recall":"A software error stopped it"}]}', None),
    ('{"results":[{"recalling_firm":"{w}","reason_for_recall":"A cracked housing","recall_initiation_date":"20240501"}]}', None),
    ('{"results":[{"recalling_firm":"{w} Co","reason_for_recall":"manufacturing defect","recall_initiation_date":"2024-06-01"}]}', "digital_transformation_process weak_symptom 2024-06-01"),
])
def pipeline_product_quality(rows):
    """Recalls of firms whose name begins with the company's, that blame a process."""
    events = feeds.product_events(rows.select(F.struct("k", "w").alias("id"), F.lit("openfda_device").alias("kind"), "body"))
    own = events.where(N.starts_with_name(F.col("firm"), F.array("id.w"))).select(F.col("id.k").alias("k"), "day", P.process_cause(F.col("reason")).alias("c")).where("c IS NOT NULL")
    return _joined(own, F.concat_ws(" ", "c.theme", "c.tier", "day"), "c.theme")


@pipeline([
    ("A1|{w} HOLDINGS LLC|OH|10#A1|{w} HOLDINGS LLC|OH|10#A2|{w} Inc|OH|5#A3|{w} Hydraulics|OH|7", "2 awards, 15; near misses 1"),
    ("A1|{w} Joint Venture|OH|10", None),
    ("A1|{w} Inc|TX|10", None),
    ("", None),
])
def pipeline_procurement(rows):
    """Awards, once for each id, of recipients that are the company and sit in its state; near misses are counted, not taken."""
    a = rows.select("k", "w", F.explode(F.split("body", "#")).alias("a")).where("a != ''").select("k", "w", F.split("a", r"\|").alias("a"))
    a = a.select("k", "w", *[F.get("a", F.lit(i)).alias(n) for i, n in enumerate(("award", "recipient", "state", "amount"))]).dropDuplicates(["k", "award"])
    reason = N.recipient_match(F.col("w"), F.col("recipient"))
    g = a.withColumn("reason", reason).groupBy("k").agg(F.count_if(F.startswith("reason", F.lit("match")) & (F.col("state") == "OH")).alias("n"), F.sum(F.when(F.startswith("reason", F.lit("match")) & (F.col("state") == "OH"), F.col("amount").cast("int"))).alias("total"), F.count_if(F.col("reason") == "near_miss").alias("near"))
    return g.where("n > 0").select("k", F.format_string("%d awards, %d; near misses %d", "n", "total", "near").alias("claim"))


@pipeline([
    ("<tr><td>{w} Quill dba Other</td><td>x</td><td>2024</td></tr><tr><td>Marl</td><td>x</td><td>2023</td></tr>", "1 notices"),
    ("<tr><td>Kimberly-{w} Corporation</td><td>x</td><td>2024</td></tr>", "absent_confirmed"),
    ('no rows value="term"', "absent_confirmed"),
    ("Service down", None),
])
def pipeline_breach_portals(rows):
    """Notices listed under the company's name; absence only where the list was readable."""
    r = feeds.table_rows(rows, "body", 3, 0, F.lit('value="term"')).withColumn("own", F.coalesce(N.listed_as(F.concat("w", F.lit(" Quill")), F.get("cells", F.lit(0))), F.lit(False)))
    g = r.groupBy("k").agg(F.count_if("own").alias("n"), F.bool_or(F.col("verdict") == "unreadable").alias("unread"))
    return g.where("NOT unread").select("k", F.when(F.col("n") > 0, F.concat("n", F.lit(" notices"))).otherwise("absent_confirmed").alias("claim"))


@pipeline([
    ("<p>{w} of Erie runs analytics and an ERP with the vendor.</p>", "data_analytics_ai; erp_core_systems"),
    ("<p>{w}, a firm in the far north, runs analytics with the vendor.</p>", None),
    ('<p>{w} runs machine learning</p><a href="https://zorworks.com/">site</a>', "data_analytics_ai"),
    ("<p>A customer runs an ERP in Erie.</p>", None),
])
def pipeline_vendor_case_studies(rows):
    """Case studies that name a company of one coined word and carry its city or its site; sentences that name it give the themes."""
    text = T.visible_text(F.col("body"))
    own = rows.where(N.about_company(text, F.col("w")) & (text.rlike(r"(?i)\berie\b") | F.contains(F.lower("body"), F.lit("zorworks.com"))))
    named = own.select("k", "w", F.explode(P.sentences(text)).alias("s")).where(N.about_company(F.col("s"), F.col("w")))
    themes = named.select("k", F.explode(F.filter(classify(F.col("s")), lambda t: t["admitted"])).alias("t")).select("k", F.col("t.theme").alias("theme")).distinct()
    return _joined(themes, F.col("theme"), "theme")


@pipeline([
    ('reporting CIK 000123|{"form":["8-K","8-K/A","10-K"],"filingDate":["2024-02-01","2024-03-01","2024-04-01"],"items":["1.05, 9.01","1.05","1.05"]}', "123: 2 filings, first 2024-02-01"),
    ('reporting CIK 77|{"form":["8-K"],"filingDate":["2023-01-01"],"items":["1.05"]}', "77: absent_confirmed"),
    ('ceased CIK 5|{"form":["8-K"],"filingDate":["2024-01-01"],"items":["1.05"]}', None),
    ('reporting no number|{"form":["8-K"],"filingDate":["2024-01-01"],"items":["1.05"]}', None),
])
def pipeline_sec_8k(rows):
    """Incident filings of the companies that report now, by the number in their status."""
    r = rows.select("k", F.substring_index("body", "|", 1).alias("status"), F.substring_index("body", "|", -1).alias("body")).where("startswith(status, 'reporting')").withColumn("cik", feeds.cik(F.col("status"))).where("cik IS NOT NULL")
    hits = feeds.incident_filings(feeds.columnar_filings(r.select(F.col("k").alias("id"), "body"))).groupBy(F.col("id").alias("k")).agg(F.count("*").alias("n"), F.min("filed").alias("first"))
    claim = F.when(F.col("n") > 0, F.format_string("%s: %d filings, first %s", "cik", "n", "first")).otherwise(F.concat("cik", F.lit(": absent_confirmed")))
    return r.join(hits, "k", "left").select("k", claim.alias("claim"))


@pipeline([
    ("Title|;Company|Received;***MAIN*** {w} Builders NW|2024-01-05;Other|2024-02-02#{w} LLC|CONTRACTOR#boards.greenhouse.io/x", "council 0, permits 1 as contractor, stack greenhouse, warn 1"),
    ("Company|Received;Certified {w}|2024-01-05#{w} Inc|OWNER#plain", "council 0, permits 0 as contractor, stack none, warn 0"),
    ("none#|#x", "council 0, permits 0 as contractor, stack none, warn 0"),
])
def pipeline_local_records(rows):
    """Four signals of one run: notices of a sheet with a header to be found, permits by role, council titles and the page's applicant system."""
    parts = rows.select("k", "w", F.split("body", "#").alias("p"))
    sheet = parts.select("k", F.posexplode(F.split(F.get("p", F.lit(0)), ";")).alias("row_no", "line")).withColumn("cells", F.split("line", r"\|"))
    names = feeds.sniffed(sheet, "k", "row_no", "cells", {"company": ("company", "employer"), "day": ("received", "notice date")}).join(rows.select("k", "w"), "k")
    warn = names.where(N.starts_with_name(N.clean_site(F.col("company"), tuple(T.STATE_CODES), facility=True), F.array("w"))).groupBy("k").agg(F.count("*").alias("warn"))
    permit = F.split(F.get("p", F.lit(1)), r"\|")
    contractor = N.starts_with_name(F.get(permit, F.lit(0)), F.array("w")) & F.contains(F.coalesce(F.get(permit, F.lit(1)), F.lit("")), F.lit("CONTRACTOR"))
    system = F.coalesce(feeds.applicant_system(F.get("p", F.lit(2)))["system"], F.lit("none"))
    out = parts.join(warn, "k", "left")
    return out.select("k", F.format_string("council 0, permits %d as contractor, stack %s, warn %d", contractor.cast("int"), system, F.coalesce("warn", F.lit(0))).alias("claim"))
