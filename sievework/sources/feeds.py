"""Archived responses as rows: nested and columnar JSON, tables and labels in HTML, job boards, archives of captures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import resolve, unescape
from ..functions.text import visible_text

#: How an error record that is served as a success begins; the forms that a filing of an incident has; the day the rule took effect.
ERROR_TITLE = "error"
INCIDENT_FORMS, INCIDENT_ITEM, RULE_EFFECTIVE = ("8-K", "8-K/A"), "1.05", "2023-12-18"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _cells(row: Column, tag: str = "td") -> Column:
    return F.transform(F.regexp_extract_all(row, F.lit(rf"(?is)<{tag}[^>]*>(.*?)</{tag}>"), F.lit(1)), lambda c: visible_text(c))


def table_rows(pages: DataFrame, html: str, least: int, key_cell: int, empty_mark: Column) -> DataFrame:
    """The table rows of each page that have `least` cells and a filled key cell, with a verdict: rows, empty (the page says so) or unreadable.

    A page without rows comes once, with null cells: an unreadable page is no empty result.
    """
    rows = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: _cells(r))
    rows = F.filter(rows, lambda c: (F.size(c) >= least) & (F.get(c, F.lit(key_cell)) != ""))
    verdict = F.when(F.size("rows") > 0, "rows").when(F.contains(html, empty_mark), "empty").otherwise("unreadable")
    return pages.withColumn("rows", rows).withColumn("verdict", verdict).withColumn("cells", F.explode_outer("rows")).drop("rows")


def labelled(lines: Column, label: str, offset: int = 1) -> Column:
    """The line after a label; null if the label isn't there."""
    at = F.array_position(lines, label)
    return F.when(at > 0, F.get(lines, (at - 1 + offset).cast("int")))


def case_blocks(pages: DataFrame, key: str, lines: str, anchor: str, labels: dict[str, str], back: int = 16, ahead: int = 14) -> DataFrame:
    """A record for each anchor line: the value behind it, the nearest line before that is no label, and the values of labels soon after."""
    at = F.filter(F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.when(F.get(lines, i) == anchor, i)), lambda i: i.isNotNull() & (i + 1 < F.size(lines)))
    rows = pages.withColumn("_at", F.explode(at))
    before = F.reverse(F.slice(lines, F.greatest(F.lit(1), F.col("_at") - back + 2), F.least(F.col("_at"), F.lit(back - 1))))
    name = F.get(F.filter(before, lambda x: ~F.endswith(x, F.lit(":"))), F.lit(0))
    block = F.slice(lines, F.col("_at") + 1, ahead + 1)
    values = [F.coalesce(F.when(F.array_position(block, label).between(1, ahead), labelled(block, label)), F.lit("")).alias(column) for column, label in labels.items()]
    return rows.select(key, F.get(lines, F.col("_at") + 1).alias("case_number"), F.coalesce(name, F.lit("")).alias("party"), *values)


def iso_day(value: Column) -> Column:
    """yyyyMMdd or yyyy-MM-dd as an ISO day; blank for anything else."""
    text = F.trim(_text(value))
    return F.when(text.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).otherwise("")


def product_events(payloads: DataFrame) -> DataFrame:
    """(id, kind, firm, day, reason, identifier) of five product feeds. payloads has id, kind and body.

    A record that says error in its title fails the job: a server's failure is no clean record.
    """
    firm = "results array<struct<recalling_firm:string,manufacturer_name:string,device:array<struct<manufacturer_d_name:string>>,reason_for_recall:string,root_cause_description:string,product_description:string,"
    fda = firm + "mdr_text:array<struct<text:string>>,event_date_initiated:string,recall_initiation_date:string,date_received:string,recall_number:string,res_event_number:string,report_number:string>>"
    opened = payloads.where("startswith(kind, 'openfda')").select("id", "kind", F.explode(F.from_json("body", fda)["results"]).alias("r"))
    told = F.array_join(F.transform("r.mdr_text", lambda t: t["text"]), " ")
    reason = F.coalesce("r.reason_for_recall", "r.root_cause_description", "r.product_description", F.lit(""))
    reason = F.when((F.col("kind") == "openfda_device_event") & (F.coalesce(told, F.lit("")) != ""), told).otherwise(reason)
    device = F.get("r.device", F.lit(0))["manufacturer_d_name"]
    fda_rows = opened.select(
        "id", "kind", F.coalesce("r.recalling_firm", device, "r.manufacturer_name", F.lit("")).alias("firm"),
        iso_day(F.coalesce("r.event_date_initiated", "r.recall_initiation_date", "r.date_received")).alias("day"), reason.alias("reason"),
        F.coalesce("r.recall_number", "r.res_event_number", "r.report_number", F.lit("")).alias("identifier"),
    )
    named = "array<struct<Name:string>>"
    cpsc = f"array<struct<Title:string,Manufacturers:{named},Importers:{named},RecallDate:string,Description:string,Hazards:{named},Remedies:{named},RecallNumber:string,RecallID:bigint>>"
    one = payloads.where("kind = 'cpsc_recall'").select("id", "kind", F.explode(F.from_json("body", cpsc)).alias("r"))
    one = one.where(F.when(F.startswith(F.lower("r.Title"), F.lit(ERROR_TITLE)), F.raise_error(F.concat(F.lit("error record: "), "r.Title")).isNull()).otherwise(True))
    names = lambda c, by: F.array_join(F.transform(c, lambda x: x["Name"]), by)
    blank = lambda c: F.nullif(c, F.lit(""))
    cpsc_rows = one.select(
        "id", "kind", F.coalesce(blank(names("r.Manufacturers", ", ")), blank(names("r.Importers", ", ")), "r.Title", F.lit("")).alias("firm"),
        F.substring(_text(F.col("r.RecallDate")), 1, 10).alias("day"),
        F.concat_ws(" ", blank(F.col("r.Description")), blank(names("r.Hazards", " ")), blank(names("r.Remedies", " "))).alias("reason"),
        F.coalesce("r.RecallNumber", F.col("r.RecallID").cast("string"), F.lit("")).alias("identifier"),
    )
    nhtsa = "results array<struct<Manufacturer:string,Component:string,NHTSACampaignNumber:string>>"
    two = payloads.where("kind = 'nhtsa_recall'").select("id", "kind", F.explode(F.from_json("body", nhtsa)["results"]).alias("r"))
    nhtsa_rows = two.select("id", "kind", _text(F.col("r.Manufacturer")).alias("firm"), F.lit("").alias("day"), _text(F.col("r.Component")).alias("reason"), _text(F.col("r.NHTSACampaignNumber")).alias("identifier"))
    return fda_rows.unionByName(cpsc_rows).unionByName(nhtsa_rows)


def dockets(payloads: DataFrame) -> DataFrame:
    """(id, docket_id, case_name, filed, suit_nature, parties, documents, reported): dockets of a search page, with the source's own total."""
    schema = "count bigint, results array<struct<docket_id:bigint,caseName:string,dateFiled:string,suitNature:string,party:array<string>,recap_documents:array<struct<description:string>>>>"
    rows = payloads.withColumn("p", F.from_json("body", schema)).select("id", F.coalesce("p.count", F.lit(0)).alias("reported"), F.explode("p.results").alias("r"))
    texts = F.filter(F.transform(F.slice("r.recap_documents", 1, 8), lambda d: F.trim(_text(d["description"]))), lambda x: x != "")
    return rows.select(
        "id", "r.docket_id", F.trim(_text(F.col("r.caseName"))).alias("case_name"), F.substring(_text(F.col("r.dateFiled")), 1, 10).alias("filed"), F.trim(_text(F.col("r.suitNature"))).alias("suit_nature"),
        F.filter(F.coalesce("r.party", F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit("")) != "").alias("parties"), F.coalesce(texts, F.array().cast("array<string>")).alias("documents"), "reported",
    )


def columnar_filings(payloads: DataFrame) -> DataFrame:
    """(id, form, filed, items, accession) of parallel arrays; an array that is missing or short gives nulls."""
    schema = "form array<string>, filingDate array<string>, items array<string>, accessionNumber array<string>"
    p = F.from_json("body", schema)
    some = lambda c: F.coalesce(p[c], F.array().cast("array<string>"))
    zipped = F.arrays_zip(some("form").alias("form"), some("filingDate").alias("filed"), some("items").alias("items"), some("accessionNumber").alias("accession"))
    return payloads.select("id", F.explode(F.slice(zipped, 1, F.greatest(F.size(some("form")), F.lit(0)))).alias("f")).select("id", "f.*")


def incident_filings(filings: DataFrame, item: str = INCIDENT_ITEM, since: str = RULE_EFFECTIVE) -> DataFrame:
    """Filings whose list of items holds the exact code."""
    return filings.where(F.col("form").isin(*INCIDENT_FORMS) & (F.coalesce("filed", F.lit("")) >= since) & F.array_contains(F.transform(F.split(_text(F.col("items")), ","), lambda x: F.trim(x)), item))


def cik(reference: Column) -> Column:
    return F.nullif(F.regexp_extract(_text(reference), r"(?i)\bCIK\s*0*(\d{1,10})\b", 1), F.lit(""))


def captures(payloads: DataFrame, limit: int) -> DataFrame:
    """(id, timestamp, original, status, day, archive_url, truncated) of arrays whose first row names the columns, in any order."""
    rows = payloads.withColumn("a", F.from_json("body", "array<array<string>>")).where("size(a) > 0")
    head = F.get("a", F.lit(0))
    rows = rows.select("id", head.alias("head"), (F.size("a") - 1 >= limit).alias("truncated"), F.explode(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0)))).alias("r"))
    value = lambda n: F.coalesce(F.when(F.array_position("head", n) > 0, F.get("r", (F.array_position("head", n) - 1).cast("int"))), F.lit(""))
    out = rows.select("id", value("timestamp").alias("timestamp"), value("original").alias("original"), value("statuscode").alias("status"), "truncated").where("timestamp != ''")
    day = F.concat_ws("-", F.substring("timestamp", 1, 4), F.substring("timestamp", 5, 2), F.substring("timestamp", 7, 2))
    return out.withColumns({"day": day, "archive_url": F.concat(F.lit("https://web.archive.org/web/"), "timestamp", F.lit("/"), "original")})


def search_results(payloads: DataFrame) -> DataFrame:
    """(id, rank, title, url, description, age); marks are taken out of the texts, results without url are dropped."""
    schema = "web struct<results:array<struct<title:string,url:string,description:string,age:string,page_age:string>>>"
    rows = payloads.select("id", F.posexplode(F.from_json("body", schema)["web"]["results"]).alias("rank", "r")).where("coalesce(r.url, '') != ''")
    plain = lambda c: F.trim(F.regexp_replace(unescape(F.regexp_replace(_text(F.col(c)), "<[^>]+>", "")), r"\s+", " "))
    return rows.select("id", "rank", plain("r.title").alias("title"), "r.url", plain("r.description").alias("description"), F.coalesce(F.nullif("r.age", F.lit("")), "r.page_age", F.lit("")).alias("age"))


#: Per job board: the schema of a page, the list of jobs, and where each field is.
BOARDS = {
    "greenhouse": ("jobs array<struct<title:string,location:struct<name:string>,updated_at:string,absolute_url:string,id:bigint>>", "jobs", ("title", "location.name", "updated_at", "absolute_url", "id")),
    "lever": ("postings array<struct<text:string,categories:struct<location:string>,createdAt:string,hostedUrl:string,id:string>>", "postings", ("text", "categories.location", "createdAt", "hostedUrl", "id")),
    "workday": ("jobPostings array<struct<title:string,locationsText:string,postedOn:string,externalPath:string,bulletFields:array<string>>>, total bigint", "jobPostings", ("title", "locationsText", "postedOn", "externalPath", "bulletFields[0]")),
    "adp": ("jobRequisitions array<struct<requisitionTitle:string,requisitionLocations:array<struct<nameCode:struct<shortName:string>>>,postDate:string,itemID:string>>, meta struct<totalNumber:bigint>", "jobRequisitions", ("requisitionTitle", "requisitionLocations[0].nameCode.shortName", "postDate", "itemID", "itemID")),
}


# How anchors of postings look on boards made of markup, labels that a board sets before titles, and what a careers page's own list must be.
ICIMS_ANCHOR = r"""(?s)<a[^>]+href="(https://[^"]*?/jobs/(\d+)/[^"]+)"[^>]*>(.*?)</a>"""
ICIMS_LABEL = r"(?i)^\s*(external\s+job|requisition|job|position)?\s*title\b\s*"
PAYLOCITY_LINK = r"recruiting\.paylocity\.com/Recruiting/Jobs/Details/(\d+)"
INLINE_MIN = 3
INLINE_ANCHOR = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
INLINE_HREF = r"""(?i)(/jobs?/[^/"']+|/careers?/[^/"']{4,}|/positions?/|/openings?/|/opportunit|[?&](?:job|jobid|req|posting)=|/job-|/employment/[^/"']{4,})"""
INLINE_NAV = (
    r"(?i)^(careers?|jobs?|home|about|contact|apply now|view all|search (?:jobs|roles|careers)|open positions|join (?:our|the) team|benefits|benefits (?:and|&) perks|internships?|"
    r"culture|why [a-z .&]+|learn more|read more|apply|details|see all jobs|explore (?:paths|open positions)|locations|life at [a-z .&]+|our culture|key roles|"
    r"early career professionals|experienced professionals|veterans|training|opportunities|career opportunities|recent graduates|student program)$"
)
INLINE_ROLE = (
    r"(?i)\b(manager|engineer|technician|specialist|driver|analyst|director|supervisor|coordinator|associate|clerk|operator|mechanic|superintendent|estimator|accountant|"
    r"developer|architect|planner|scheduler|foreman|electrician|welder|nurse|representative|lead|intern|administrator|assistant|dispatcher|controller|buyer|"
    r"inspector|laborer|apprentice|officer|recruiter|designer|scientist|programmer)\b"
)
INLINE_QUALIFIER = r"[,|()\-–/]|\d"
INLINE_LEADING_NAV = r"(?i)^(learn more|join|all |view|see |information|why |our |about|meet |explore|search)"
INLINE_FILE = r"(?i)\.(pdf|jpe?g|png|docx?)$"

_JOB = "struct<title:string,location:string,posted:string,url:string,job_id:string>"


def _job(title: Column, url: Column, job_id: Column) -> Column:
    blank = F.lit("")
    return F.struct(title.alias("title"), blank.alias("location"), blank.alias("posted"), url.alias("url"), job_id.alias("job_id"))


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _first_by(jobs: Column, field: str) -> Column:
    """The first job of each value of a field."""
    return F.get(F.transform(F.array(jobs), lambda js: F.filter(js, lambda j, i: ~F.exists(F.slice(js, 1, i), lambda k: k[field] == j[field]))), F.lit(0))


def icims_jobs(page: Column) -> Column:
    """The postings of a results page, one for each number, without the label of the column that stands before a title."""
    anchors = F.regexp_extract_all(page, F.lit(ICIMS_ANCHOR), F.lit(0))
    part = lambda a, g: F.regexp_extract(a, ICIMS_ANCHOR, g)
    title = lambda a: _squeezed(F.regexp_replace(unescape(F.regexp_replace(part(a, 3), "<[^>]+>", " ")), ICIMS_LABEL, ""))
    jobs = F.transform(anchors, lambda a: _job(title(a), F.substring_index(part(a, 1), "?", 1), part(a, 2)))
    return _first_by(F.filter(jobs, lambda j: j["title"] != ""), "job_id")


def paylocity_jobs(archive: Column) -> Column:
    """The postings that a careers page links to, by the pages archived of them: JSON of the page and of a map from number to page. One that is gone is left out."""
    a = F.from_json(archive, "careers string, details map<string,string>")
    ids = F.array_distinct(F.regexp_extract_all(a["careers"], F.lit(PAYLOCITY_LINK), F.lit(1)))

    def one(i):
        page = F.coalesce(F.try_element_at(a["details"], i), F.lit(""))
        named = F.trim(unescape(F.regexp_extract(page, r'"jobTitle"\s*:\s*"([^"]+)"', 1)))
        headed = F.regexp_replace(F.trim(unescape(F.regexp_replace(F.regexp_extract(page, r"(?s)<title>(.*?)</title>", 1), "<[^>]+>", ""))), r"^[^-]*-\s*", "")
        return _job(F.when(named != "", named).otherwise(headed), F.concat(F.lit("https://recruiting.paylocity.com/Recruiting/Jobs/Details/"), i), i)

    return F.filter(F.transform(ids, one), lambda j: (j["title"] != "") & ~F.startswith(F.lower(j["title"]), F.lit("job not found")))


def inline_jobs(page: Column, base: Column) -> Column:
    """The postings that a careers page lists itself: three different addresses or more of job-like anchors, half of them at least with a place or level; else none, as it is navigation."""
    anchors = F.transform(F.regexp_extract_all(page, F.lit(INLINE_ANCHOR), F.lit(0)), lambda a: F.struct(
        F.regexp_extract(a, INLINE_ANCHOR, 1).alias("href"), _squeezed(unescape(F.regexp_replace(F.regexp_extract(a, INLINE_ANCHOR, 2), "<[^>]+>", " "))).alias("text"),
    ))
    job_like = lambda a: (
        a["href"].rlike(INLINE_HREF) & F.length(a["text"]).between(8, 90) & ~a["text"].rlike(INLINE_NAV) & ~a["text"].rlike(INLINE_LEADING_NAV)
        & F.contains(a["text"], F.lit(" ")) & a["text"].rlike(INLINE_ROLE) & ~a["href"].rlike(INLINE_FILE)
    )
    url = lambda a: F.substring_index(resolve(base, a["href"]), "?", 1)
    jobs = _first_by(F.transform(F.filter(anchors, job_like), lambda a: _job(a["text"], url(a), F.substring(F.substring_index(url(a), "/", -1), 1, 40))), "url")
    qualified = lambda js: F.size(F.filter(js, lambda j: j["title"].rlike(INLINE_QUALIFIER)))
    listed = lambda js: F.when((F.size(js) >= INLINE_MIN) & (qualified(js) * 2 >= F.size(js)), js).otherwise(F.array().cast(f"array<{_JOB}>"))
    return F.get(F.transform(F.array(jobs), listed), F.lit(0))


def postings(payloads: DataFrame, limit: int) -> DataFrame:
    """(id, board, place, title, location, posted, url, job_id, truncated): one shape of all seven boards. payloads has id, board, body and, for lists on a company's own page, its url."""
    parts = []
    for board, (schema, jobs, fields) in BOARDS.items():
        page = payloads.where(F.col("board") == board).withColumn("p", F.from_json("body", schema))
        total = F.coalesce("p.total", F.size(f"p.{jobs}")) if "total bigint" in schema else F.coalesce("p.meta.totalNumber", F.size(f"p.{jobs}")) if "meta" in schema else F.size(f"p.{jobs}")
        rows = page.select("id", "board", (total > limit).alias("truncated"), F.posexplode(F.slice(F.col(f"p.{jobs}"), 1, limit)).alias("place", "j"))
        title, location, posted, url, job = (F.trim(_text(F.expr(f"j.{f}"))) for f in fields)
        parts.append(rows.select("id", "board", "place", title.alias("title"), location.alias("location"), F.substring(posted, 1, 10).alias("posted"), url.alias("url"), job.alias("job_id"), "truncated"))
    base = F.col("url") if "url" in payloads.columns else F.lit("")
    for board, found in (("icims", icims_jobs(F.col("body"))), ("paylocity", paylocity_jobs(F.col("body"))), ("inline", inline_jobs(F.col("body"), base))):
        page = payloads.where(F.col("board") == board).withColumn("js", found)
        rows = page.select("id", "board", (F.size("js") > limit).alias("truncated"), F.posexplode(F.slice("js", 1, limit)).alias("place", "j"))
        parts.append(rows.select("id", "board", "place", "j.title", "j.location", "j.posted", "j.url", "j.job_id", "truncated"))
    return reduce(DataFrame.unionByName, parts)


def inspections(pages: DataFrame, html: str = "html") -> DataFrame:
    """(id, activity, opened, kind, violations, establishment, parsed): rows with a detail link; a row with too few cells is kept as not parsed.

    An unreadable count of violations is unknown, not 0.
    """
    rows = F.filter(F.regexp_extract_all(html, F.lit(r"(?s)<tr>(.*?)</tr>"), F.lit(1)), lambda r: F.contains(r, F.lit("inspection_detail?id=")))
    out = pages.select("id", F.explode(F.transform(rows, lambda r: _cells(r))).alias("c")).withColumn("parsed", F.size("c") >= 12)
    cell = lambda k: F.when(F.col("parsed"), F.get("c", F.lit(k)))
    return out.select("id", cell(2).alias("activity"), cell(3).alias("opened"), cell(6).alias("kind"), F.when(cell(10).rlike("^[0-9]+$"), cell(10).cast("int")).alias("violations"), cell(11).alias("establishment"), "parsed")


def carrier_snapshot(pages: DataFrame, lines: str = "lines") -> DataFrame:
    """The fields of a registry page made of labels and values, in the names of the JSON feed."""
    number = lambda label: F.regexp_replace(labelled(F.col(lines), label), ",", "").try_cast("int")
    value = lambda label: labelled(F.col(lines), label)
    status = value("Operating Authority Status:")
    dba = value("DBA Name:")
    return pages.select(
        "id", value("USDOT Number:").alias("dot_number"), value("Legal Name:").alias("legal_name"), F.when(dba != "Physical Address:", dba).alias("dba_name"),
        F.when(status == "AUTHORIZED FOR:", "AUTHORIZED").otherwise(status).alias("authority"), F.when(status == "AUTHORIZED FOR:", value("AUTHORIZED FOR:")).alias("authorized_for"),
        number("Power Units:").alias("power_units"), number("Drivers:").alias("drivers"),
        F.regexp_replace(F.nullif(F.regexp_extract(_text(value("MCS-150 Mileage (Year):")), r"^([\d,]+)\s*\(\d{4}\)", 1), F.lit("")), ",", "").cast("long").alias("mileage"),
    ).where("dot_number IS NOT NULL")


def carrier_json(payloads: DataFrame) -> DataFrame:
    """The same fields from the JSON feed."""
    schema = "content struct<carrier:struct<dotNumber:bigint,legalName:string,dbaName:string,allowedToOperate:string,commonAuthorityStatus:string,totalPowerUnits:int,totalDrivers:int,mcs150Mileage:bigint>>"
    c = payloads.select("id", F.from_json("body", schema)["content"]["carrier"].alias("c")).where("c.dotNumber IS NOT NULL")
    granted = F.col("c.commonAuthorityStatus") == "A"
    return c.select(
        "id", F.col("c.dotNumber").cast("string").alias("dot_number"), F.col("c.legalName").alias("legal_name"), F.nullif("c.dbaName", F.lit("")).alias("dba_name"),
        F.when(granted, "AUTHORIZED").otherwise("NOT AUTHORIZED").alias("authority"), F.when(granted, "Common").alias("authorized_for"), F.col("c.totalPowerUnits").alias("power_units"), F.col("c.totalDrivers").alias("drivers"), F.col("c.mcs150Mileage").alias("mileage"),
    )


def aliases(rows: DataFrame, column: str) -> DataFrame:
    """(company_id, variant) of a registry that is one JSON object; keys that begin with an underscore are comments."""
    schema = "map<string,struct<name_variants:array<string>,not_variants:array<string>>>"
    return rows.select(F.explode(F.from_json(column, schema)).alias("company_id", "e")).where("NOT startswith(company_id, '_')").select("company_id", F.explode("e.name_variants").alias("variant"))


def sniffed(rows: DataFrame, key: str, row_no: str, cells: str, synonyms: dict[str, tuple[str, ...]], within: int = 6) -> DataFrame:
    """Rows of a sheet under the first of its first `within` rows that names two of the wanted columns or more; columns by any of their synonyms.

    rows has key, row_no (from 0) and cells (array). A sheet without such a row gives nothing.
    """
    low = F.transform(cells, lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    hits = sum((F.arrays_overlap(low, F.array(*map(F.lit, names))).cast("int") for names in synonyms.values()), F.lit(0))
    heads = rows.where((F.col(row_no) < within) & (hits >= 2)).groupBy(key).agg(F.min_by(F.struct(F.col(row_no).alias("at"), low.alias("names")), row_no).alias("head"))
    out = rows.join(heads, key).where(F.col(row_no) > F.col("head.at"))
    pick = lambda names: F.coalesce(*[F.when(F.array_position("head.names", n) > 0, F.nullif(F.trim(F.get(cells, (F.array_position("head.names", n) - 1).cast("int"))), F.lit(""))) for n in names])
    return out.select(key, row_no, *[pick(names).alias(column) for column, names in synonyms.items()])


#: Where markup states a date of publication, the most trustworthy place first.
DATE_PATTERNS = (
    r'(?i)"datePublished"\s*:\s*"([^"]{8,40})"',
    r"""(?i)property=["']article:published_time["']\s+content=["']([^"']+)""",
    r"""(?i)content=["']([^"']+)["']\s+property=["']article:published_time["']""",
    r"""(?i)name=["'](?:pubdate|publish-date|date)["']\s+content=["']([^"']+)""",
    r"""(?i)<time[^>]+datetime=["']([^"']+)""",
)


def published_date(html: Column) -> Column:
    """The ISO date that a page's markup states, in this order: JSON-LD, article:published_time (either order of attributes), a date meta, a time element; blank if none."""
    day = lambda x: F.try_to_timestamp(F.nullif(F.regexp_extract(x, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date").cast("string")
    first = [F.get(F.filter(F.transform(F.regexp_extract_all(html, F.lit(p), F.lit(1)), day), lambda d: d.isNotNull()), F.lit(0)) for p in DATE_PATTERNS]
    return F.coalesce(*first, F.lit(""))


def review_page(html: Column) -> Column:
    """Struct of a page's microdata: declared name, rating, review count and the texts of its reviews."""
    meta = lambda prop: F.trim(F.regexp_extract(html, rf'itemprop="{prop}"\s+content="([^"]*)"', 1))
    name = F.trim(F.regexp_extract(html, r'itemtype="[^"]*schema\.org/Organization"[^>]*>\s*<meta\s+itemprop="name"\s+content="([^"]*)"', 1))
    texts = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r'(?s)itemprop="reviewBody"[^>]*>(.*?)</'), F.lit(1)), lambda x: visible_text(x)), lambda x: x != "")
    return F.struct(name.alias("declared_name"), meta("ratingValue").alias("rating"), meta("reviewCount").alias("review_count"), texts.alias("reviews"))


#: Hosts of applicant systems, in the order they are looked for, with the part that names the tenant; and the systems whose postings can be read.
ATS_FINGERPRINTS = (
    ("workday", r"([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com"),
    ("icims", r"(?<![a-z0-9.-])(?!login\.|www\.|secure\.)([a-z0-9-]+)\.icims\.com"),
    ("paylocity", r"recruiting\.paylocity\.com"),
    ("greenhouse", r"(?:boards|job-boards)(?:-api)?\.greenhouse\.io/(?:embed/job_board\?for=)?([a-z0-9_-]+)"),
    ("lever", r"jobs\.lever\.co/([a-z0-9_-]+)"),
    ("smartrecruiters", r"careers\.smartrecruiters\.com/([a-zA-Z0-9_-]+)"),
    ("jobvite", r"jobs\.jobvite\.com/([a-z0-9_-]+)"),
    ("ultipro", r"([a-z0-9-]+)\.(?:recruiting\d*\.)?ultipro\.com"),
    ("adp", r"workforcenow\.adp\.com/[^\"'\s]*?cid=([0-9a-f]{8}-[0-9a-f-]{27})"),
    ("adp", r"(?:workforcenow|recruiting)\.adp\.com"),
    ("paycom", r"paycomonline\.net"),
    ("dayforce", r"([a-z0-9-]+)\.dayforcehcm\.com"),
    ("taleo", r"([a-z0-9-]+)\.taleo\.net"),
    ("brassring", r"([a-z0-9-]+)\.brassring\.com"),
    ("jazzhr", r"([a-z0-9-]+)\.applytojob\.com"),
    ("bamboohr", r"([a-z0-9-]+)\.bamboohr\.com"),
    ("applicantpro", r"([a-z0-9-]+)\.applicantpro\.com"),
    ("isolved", r"([a-z0-9-]+)\.isolvedhire\.com"),
    ("clearcompany", r"([a-z0-9-]+)\.clearcompany\.com"),
    ("tenstreet", r"(?:tenstreet\.com|intelliapp\.driverapponline\.com)"),
    ("driverreach", r"([a-z0-9-]+)\.driverreach\.com"),
)
READABLE_ATS = ("workday", "icims", "paylocity", "greenhouse", "lever", "adp", "inline")


def applicant_system(html: Column) -> Column:
    """Struct (system, tenant, readable) of the first applicant system whose host a page names; null if none. A product's name alone is no host."""
    entry = lambda name, rx: F.struct(F.lit(name).alias("system"), (F.regexp_extract(html, f"(?i){rx}", 1) if "([" in rx else F.lit("")).alias("tenant"), F.lit(name in READABLE_ATS).alias("readable"))
    return F.coalesce(*[F.when(html.rlike(f"(?i){rx}"), entry(name, rx)) for name, rx in ATS_FINGERPRINTS])
