"""Queries over archived responses. The bodies are put together from the driver's tables; the other engine answers from those tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.sequences import first_per_key
from ..sources import feeds
from .standin import standin

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_LISTS = """SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN '<p>No results. value="term"</p>' WHEN 1 THEN '<p>Service down</p>' ELSE concat('<table><tr><th>Org</th></tr><tr class="x"><td> <b>', s_name,
 '</b> </td><td>2024-01-', 10 + s_suppkey % 20, '</td><td>May &amp; June</td></tr><tr><td></td><td>x</td><td>y</td></tr><TR><td>Second</td><td>b</td><td>c</td><td>d</td></TR><tr><td>Short</td></tr></table>') END AS html FROM supplier"""


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'empty' WHEN 1 THEN 'unreadable' ELSE 'rows' END AS verdict, o AS org, r AS reported FROM supplier
 LEFT JOIN (VALUES (1), (2)) v(n) ON s_suppkey % 4 > 1, LATERAL (SELECT CASE n WHEN 1 THEN s_name WHEN 2 THEN 'Second' END AS o, CASE n WHEN 1 THEN 'May & June' WHEN 2 THEN 'c' END AS r)""")
def table_rows_from_html(spark, sf):
    standin(spark, sf)
    rows = feeds.table_rows(spark.sql(_LISTS), "html", 3, 0, F.lit('value="term"'))
    return rows.select("id", "verdict", F.get("cells", F.lit(0)).alias("org"), F.get("cells", F.lit(2)).alias("reported"))


_BLOCKS = """SELECT s_suppkey AS id, concat('Next:|', s_name, '|Sort:|Case Number:|07-', s_suppkey, '|Date Filed:|5/1/2024|', CASE WHEN s_suppkey % 2 = 0 THEN 'Status:|Open|' ELSE '' END, 'Other ', s_nationkey, '|Location:|Case Number:|08-', s_suppkey, '|Location:|Erie, PA|Case Number:') AS body FROM supplier"""


@query("""SELECT s_suppkey AS id, concat('07-', s_suppkey) AS case_number, s_name AS party, '5/1/2024' AS filed, CASE WHEN s_suppkey % 2 = 0 THEN 'Open' ELSE '' END AS status, 'Case Number:' AS location FROM supplier
UNION ALL SELECT s_suppkey, concat('08-', s_suppkey), concat('Other ', s_nationkey), '', '', 'Erie, PA' FROM supplier""")
def label_lines(spark, sf):
    """Case records of a page of lines, each found by its label; the party has none and stands before it."""
    standin(spark, sf)
    pages = spark.sql(_BLOCKS).select("id", F.split("body", r"\|").alias("lines"))
    return feeds.case_blocks(pages, "id", "lines", "Case Number:", {"filed": "Date Filed:", "status": "Status:", "location": "Location:"})


_PRODUCTS = """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'openfda_device_event' WHEN 1 THEN 'openfda_food' WHEN 2 THEN 'cpsc_recall' WHEN 3 THEN 'nhtsa_recall' ELSE 'openfda_drug' END AS kind,
 CASE o_orderkey % 5 WHEN 0 THEN concat('{"results":[{"device":[{"manufacturer_d_name":"M', o_custkey, '"}],"mdr_text":[{"text":"one"},{"text":"two ', o_orderkey, '"}],"date_received":"20240', 1 + o_orderkey % 9, '15","report_number":"R', o_orderkey, '"}]}')
 WHEN 1 THEN concat('{"results":[{"recalling_firm":"F', o_custkey, '","reason_for_recall":"label","recall_initiation_date":"2024-05-01","recall_number":"N1"},{"recalling_firm":"G","product_description":"box","event_date_initiated":"May 2024"}]}')
 WHEN 2 THEN concat('[{"Title":"T', o_orderkey, ' Recalls","Manufacturers":[', CASE WHEN o_orderkey % 2 = 0 THEN '{"Name":"A"},{"Name":"B"}' ELSE '' END, '],"Importers":[', CASE WHEN o_orderkey % 3 = 0 THEN '{"Name":"I"}' ELSE '' END, '],"RecallDate":"2024-06-07T00:00:00","Description":"fire","Hazards":[{"Name":"burn"}],"RecallID":', o_orderkey, '}]')
 WHEN 3 THEN concat('{"results":[{"Manufacturer":"N', o_custkey, '","Component":"brakes","NHTSACampaignNumber":"24V', o_orderkey, '"}]}') ELSE '{"results":[{"manufacturer_name":"H","root_cause_description":"cause","res_event_number":"E"}]}' END AS body FROM orders"""


@query("""WITH o AS (SELECT *, o_orderkey AS id FROM orders)
SELECT id, 'openfda_device_event' AS kind, concat('M', o_custkey) AS firm, concat('2024-0', 1 + id % 9, '-15') AS day, concat('one two ', id) AS reason, concat('R', id) AS identifier FROM o WHERE id % 5 = 0
UNION ALL SELECT id, 'openfda_food', concat('F', o_custkey), '2024-05-01', 'label', 'N1' FROM o WHERE id % 5 = 1 UNION ALL SELECT id, 'openfda_food', 'G', '', 'box', '' FROM o WHERE id % 5 = 1
UNION ALL SELECT id, 'cpsc_recall', CASE WHEN id % 2 = 0 THEN 'A, B' WHEN id % 3 = 0 THEN 'I' ELSE concat('T', id, ' Recalls') END, '2024-06-07', 'fire burn', CAST(id AS STRING) FROM o WHERE id % 5 = 2
UNION ALL SELECT id, 'nhtsa_recall', concat('N', o_custkey), '', 'brakes', concat('24V', id) FROM o WHERE id % 5 = 3 UNION ALL SELECT id, 'openfda_drug', 'H', '', 'cause', 'E' FROM o WHERE id % 5 = 4""")
def voice_union(spark, sf):
    """Five nested product feeds as one table of events."""
    standin(spark, sf)
    return feeds.product_events(spark.sql(_PRODUCTS))


_DOCKETS = """SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 9 THEN '{"count": 0, "results": []}' ELSE concat('{"count": ', c_custkey, ', "results": [{"docket_id": ', c_custkey * 2, ', "caseName": " A v. B ", "dateFiled": "2024-01-02T00:00:00", "party": ["A", "", null, "', c_name, '"], "recap_documents": [{"description": "order"}, {"description": " "}, {}]}, {"docket_id": 1, "suitNature": "Contract"}]}') END AS body FROM customer"""


@query("""SELECT c_custkey AS id, c_custkey * 2 AS docket_id, 'A v. B' AS case_name, '2024-01-02' AS filed, '' AS suit_nature, concat('A;', c_name) AS parties, 'order' AS documents, c_custkey AS reported FROM customer WHERE c_custkey % 10 <> 9
UNION ALL SELECT c_custkey, 1, '', '', 'Contract', '', '', c_custkey FROM customer WHERE c_custkey % 10 <> 9""")
def docket_rows(spark, sf):
    standin(spark, sf)
    rows = feeds.dockets(spark.sql(_DOCKETS))
    return rows.select("id", "docket_id", "case_name", "filed", "suit_nature", F.array_join("parties", ";").alias("parties"), F.array_join("documents", ";").alias("documents"), "reported")


_FILINGS = """SELECT c_custkey AS id, concat('{"form":["8-K","10-K","8-K/A"],"filingDate":["2024-0', 1 + c_custkey % 9, '-01","2024-02-02","2023-12-', 10 + c_custkey % 19, '"],"items":["', CASE c_custkey % 3 WHEN 0 THEN '1.01, 1.05' WHEN 1 THEN '11.05' ELSE '1.05,9.01' END, '","","1.05"]', CASE WHEN c_custkey % 2 = 0 THEN ',"accessionNumber":["a1","a2"]' ELSE '' END, '}') AS body FROM customer"""


@query("""WITH c AS (SELECT c_custkey AS id FROM customer) SELECT id, '8-K' AS form, concat('2024-0', 1 + id % 9, '-01') AS filed, CASE id % 3 WHEN 0 THEN '1.01, 1.05' WHEN 1 THEN '11.05' ELSE '1.05,9.01' END AS items, CASE WHEN id % 2 = 0 THEN 'a1' END AS accession FROM c
UNION ALL SELECT id, '10-K', '2024-02-02', '', CASE WHEN id % 2 = 0 THEN 'a2' END FROM c UNION ALL SELECT id, '8-K/A', concat('2023-12-', 10 + id % 19), '1.05', NULL FROM c""")
def columnar_filings(spark, sf):
    """Parallel arrays as rows; what an array lacks is null."""
    standin(spark, sf)
    return feeds.columnar_filings(spark.sql(_FILINGS))


@query("SELECT c_custkey AS id, '8-K' AS form, concat('2024-0', 1 + c_custkey % 9, '-01') AS filed FROM customer WHERE c_custkey % 3 <> 1 UNION ALL SELECT c_custkey, '8-K/A', concat('2023-12-', 10 + c_custkey % 19) FROM customer WHERE c_custkey % 19 >= 8")
def item_code_filter(spark, sf):
    standin(spark, sf)
    return feeds.incident_filings(feeds.columnar_filings(spark.sql(_FILINGS))).select("id", "form", "filed")


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey + 1 AS STRING) WHEN 1 THEN '77' END AS cik FROM customer")
def cik_numbers(spark, sf):
    standin(spark, sf)
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("10-K of (cik 000"), F.col("id") + 1, F.lit("), filed"))).when(F.col("id") % 3 == 1, "CIK0077 twice CIK 9").otherwise("CIKADA 12")
    return spark.sql("SELECT c_custkey AS id FROM customer").select("id", feeds.cik(text).alias("cik"))


_CAPTURES = """SELECT page_id AS id, CASE WHEN page_id % 7 = 6 THEN '[]' ELSE concat('[["original","timestamp","statuscode"],["', url, '","2024', lpad(CAST(1 + page_id % 12 AS STRING), 2, '0'), '15080910","', CASE WHEN page_id % 3 = 0 THEN '404' ELSE '200' END, '"],["x","","200"]', CASE WHEN page_id % 2 = 0 THEN ',["y","20190102000000"]' ELSE '' END, ']') END AS body FROM pages"""


@query("""WITH p AS (SELECT page_id AS id, url, lpad(CAST(1 + page_id % 12 AS STRING), 2, '0') AS m FROM pages WHERE page_id % 7 <> 6)
SELECT id, concat('2024', m, '15080910') AS timestamp, url AS original, CASE WHEN id % 3 = 0 THEN '404' ELSE '200' END AS status, concat('2024-', m, '-15') AS day, concat('https://web.archive.org/web/2024', m, '15080910/', url) AS archive_url, id % 2 = 0 AS truncated FROM p
UNION ALL SELECT id, '20190102000000', 'y', '', '2019-01-02', 'https://web.archive.org/web/20190102000000/y', true FROM p WHERE id % 2 = 0""")
def captures_from_rows(spark, sf):
    """Arrays under a header row; a full page of rows says that older ones were not read."""
    standin(spark, sf)
    return feeds.captures(spark.sql(_CAPTURES), 3)


_RESULTS = """SELECT page_id AS id, concat('{"web":{"results":[{"title":"<strong>T', page_id, '</strong>  &amp; more","url":"', url, '","description":"a <b>b</b>","age":""', CASE WHEN page_id % 2 = 0 THEN ',"page_age":"2024"' ELSE '' END, '},{"title":"no url"},{"title":"last","url":"u","age":"1 day"}]}}') AS body FROM pages"""


@query("SELECT page_id AS id, 0 AS rank, concat('T', page_id, ' & more') AS title, url, 'a b' AS description, CASE WHEN page_id % 2 = 0 THEN '2024' ELSE '' END AS age FROM pages UNION ALL SELECT page_id, 2, 'last', 'u', '', '1 day' FROM pages")
def search_results(spark, sf):
    standin(spark, sf)
    return feeds.search_results(spark.sql(_RESULTS))


_BOARDS = """SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' ELSE 'workday' END AS board, CASE c_custkey % 3
 WHEN 0 THEN concat('{"jobs":[{"title":" Automation Tech ","location":{"name":"Erie"},"updated_at":"2024-05-06T01:02:03","absolute_url":"u1","id":', c_custkey, '},{"title":"automation tech","location":{"name":"ERIE "},"id":2},{"title":"Clerk"}]}')
 WHEN 1 THEN concat('{"postings":[{"text":"Planner","categories":{"location":"Reno"},"hostedUrl":"u2","id":"p', c_custkey, '"}]}')
 ELSE concat('{"total":', c_custkey, ',"jobPostings":[{"title":"Driver","locationsText":"2 Locations","postedOn":"Posted Today","externalPath":"/job/1","bulletFields":["J', c_custkey, '"]}]}') END AS body FROM customer"""


@query("""WITH c AS (SELECT c_custkey AS id FROM customer) SELECT id, 'greenhouse' AS board, 'Automation Tech' AS title, 'Erie' AS location, '2024-05-06' AS posted, 'u1' AS url, CAST(id AS STRING) AS job_id, true AS truncated FROM c WHERE id % 3 = 0
UNION ALL SELECT id, 'greenhouse', 'automation tech', 'ERIE', '', '', '2', true FROM c WHERE id % 3 = 0 UNION ALL SELECT id, 'lever', 'Planner', 'Reno', '', 'u2', concat('p', id), false FROM c WHERE id % 3 = 1
UNION ALL SELECT id, 'workday', 'Driver', '2 Locations', 'Posted Tod', '/job/1', concat('J', id), id > 2 FROM c WHERE id % 3 = 2""")
def postings_union(spark, sf):
    """Three job boards in one shape, no more than two jobs of each; truncated where there were more."""
    standin(spark, sf)
    return feeds.postings(spark.sql(_BOARDS), 2).drop("place")


@query("""WITH c AS (SELECT c_custkey AS id FROM customer) SELECT id, 'Automation Tech' AS title, 1 AS dropped FROM c WHERE id % 3 = 0 UNION ALL SELECT id, 'Clerk', 0 FROM c WHERE id % 3 = 0
UNION ALL SELECT id, 'Planner', 0 FROM c WHERE id % 3 = 1 UNION ALL SELECT id, 'Driver', 0 FROM c WHERE id % 3 = 2""")
def posting_dedupe(spark, sf):
    """The first of the postings with one title and place; two places are two postings."""
    standin(spark, sf)
    rows = feeds.postings(spark.sql(_BOARDS), 3)
    return first_per_key(rows, ["id", F.lower(F.trim("title")), F.lower(F.trim("location"))], "place").select("id", "title", "dropped")


_OSHA = """SELECT s_suppkey AS id, concat('<tr><td>head</td></tr><tr><td>1</td><td>1</td><td><a href="inspection_detail?id=5">A', s_suppkey, '</a></td><td>05/0', 1 + s_suppkey % 9, '/2024</td><td>r</td><td>PA</td><td>Complaint</td><td>P</td><td></td><td>4841</td><td>', CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '4' ELSE 'n/a' END, '</td><td>', s_name, '</td></tr><tr><td>inspection_detail?id=6</td></tr>') AS html FROM supplier"""


@query("SELECT s_suppkey AS id, concat('A', s_suppkey) AS activity, concat('05/0', 1 + s_suppkey % 9, '/2024') AS opened, 'Complaint' AS kind, CASE WHEN s_suppkey % 3 = 1 THEN 4 END AS violations, s_name AS establishment, true AS parsed FROM supplier UNION ALL SELECT s_suppkey, NULL, NULL, NULL, NULL, NULL, false FROM supplier")
def inspection_rows(spark, sf):
    """Inspections of a result page; rows that don't parse stay, and an unreadable count is unknown."""
    standin(spark, sf)
    return feeds.inspections(spark.sql(_OSHA))


_SAFER = """SELECT s_suppkey AS id, concat('USDOT Number:|', 1000 + s_suppkey, '|Legal Name:|', s_name, '|DBA Name:|', CASE WHEN s_suppkey % 2 = 0 THEN 'Quick|' ELSE '' END, 'Physical Address:|x|Operating Authority Status:|', CASE WHEN s_suppkey % 3 = 0 THEN 'AUTHORIZED FOR:|Property' ELSE 'NOT AUTHORIZED' END, '|Power Units:|1,2', lpad(CAST(s_suppkey % 100 AS STRING), 2, '0'), '|Drivers:|none|MCS-150 Mileage (Year):|1,000,0', 10 + s_suppkey % 80, ' (2023)') AS body FROM supplier WHERE s_suppkey % 5 <> 4"""
_QCMOBILE = """SELECT s_suppkey AS id, concat('{"content":{"carrier":{"dotNumber":', 1000 + s_suppkey, ',"legalName":"', s_name, '","dbaName":"","commonAuthorityStatus":"', CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'N' END, '","totalPowerUnits":7,"mcs150Mileage":99}}}') AS body FROM supplier WHERE s_suppkey % 5 = 4"""


@query("""WITH s AS (SELECT *, s_suppkey AS id FROM supplier) SELECT id, CAST(1000 + id AS STRING) AS dot_number, s_name AS legal_name, CASE WHEN id % 2 = 0 THEN 'Quick' END AS dba_name, CASE WHEN id % 3 = 0 THEN 'AUTHORIZED' ELSE 'NOT AUTHORIZED' END AS authority,
 CASE WHEN id % 3 = 0 THEN 'Property' END AS authorized_for, CAST(1200 + id % 100 AS INT) AS power_units, CAST(NULL AS INT) AS drivers, CAST(1000000 + 10 + id % 80 AS BIGINT) AS mileage FROM s WHERE id % 5 <> 4
UNION ALL SELECT id, CAST(1000 + id AS STRING), s_name, NULL, CASE WHEN id % 2 = 0 THEN 'AUTHORIZED' ELSE 'NOT AUTHORIZED' END, CASE WHEN id % 2 = 0 THEN 'Common' END, 7, NULL, 99 FROM s WHERE id % 5 = 4""")
def carrier_records(spark, sf):
    """A page of labels and a JSON feed under the same names."""
    standin(spark, sf)
    pages = spark.sql(_SAFER).select("id", F.split("body", r"\|").alias("lines"))
    return feeds.carrier_snapshot(pages).unionByName(feeds.carrier_json(spark.sql(_QCMOBILE)))


_ALIASES = """SELECT concat('{"_comment": {"name_variants": ["no"]}, "C', c_custkey, '": {"name_variants": ["', c_name, ' Inc", "B"], "not_variants": ["Z"]}, "D', c_custkey, '": {}}') AS body FROM customer"""


@query("SELECT concat('C', c_custkey) AS company_id, concat(c_name, ' Inc') AS variant FROM customer UNION ALL SELECT concat('C', c_custkey), 'B' FROM customer")
def alias_variants(spark, sf):
    standin(spark, sf)
    return feeds.aliases(spark.sql(_ALIASES), "body")


_SHEET = """SELECT s_suppkey AS sheet, n AS row_no, CASE WHEN n = s_suppkey % 8 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'Company|Notice Date | Affected' ELSE 'State|EMPLOYER NAME|received' END WHEN n < s_suppkey % 8 THEN 'Title of the list||' ELSE concat(s_name, '|r', n, '| x') END AS body
 FROM supplier CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) v(n)"""


@query("""SELECT s_suppkey AS sheet, n AS row_no, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE concat('r', n) END AS company, CASE WHEN s_suppkey % 2 = 0 THEN concat('r', n) ELSE 'x' END AS day
 FROM supplier CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) v(n) WHERE s_suppkey % 8 < 6 AND n > s_suppkey % 8""")
def xlsx_like_header_sniff(spark, sf):
    """Sheets whose header stands in one of the first six rows, under one of several names."""
    standin(spark, sf)
    rows = spark.sql(_SHEET).withColumn("cells", F.split("body", r"\|"))
    return feeds.sniffed(rows, "sheet", "row_no", "cells", {"company": ("company", "employer name", "company name"), "day": ("notice date", "received", "date")})


_REVIEWS = """SELECT s_suppkey AS id, concat('<div itemtype="http://schema.org/Organization" x> <meta itemprop="name" content="', s_name, '"/><meta itemprop="ratingValue" content=" 3.', s_suppkey % 10, '">', CASE WHEN s_suppkey % 2 = 0 THEN '<meta itemprop="reviewCount"  content="12">' ELSE '' END, '<p itemprop="reviewBody" a="b">old <b>tools</b></p><p itemprop="reviewBody"> </p>', '<span itemprop="reviewBody">fine &amp; good</span>') AS html FROM supplier"""


@query("SELECT s_suppkey AS id, s_name AS declared_name, concat('3.', s_suppkey % 10) AS rating, CASE WHEN s_suppkey % 2 = 0 THEN '12' ELSE '' END AS review_count, 'old tools|fine & good' AS reviews FROM supplier")
def review_pages(spark, sf):
    """Microdata of a review page: each text up to the first closing tag."""
    standin(spark, sf)
    r = spark.sql(_REVIEWS).select("id", feeds.review_page(F.col("html")).alias("r"))
    return r.select("id", "r.declared_name", "r.rating", "r.review_count", F.array_join("r.reviews", "|").alias("reviews"))


_ARTIFACT = "SELECT s_suppkey AS id, concat('H', s_suppkey) AS harness_id, concat('v1.', s_suppkey % 7) AS version, 10 + s_suppkey % 5 AS sampled, s_suppkey % 4 AS excluded, s_suppkey % 3 AS wrong_entity FROM supplier"


@query(f"""SELECT harness_id, version, concat(harness_id, '_', version, '.json') AS filename, round((sampled - excluded) / sampled, 4) AS precision_rate, round(excluded / sampled, 4) AS exclusion_rate,
 CASE WHEN wrong_entity > 0 OR excluded / sampled > 0.15 THEN 'fail' ELSE 'pass' END AS verdict, CASE WHEN id % 6 = 0 THEN 'random_control is missing population_n' ELSE '' END AS problems FROM ({_ARTIFACT})""")
def artifact_roundtrip(spark, sf):
    """Audit artifacts written as JSON and read again: the name fits the contents, rates are derived, and gaps are named."""
    from ..operators.audit import artifact_json, artifact_rows

    standin(spark, sf)
    return artifact_rows(artifact_json(spark.sql(_ARTIFACT)), "filename", "body")
