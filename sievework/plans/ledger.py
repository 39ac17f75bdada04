"""Queries over stored versions, migrations, draws per stratum, nested JSON, sheets of different makers, and speakers of articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_tree
from ..operators import audit, merge, migrations
from ..operators import passages as O
from ..sources import sheets
from ..sources import versions as V
from ..sources.tables import read_export, read_table, write_export
from .planted import planted, quoted
from .standin import ctes, standin

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: The state of each company and topic in each year, as it is known on a day: its status, and the evidence that it rests on.
_HISTORY = """SELECT company_id, topic, CAST(extract(YEAR FROM published_on) AS INT) AS bucket, CASE WHEN count(*) >= 2 THEN 'observed' ELSE 'thin' END AS status,
    count(*) AS evidence_count, min(observation_id) AS first_id, 'h1' AS definition_hash FROM observations o WHERE published_on <= DATE '{day}'{more} GROUP BY company_id, topic, CAST(extract(YEAR FROM published_on) AS INT)"""
_OLD = _HISTORY.format(day="1997-06-30", more="")
_NEW = _HISTORY.format(day="1998-12-31", more=" AND NOT EXISTS (SELECT 1 FROM invalid i WHERE i.observation_id = o.observation_id AND i.validity_status = 'wrong_entity')")


@query(ctes("observations", "invalid") + f", a AS ({_OLD}), b AS ({_NEW}), c AS (SELECT b.*, CASE WHEN a.company_id IS NULL THEN 'new' WHEN a.status <> b.status THEN 'changed' WHEN a.evidence_count <> b.evidence_count OR a.first_id <> b.first_id THEN 'evidence_only' END AS change "
       "FROM b LEFT JOIN a ON a.company_id = b.company_id AND a.topic = b.topic AND a.bucket = b.bucket) SELECT bucket, change, count(*) AS n FROM c WHERE change IS NOT NULL GROUP BY bucket, change")
def stored_history_diff(spark, sf):
    """Two derivations are committed as versions, and the newer one is compared with the older as it was stored."""
    for name, df in zip(("observations", "invalid"), standin(spark, sf, "observations", "invalid"), strict=True):
        df.createOrReplaceTempView(name)
    path = V.shared_folder(spark)
    V.write_version(spark.sql(_OLD), path, "DR-0001", stamps=("definition_hash", "topic"))
    V.write_version(spark.sql(_NEW), path, "DR-0002", stamps=("definition_hash", "topic"), force=False)
    old, new = (V.read_version(spark, path, v) for v in ("DR-0001", "DR-0002"))
    changes = V.compare_versions(old, new, ["company_id", "topic", "bucket"], ["status", "definition_hash"], ["evidence_count", "first_id"])
    return changes.groupBy("bucket", "change").agg(F.count("*").alias("n"))


def _steps(n: int) -> list[migrations.Step]:
    """Five changes of the orders: an id, a vocabulary, new keys, blanks filled, and rows without a price moved out."""
    step = migrations.Step
    return [
        step("add_source_id", lambda d: d.withColumn("source_id", F.format_string("SRC-%08d", "o_orderkey")), "source_id = SRC-%08d of o_orderkey"),
        step("add_state", lambda d: d.withColumn("state", F.when(F.col("o_orderstatus") == "F", "released")), "state = released where o_orderstatus = F, else null"),
        step("rename_topics", lambda d: migrations.rename_keys(d, "o_orderpriority", {"1-URGENT": "T-URGENT", "5-LOW": "T-LOW"}, "human"), "1-URGENT -> T-URGENT, 5-LOW -> T-LOW"),
        step("fill_state", lambda d: d.fillna("quarantined", ["state"]), "blank state = quarantined"),
        step("drop_open_small", lambda d: d.where("NOT (o_orderstatus = 'O' AND o_totalprice < 50000)"), "open orders under 50,000 go", lambda before: n),
    ]


_SMALL_OPEN = "o_orderstatus = 'O' AND o_totalprice < 50000"


@query(f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (NOT ({_SMALL_OPEN})) AS kept FROM orders), s AS (SELECT * FROM (VALUES (1, 'add_source_id'), (2, 'add_state'), (3, 'rename_topics'), (4, 'fill_state'), (5, 'drop_open_small')) t(seq, step))
SELECT run, seq, step, CASE run WHEN 1 THEN 'applied' ELSE 'skipped' END AS action, c.n AS rows_before, CASE seq WHEN 5 THEN c.kept ELSE c.n END AS rows_after FROM s, c, (VALUES (1), (2)) r(run)""")
def migration_ledger(spark, sf):
    """Five steps over the orders, run twice: each is applied once, with the rows it found and left, and the second run writes nothing."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice").withColumn("human", F.lit(False))
    path, kept = V.shared_folder(spark), orders.where(f"NOT ({_SMALL_OPEN})").count()
    runs = [migrations.run_steps(spark, path, orders, _steps(kept)).withColumn("run", F.lit(k)) for k in (1, 2)]
    return runs[0].unionByName(runs[1])


@query(f"""SELECT o_orderkey, printf('SRC-%08d', o_orderkey) AS source_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'T-URGENT' WHEN '5-LOW' THEN 'T-LOW' ELSE o_orderpriority END AS topic,
CASE o_orderstatus WHEN 'F' THEN 'released' ELSE 'quarantined' END AS state FROM orders WHERE NOT ({_SMALL_OPEN})""")
def migrated_rows(spark, sf):
    """The orders as five recorded steps leave them, read from the last committed version."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice").withColumn("human", F.lit(False))
    path, kept = V.shared_folder(spark), orders.where(f"NOT ({_SMALL_OPEN})").count()
    migrations.run_steps(spark, path, orders, _steps(kept))
    return V.read_version(spark, path, "005_drop_open_small").select("o_orderkey", "source_id", F.col("o_orderpriority").alias("topic"), "state")


_HASH = "md5(concat('20260831:', CAST(doc_id AS VARCHAR)))"


@query(f"""WITH d AS (SELECT doc_id, {_HASH} AS h, coalesce(length(text), 0) < 400 AS a, source IN ('src0', 'src1', 'src2') AS b, lang = 'en' AS c, coalesce(length(text), 0) > 100000000 AS e FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
w AS (SELECT doc_id, h, row_number() OVER (ORDER BY h, doc_id) AS turn FROM d WHERE a QUALIFY turn <= 12),
x AS (SELECT doc_id, h, row_number() OVER (ORDER BY h, doc_id) AS turn FROM d WHERE b AND doc_id NOT IN (SELECT doc_id FROM w) QUALIFY turn <= 15),
y AS (SELECT doc_id, h, row_number() OVER (ORDER BY h, doc_id) AS turn FROM d WHERE c AND doc_id NOT IN (SELECT doc_id FROM w) AND doc_id NOT IN (SELECT doc_id FROM x) QUALIFY turn <= 30)
SELECT 'short' AS stratum, turn::INT AS turn, doc_id FROM w UNION ALL SELECT 'named_sources', turn::INT, doc_id FROM x UNION ALL SELECT 'english', turn::INT, doc_id FROM y""")
def audit_draws(spark, sf):
    """Rows for review: each of four overlapping strata draws its number by hash, without what earlier reviews (the toxic ones) or earlier strata have drawn; one stratum is empty."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    drawn = read_table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    size = F.coalesce(F.length("text"), F.lit(0))
    strata = {"short": (size < 400, 12), "named_sources": (F.col("source").isin("src0", "src1", "src2"), 15), "english": (F.col("lang") == "en", 30), "huge": (size > 100_000_000, 5)}
    return audit.draw_strata(docs, "doc_id", strata, drawn).select("stratum", "turn", "doc_id")


#: Answers of a registry, nested at different depths, with the whole text of a document inside a string, which names keys as well. {text} is the string, quoted by the engine.
_FACILITY = """concat('{"note":', {text}, ',"Results":', CASE doc_id % 4
    WHEN 0 THEN concat('{"Facilities":[{"FacName":"Works ', doc_id, ' Inc","FacNAICSCodes":"4841, 4842"},{"FacName":"Other","FacNAICSCodes":"9999"}]}')
    WHEN 1 THEN concat('[{"x":{"y":[{"FacName":"WORKS ', doc_id, ' INC","FacNAICSCodes":"3311","inner":{"FacName":"Works ', doc_id, ' inc","FacNAICSCodes":"4931 4932"}}]}},[["FacName"]]]')
    WHEN 2 THEN concat('{"FacName":"Works ', doc_id, ' Inc","FacNAICSCodes":null}') ELSE '"none"' END, CASE WHEN doc_id % 11 = 5 THEN '' ELSE '}' END)"""
_NOTE = """concat('"FacNAICSCodes": "7777" {"FacName": "Works"} ', coalesce(text, ''))"""
_BODY_THERE = _FACILITY.replace("{text}", f"CAST(to_json({_NOTE}) AS VARCHAR)")
_BODY_HERE = _FACILITY.replace("{text}", f"substring(to_json(named_struct('t', {_NOTE})), 6, length(to_json(named_struct('t', {_NOTE}))) - 6)")


@query(f"""WITH b AS (SELECT doc_id, {_BODY_THERE} AS body FROM documents),
o AS (SELECT doc_id, body::JSON AS j FROM (SELECT * FROM b WHERE json_valid(body))),
t AS (SELECT o.doc_id, t.value FROM o, json_tree(o.j) t WHERE t.type = 'OBJECT'),
f AS (SELECT doc_id, value ->> '$.FacName' AS name, value ->> '$.FacNAICSCodes' AS codes FROM t),
c AS (SELECT doc_id, unnest(string_split_regex(trim(replace(codes, ',', ' ')), ' +')) AS code FROM f WHERE upper(name) = upper(concat('Works ', doc_id, ' Inc')) AND codes IS NOT NULL)
SELECT doc_id, code, count(*) AS n FROM c WHERE code <> '' GROUP BY doc_id, code""")
def nested_codes(spark, sf):
    """Codes of the facility of each document's name, wherever it stands in the answer; what stands inside strings is no key, and a broken answer has none."""
    standin(spark, sf)
    rows = spark.sql(f"SELECT doc_id, {_BODY_HERE} AS body FROM documents")
    found = json_tree.fields(json_tree.nodes(rows, "doc_id", "body"), {"name": "FacName", "codes": "FacNAICSCodes"})
    own = found.where(F.upper("name") == F.upper(F.concat(F.lit("Works "), F.col("id").cast("string"), F.lit(" Inc"))))
    codes = own.select(F.col("id").alias("doc_id"), F.explode(F.split(F.trim(F.replace("codes", F.lit(","), F.lit(" "))), " +")).alias("code"))
    return codes.where("code != ''").groupBy("doc_id", "code").agg(F.count("*").alias("n"))


#: Lists of notices as four makers write them: other headers, other columns, lines before the header, quotes, other dates, one without a header.
_MAKERS = (
    ("a", "JOB_SITE_NAME,CITY_NAME,NOTICE_DATE,TOTAL_LAYOFF_NUMBER", "concat('\"', c_name, ', \"\"the\"\" Works\",City ', c_nationkey, ',', date_format(day, 'yyyy-MM-dd'), ',', c_custkey)"),
    ("b", "List of notices\n,,\nCounty,  Notice   Date ,Company,No. Of Employees,Address", "concat('X,', date_format(day, 'M/d/yyyy'), ',', c_name, ',', c_custkey, ',\"City ', c_nationkey, ', ST\"')"),
    ("c", "company,city_name", "concat(c_name, ',', 'City ', c_nationkey)"),
    ("d", "who,when", "concat(c_name, ',', date_format(day, 'yyyy-MM-dd'))"),
    ("e", "x\nx\nx\nx\nx\nNOTICE_DATE,COMPANY\n,\n19990101,", "concat(date_format(day, 'yyyyMMdd'), ',', c_name)"),
)


@query("""WITH c AS (SELECT *, DATE '1995-01-01' + CAST(c_custkey * 7 % 1500 AS INT) AS day, c_custkey % 5 AS i FROM customer), s AS (SELECT *, day >= DATE '1996-01-01' AS within FROM c)
SELECT CASE i WHEN 0 THEN concat(c_name, ', "the" Works') ELSE c_name END AS name, CAST(day AS VARCHAR) AS date, CASE WHEN i < 2 THEN CAST(c_custkey AS VARCHAR) END AS count, CASE i WHEN 0 THEN concat('City ', c_nationkey) WHEN 1 THEN concat('City ', c_nationkey, ', ST') END AS city
FROM s WHERE within AND i IN (0, 1, 4)""")
def notice_sheets(spark, sf):
    """Notices of all customers, written as sheets with five different headers, read back as one table and cut to the window of dates."""
    standin(spark, sf)
    path = V.shared_folder(spark)
    rows = spark.sql("SELECT *, date_add(DATE '1995-01-01', CAST(c_custkey * 7 % 1500 AS INT)) AS day, CAST(c_custkey % 5 AS INT) AS i FROM customer")
    for i, (maker, header, line) in enumerate(_MAKERS):
        own = rows.where(F.col("i") == i)
        # A file for each few thousand rows, each with its own header.
        files = own.select((F.col("c_custkey") % 7).alias("part"), F.expr(line).alias("line")).groupBy("part").agg(F.array_join(F.collect_list("line"), "\n").alias("lines"))
        files.select(F.concat(F.lit(header + "\n"), "lines").alias("value")).repartition(7).write.text(f"{path}/{maker}")
    return sheets.read_sheets(spark, f"{path}/*", since="1996-01-01").select("name", F.col("date").cast("string").alias("date"), "count", "city")


ARTICLES = (
    "Kelly Benedict, the firm's head of innovation and {w} grew.", "Jane Roe, chief information and digital officer at {w} Works, agreed.", "{w}'s chief information officer, Jane Roe said so. Later Jane Roe, president of {w}, left.",
    "Bob Poe, {w}’s vice president, came.", "Cy Fox, an analyst, spoke; Di Ray, director of research at {w}, heard it.", "Ed Lee, the company's president, left town.", "Flo Kay, president of Another Co, met us.",
    "Gil Roy, senior director of fleet systems for the very old {w} Works, and {w} WORKS's owner Hal Jay.", "Ida Noe, principal with Zeta; nobody else.", "{w}'s SVP of operations Jan May and {w}'s COO, Kim Day, and the contractor's owner.",
    "counsel Len Fox, general manager at {w}, was there", "Mo Hay, the builder's founder, and " + "x " * 200 + "{w}",
)


def _speakers_sql() -> str:
    known = "'(?i:' || upper(w) || '[\\\\w&.,''’\\\\-]*\\\\s*WORKS|' || upper(w) || ')'".replace("\\\\", "\\")
    parts = []
    for no, (shape, rx, name_first, inside) in enumerate(O.SHAPES):
        pieces = rx.format(person=O.PERSON, title=O.PROSE_TITLE, company="\x00").split("\x00")
        pattern = f" || {known} || ".join(quoted(p) for p in pieces)
        parts.append(f"SELECT k, w, text, {no} AS no, '{shape}' AS shape, {str(name_first).lower()} AS name_first, {str(inside).lower()} AS inside, {pattern} AS rx, {known} AS known FROM p")
    return " UNION ALL ".join(parts)


@query(rf"""WITH p AS ({planted(ARTICLES, '. ')}), s AS ({_speakers_sql()}),
m AS (SELECT *, string_split(regexp_replace(text, '(' || rx || ')', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM s WHERE regexp_matches(text, rx)),
i AS (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM m),
e AS (SELECT *, string_split(parts[i], chr(2))[1] AS whole, replace(array_to_string(parts[1:i - 1], ''), chr(2), '') AS before, string_split(parts[i], chr(2))[2] || replace(array_to_string(parts[i + 1:], ''), chr(2), '') AS behind FROM i),
g AS (SELECT *, regexp_extract(whole, '^(?:' || rx || ')$', 1) AS g1, regexp_extract(whole, '^(?:' || rx || ')$', 2) AS g2, right(before, 130) || whole || left(behind, 130) AS near, right(before, 260) || whole || left(behind, 260) AS wide FROM e),
n AS (SELECT k, no, i, shape, regexp_replace(regexp_replace(CASE WHEN name_first THEN g1 ELSE g2 END, '\s+', ' ', 'g'), '^[ ,]+|[ ,]+$', '', 'g') AS name,
      trim(regexp_replace(regexp_replace(regexp_replace(CASE WHEN name_first THEN g2 ELSE g1 END, '\s+', ' ', 'g'), '^[ ,]+|[ ,]+$', '', 'g'), '(?i)\s+(and|or|of|the|for|at)$', '')) AS title,
      CASE WHEN regexp_matches(near, {quoted(O.OUTSIDER)}) THEN 'speaks for another' WHEN NOT inside AND NOT regexp_matches(wide, known) THEN 'company not named near' ELSE '' END AS refused FROM g),
f AS (SELECT *, row_number() OVER (PARTITION BY k, refused = '', lower(name) ORDER BY no, i) AS mention FROM n WHERE len(string_split(name, ' ')) >= 2 AND length(name) <= 60),
r AS (SELECT *, row_number() OVER (PARTITION BY k, refused = '' ORDER BY no, i) AS turn FROM f WHERE refused <> '' OR mention = 1)
SELECT k, name, title, shape, refused, count(*) AS n FROM r WHERE refused <> '' OR turn <= 6 GROUP BY ALL""")
def speakers(spark, sf):
    """People whom an article presents as officers of its company, and those it quotes for somebody else, with the reason."""
    standin(spark, sf)
    found = spark.sql(planted(ARTICLES, ". ")).select("k", F.explode(O.speakers(F.col("text"), F.concat("w", F.lit(" Works Inc")))).alias("s"))
    return found.groupBy("k", "s.name", "s.title", "s.shape", "s.refused").agg(F.count("*").alias("n"))


_EXPORTED = "SELECT c_custkey AS id, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN concat('He said \"no, ', c_custkey, '\"') WHEN 1 THEN 'é, ü' WHEN 2 THEN NULL ELSE 'plain' END AS note FROM customer"


@query(_EXPORTED)
def export_roundtrip(spark, sf):
    """All customers written as an export for spreadsheets and read back: quotes, commas, accents and missing notes as they were."""
    standin(spark, sf)
    path = V.shared_folder(spark)
    write_export(spark.sql(_EXPORTED), path)
    return read_export(spark, path, "id long, name string, note string")


_REVIEWED = """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Human' WHEN 1 THEN 'machine' WHEN 2 THEN NULL ELSE 'none' END AS review_source, CASE o_orderkey % 7 WHEN 0 THEN 'accepted' WHEN 1 THEN 'corrected' WHEN 2 THEN 'Rejected' WHEN 3 THEN NULL ELSE 'unreviewed' END AS review_status FROM orders"""


@query(f"SELECT id, coalesce(lower(review_source) = 'human', false) OR coalesce(review_status IN ('accepted', 'corrected', 'rejected'), false) AS human FROM ({_REVIEWED})")
def human_rows(spark, sf):
    """Rows that a person has judged, by their source or by a status that only a person sets; a merge leaves these alone."""
    standin(spark, sf)
    return spark.sql(_REVIEWED).select("id", merge.human_authored(F.col("review_source"), F.col("review_status")).alias("human"))
