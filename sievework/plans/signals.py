"""Queries that run the term tables over whole documents into which postings, remarks and articles are set; the other engine evaluates the same tables row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import passages as P
from ..functions import people as N
from ..functions import postings
from ..functions import text as T
from ..functions.themes import THEMES, classify
from ..operators import coverage
from ..operators import passages as O
from .markup import _BLOCK_TAGS, _NAMES, unescape_sql
from .planted import planted, quoted
from .standin import standin

QUERIES, SQL = {}, {}

POSTINGS = (
    "WMS Analyst at {w}", "Warehouse Associate - WMS experience a plus", "Director of Analytics, BI-Weekly pay", "BI developer with dashboard work", "AI Weiwei exhibit guide",
    "AI engineer for conveyor controls", "AWS at {w}", "AWS migration engineer", "conveyor belt mechanic", "IT Recruiter, data engineer roles", "Intern, analytics", "WMS Mechanic",
    "SAP analyst", "EDI developer", "Power BI author", "API Technician - Active Pharmaceutical Ingredients", "Lean Beef Processing Associate", "Lean manufacturing engineer", "Oracle Card Dealer",
    "Oracle database administrator", "Innovation Center Tour Guide", "Head of innovation", "Transformation Coach - Wellness", "business transformation lead", "Security Officer, security operations and network",
    "security engineer, firewall and SIEM", "mainframe operator", "mainframe decommissioning", "SRE for kubernetes", "devops at night", "Kronos payroll clerk", "Kronos administrator", "WFM specialist",
    "quality control technician, controls engineer", "Controls Engineer, PLC and SCADA", "MES engineer", "OT network engineer", "MLC press", "ML scientist", "zero trust and NIST compliance analyst", "TMS and telematics, CDL driver",
    "learning and adoption & training and adoption", "user adoption program", "Sr. Director, data center exit to Azure", "Infor and Information desk", "VP of data platform, JD Edwards", "robotics club", "robotics engineer",
)


def edges(column: str) -> str:
    """A text in which accented Latin letters are marks that count as part of a word, as they do for edges of words here; the other engine's edges know ASCII only. Patterns have no such letters."""
    return f"regexp_replace({column}, '[\\x{{C0}}-\\x{{D6}}\\x{{D8}}-\\x{{F6}}\\x{{F8}}-\\x{{24F}}]', '_', 'g')"


def _terms() -> str:
    """The table of terms as VALUES, without the look-ahead that a word's edge makes idle."""
    rows = [
        (i, j, key, t.pattern.replace("(?!C)", ""), t.requires and f"(?i){t.requires}", t.blocks and f"(?i){t.blocks}", t.weak_if_unqualified, t.requires, t.blocks)
        for i, (key, terms) in enumerate(postings.SIGNALS.items())
        for j, t in enumerate(terms)
    ]
    return ",\n".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


SQL["posting_classify"] = rf"""
WITH d AS (SELECT k, {edges('text')} AS text FROM ({planted(POSTINGS)})),
t(i, j, signal, rx, requires, blocks, weak, said_requires, said_blocks) AS (VALUES {_terms()}),
m AS (SELECT k, t.*, regexp_extract(text, rx) AS term, regexp_extract(text, {quoted(postings.EXCLUSIONS)}) AS excluded,
      blocks <> '' AND regexp_matches(text, blocks) AS blocked, requires = '' OR regexp_matches(text, requires) AS met FROM d JOIN t ON regexp_matches(text, rx)),
v AS (SELECT *, CASE WHEN blocked THEN 'blocked' WHEN met THEN 'matched' WHEN weak AND excluded = '' THEN 'weak' ELSE 'unqualified' END AS verdict FROM m),
r AS (SELECT k, term, arg_max(reason, turn) AS reason FROM (
      SELECT k, i * 1000 + j AS turn, term, CASE verdict WHEN 'blocked' THEN 'blocked by: ' || said_blocks ELSE 'requires: ' || said_requires END AS reason FROM v WHERE verdict <> 'matched'
      UNION ALL SELECT k, i * 1000 + 999, term, 'operational role: ' || excluded FROM v WHERE verdict = 'matched' AND excluded <> '') GROUP BY k, term),
s AS (SELECT k, i, signal, string_agg(DISTINCT term, ',' ORDER BY term) FILTER (verdict = 'matched' AND excluded = '') AS strong, string_agg(DISTINCT term, ',' ORDER BY term) FILTER (verdict = 'weak') AS weak FROM v GROUP BY k, i, signal),
a AS (SELECT k, string_agg(signal || ':' || strong, '|' ORDER BY i) FILTER (strong IS NOT NULL) AS signals, string_agg(signal || ':' || weak, '|' ORDER BY i) FILTER (strong IS NULL AND weak IS NOT NULL) AS weak FROM s GROUP BY k),
f AS (SELECT k, string_agg(term || ' ' || reason, '|' ORDER BY term) AS rejected FROM r GROUP BY k)
SELECT d.k, coalesce(a.signals, '') AS signals, coalesce(a.weak, '') AS weak, coalesce(f.rejected, '') AS rejected, regexp_matches(d.text, {quoted(postings.LEADERSHIP)}) AS leadership
FROM d LEFT JOIN a USING (k) LEFT JOIN f USING (k)
"""


def posting_classify(spark, sf):
    """Signals of postings set into whole documents: matched terms, the weak tier, and every refused term with its reason."""
    standin(spark, sf)
    c = spark.sql(planted(POSTINGS)).select("k", postings.classify_posting(F.col("text")).alias("c"))
    listed = lambda keys, found: F.array_join(F.transform(keys, lambda s: F.concat(s, F.lit(":"), F.array_join(F.element_at(found, s), ","))), "|")
    refused = F.array_sort(F.transform(F.map_entries("c.rejected"), lambda e: F.concat(e["key"], F.lit(" "), e["value"])))
    return c.select("k", listed(F.col("c.signals"), F.col("c.matched")).alias("signals"), listed(F.col("c.weak_signals"), F.col("c.weak_terms")).alias("weak"), F.array_join(refused, "|").alias("rejected"), "c.leadership")


QUERIES["posting_classify"] = posting_classify


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def plain(rx: str) -> str:
    """A pattern without look-ahead, which the other engine lacks, and with edges of a word that know letters beyond ASCII."""
    return rx.replace(r"\bAI\b", r"(?:^|[^\pL\pN_])AI").replace(r"(?![-\w])", r"(?:[^-\pL\pN_]|$)")


def themes_sql(source: str, themes, name: str) -> str:
    """CTEs that end in `name` (k, theme, admitted, n_hits): the vocabulary over the rows (k, text) of `source`, pattern by pattern."""
    rows = ",\n".join(f"({quoted(t.key)}, {tier}, {str(t.generic_admits).lower()}, {quoted('|'.join(t.exclusions) and '(?i)' + '|'.join(t.exclusions))}, {quoted('(?i)' + plain(p))})" for t in themes for tier, ps in (("false", t.specific), ("true", t.generic)) for p in ps)
    return f"""{name}_t(theme, generic, admits, blanked, rx) AS (VALUES {rows}),
{name}_x AS (SELECT k, t.*, CASE WHEN blanked = '' THEN text ELSE regexp_replace(text, blanked, ' ', 'g') END AS own FROM (SELECT k, {edges('text')} AS text FROM {source}) JOIN {name}_t t ON regexp_matches(text, rx)),
{name} AS (SELECT k, theme, bool_or(NOT generic) OR (bool_and(admits) AND count(DISTINCT lower(regexp_extract(own, rx))) FILTER (generic) >= 2) AS admitted, count(*) AS n_hits FROM {name}_x WHERE regexp_matches(own, rx) GROUP BY k, theme)"""


REMARKS = (
    "{w} runs on spreadsheets and an ERP", "The homegrown system of {w} and its analytics", "An API at {w}", "An API and an integration at {w}", "After post-merger integration {w} kept one API",
    "AWS and Azure at {w}", "ransomware, SCADA and telematics hit {w}", "zero trust and warehouse robotics, workforce management at {w}", "cloud migration and digital transformation", "AI-first {w}, and AI.",
    "SAP and Oracle at {w}", "SAP, and sap again", "Our systems don't talk to each other, we track orders by hand on whiteboards", "a driver shortage and a dispatch board", "we do not have that much of our data", "AMR and an AMR, Lean",
    "pick and pack on a conveyor", "S/4HANA and JD Edwards", "human-machine interface and plant-floor network", "change management at {w} and gut feel",
)


@query(f"WITH d AS ({planted(REMARKS)}), {themes_sql('d', THEMES, 'h')} SELECT k AS doc_id, theme, admitted, n_hits FROM h")
def theme_classify_spine(spark, sf):
    """The whole vocabulary over whole documents with remarks set into them; a lone generic term is seen and not admitted."""
    standin(spark, sf)
    t = spark.sql(planted(REMARKS)).select(F.col("k").alias("doc_id"), F.explode(classify(F.col("text"))).alias("t"))
    return t.select("doc_id", "t.theme", "t.admitted", F.size("t.hits").cast("long").alias("n_hits"))


@query(f"""WITH d AS ({planted(REMARKS)}), {themes_sql('d', THEMES, 'h')}, {themes_sql('d', P.BUYER_VOICE, 'v')},
s AS (SELECT k, string_agg(theme, ',' ORDER BY theme) AS spine FROM h WHERE admitted GROUP BY k), b AS (SELECT k, string_agg(DISTINCT theme, ',' ORDER BY theme) AS voice FROM (FROM h UNION ALL FROM v) WHERE admitted GROUP BY k)
SELECT d.k, coalesce(spine, '') AS spine, coalesce(voice, '') AS voice FROM d LEFT JOIN s USING (k) LEFT JOIN b USING (k)""")
def theme_classify_tiered(spark, sf):
    """The vocabulary alone, and together with the buyers' own words."""
    standin(spark, sf)
    rows = spark.sql(planted(REMARKS))
    spine = F.array_sort(F.transform(F.filter(classify(F.col("text")), lambda t: t["admitted"]), lambda t: t["theme"]))
    return rows.select("k", F.array_join(spine, ",").alias("spine"), F.array_join(P.voice_themes(F.col("text")), ",").alias("voice"))


STATES = (
    "At {w} we were on spreadsheets, so it is underway", "The system is clunky and crashes, behind the times", "We implemented it long ago; still using paper", "{w} is siloed and outdated; we plan to change", "Our goal is a better {w}",
    "Manual work at {w}", "Nothing of note at {w}", "{w} has deployed it and will open more by 2031", "a roadmap over the next two years", "we couldn't do it, hard to say", "we've launched it", "new system rolled out, paperwork by hand",
    "upgrading and migrating to it", "is investing, breaks ground", "lack of tools, no proper system", "they just got it", "we are currently piloting and weve started", "the future is bright, eventually", "an inefficient bottleneck", "announced the opening of a site",
)


def _state_sql(source: str) -> str:
    each = list(P.STATE_CUES[source].items())
    state = " ".join(f"WHEN regexp_matches(text, {quoted(rx)}) THEN {quoted(s)}" for s, rx in each)
    cue = " ".join(f"WHEN regexp_matches(text, {quoted(rx)}) THEN regexp_extract(text, {quoted(rx)})" for _, rx in each)
    return f"CASE {state} ELSE 'unknown' END AS {source}, CASE {cue} ELSE '' END AS {source}_cue"


@query(f"SELECT k, {', '.join(map(_state_sql, P.STATE_CUES))} FROM ({planted(STATES)})")
def state_cues_by_source(spark, sf):
    """One text reads differently by who speaks: each source has cues and an order of states of its own."""
    standin(spark, sf)
    rows = spark.sql(planted(STATES)).select("k", *[P.state_of(F.col("text"), s).alias(s) for s in P.STATE_CUES])
    return rows.select("k", *[c for s in P.STATE_CUES for c in (F.col(f"{s}.state").alias(s), F.col(f"{s}.cue").alias(f"{s}_cue"))])


REPORTS = (
    "{w} deployed a new warehouse management system across nine sites last year. Short one", "{w} says it is embracing machine learning in all of its plants and offices", "{w} plans to deploy a new ERP in its plants over the coming two years, sources hint",
    "{w} is widely regarded as a leader in the trade of pipes and of steel tubes", "{w} deployed forty new trucks of an older make across nine sites last year", "Another firm plans to deploy a new ERP in its plants over the coming two years",
    "{w} upgraded its warehouse management system in the spring of the year before", "{w} selected a new transportation management system for all of its trucks", "{w} will upgrade its WMS in the spring of the year after next, it hopes",
    "{w} hired a new chief information officer who had run its analytics before", "{w} spent $4.5 million on telematics in the course of the last two years", "At {w}, staff told us they are transitioning to a new ERP in the course of the year",
    "It appears to be a good year for analytics in the trade of steel and of pipes", "{w} is betting on analytics, signing a deal with a maker of robots of all kinds", "{w} remains on a path to digital transformation, whatever others may think of it",
)


@query(f"""WITH d AS ({planted(REPORTS, ". ")}),
s AS (SELECT k * 100000 + no AS k, k AS doc, no, w, text FROM (SELECT k, w, unnest(range(len(l))) AS no, unnest(l) AS text FROM (
      SELECT k, w, list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS l FROM d)) WHERE length(text) BETWEEN 40 AND 600),
f AS (SELECT *, regexp_matches(lower(text), '\\b' || lower(w) || '\\b') AS named, regexp_matches(text, {quoted(P.ACTION)}) AS act, regexp_matches(text, {quoted(P.INTENT)}) AS intent, regexp_matches(text, {quoted(P.CHARACTER)}) AS framed,
      regexp_matches(text, {quoted(P.SELF)}) AS spoken FROM s),
j AS (SELECT *, CASE WHEN act THEN 'action' WHEN (intent OR framed) AND named AND spoken THEN 'self' WHEN named AND intent THEN 'intent' WHEN framed THEN 'journalist' END AS kind FROM f WHERE act OR intent OR framed),
{themes_sql('j', THEMES, 'h')},
o AS (SELECT j.*, CASE kind WHEN 'action' THEN 0 WHEN 'journalist' THEN 2 ELSE 1 END AS class FROM j WHERE kind IS NOT NULL AND (kind = 'journalist' OR EXISTS (SELECT 1 FROM h WHERE h.k = j.k AND admitted))),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, class ORDER BY no) AS turn, CASE kind WHEN 'action' THEN regexp_extract(text, {quoted(P.ACTION)}) WHEN 'self' THEN regexp_extract(text, {quoted(P.SELF)}) WHEN 'intent' THEN regexp_extract(text, {quoted(P.INTENT)}) ELSE '' END AS cue FROM o),
a AS (SELECT doc, string_agg(kind || ':' || cue, '|' ORDER BY class, no) AS kinds FROM r WHERE class = 2 OR turn <= 6 GROUP BY doc)
SELECT d.k, coalesce(kinds, '') AS kinds FROM d LEFT JOIN a ON a.doc = d.k""")
def reported_actions(spark, sf):
    """What each document reports: actions, the company's own words, its intent, and the reporter's framing, each with the words that show it."""
    standin(spark, sf)
    rows = spark.sql(planted(REPORTS, ". ")).select("k", P.reported(F.col("text"), F.col("w")).alias("r"))
    return rows.select("k", F.array_join(F.transform("r", lambda x: F.concat(x["kind"], F.lit(":"), x["cue"])), "|").alias("kinds"))


ROSTERS = (
    "<li>Ann Lee</li><li>Chief Executive Officer</li><li>Bo Ray, PhD</li><li>CFO</li>", "<p>President</p><p>Cy Poe</p><p>{w}</p><p>Di Moe, Vice President of Global Operations</p>", "<p>Ann Lee</p><p>President</p><p>Ann Lee</p><p>CIO</p>",
    "<p>Ed O'Neil Jr.</p><p>Director of Fleet Analytics</p><p>Flo Kay</p><p>COO</p>", "<p>Texas Region President</p><p>Student Programs</p><p>Gil Roy</p><p>Our Blue Thing</p>", "<p>Employee-Owner</p><p>Hal Jay</p><p>owner of it all</p>",
    "<p>Ida Noe</p><p>Code of Ethics for CEO</p><p>Jan May | Chief Digital Officer</p>", "<p>{w} Works</p><p>CEO</p><p>How We</p><p>Director, Supply Chain</p>", "<p>Kim Day</p><p>She is the CEO and leads the team</p><p>Len Fox - SVP Engineering</p>",
    "<p>Mo Hay</p><p>General Counsel</p><p>Ned Guy</p><p>Plant Superintendent</p><p>Ola Lux</p><p>VP</p>", "<p>Pat McRae</p><p>Vice President, Information Technology</p><p>Quin De La Cruz</p><p>Co-Founder</p>", "<p>no names</p><p>Marketing</p><p>Rex Sol</p>",
)
_ROSTER_PAGES = {"table": "pages", "key": "page_id", "text": "html", "before": "<"}
_LINES = rf"""p AS ({planted(ROSTERS, **_ROSTER_PAGES)}), a AS (SELECT k, w, regexp_replace(regexp_replace(text, '(?is)<(script|style)\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS h FROM p),
b AS (SELECT k, w, regexp_replace(regexp_replace(h, '(?i)</?({_BLOCK_TAGS})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a), u AS (SELECT k, w, {unescape_sql('t')} AS t FROM b, e),
l AS (SELECT k, w, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM u),
r AS (SELECT k, w, unnest(range(len(l))) AS no, unnest(l) AS line FROM l)"""


def _title_sql(x: str, value: int) -> str:
    """The key (0) or relevance (1) of the first title rule that fits; "employee-owner" is taken out before owners are looked for."""
    own = lambda k: f"regexp_replace({x}, '(?i)employee[- ]owner', 'employee', 'g')" if k == "owner_founder" else x
    rules = " ".join(f"WHEN regexp_matches({own(r[0])}, {quoted(r[2].replace('(?<!employee[- ])', ''))}) THEN {quoted(r[value])}" for r in N.TITLE_RULES)
    return f"CASE {rules} ELSE '{('other', 'excluded')[value]}' END"


_LISTED = lambda words: "[" + ", ".join(map(quoted, words)) + "]"
#: What a line is on its own: f(str, key, relevance, label, title, shaped, bare, words, named, menu).
_FEATURES = rf"""g AS (SELECT str, {_title_sql('str', 0)} AS key, {_title_sql('str', 1)} AS relevance,
      length(str) BETWEEN 1 AND {N.MAX_TITLE} AND NOT regexp_matches(str, {quoted(N.PROSE_MARKERS)}) AND NOT regexp_matches(str, {quoted(N.DOCUMENT_MARKERS)}) AND NOT (str[-1] = '.') AND NOT contains(str, '?') AND NOT contains(lower(str), 'http') AS label,
      trim(regexp_replace(trim(regexp_replace(str, {quoted(N.NAME_SUFFIX)}, '')), '^,+|,+$', '', 'g')) AS bare FROM s),
f AS (SELECT *, label AND key <> 'other' AS title, label AND regexp_matches(str, '[A-Za-z]') AND len(string_split_regex(trim(str), '\s+')) <= 8 AS shaped,
      list_transform(string_split_regex(bare, '\s+'), lambda x: regexp_replace(upper(x), '^\.+|\.+$', '', 'g')) AS words,
      length(str) BETWEEN 1 AND {N.MAX_NAME} AND regexp_matches(bare, {quoted(N.NAME)}) AND NOT list_has_any(list_transform(string_split_regex(bare, '\s+'), lambda x: regexp_replace(upper(x), '^\.+|\.+$', '', 'g')), {_LISTED((*N.NAME_STOP_WORDS, *N.FUNCTION_WORDS))})
        AND {_title_sql('bare', 0)} = 'other' AS named,
      regexp_matches(bare, {quoted(N.ROLE_SHAPED)}) OR list_has_any(list_transform(string_split_regex(bare, '\s+'), lambda x: regexp_replace(upper(x), '^[.,]+|[.,]+$', '', 'g')), {_LISTED(N.DOMAIN_WORDS)}) AS menu FROM g)"""


def _lines(spark, sf):
    standin(spark, sf)
    return spark.sql(planted(ROSTERS, **_ROSTER_PAGES)).select("k", "w", F.posexplode(T.block_lines(F.col("text"))).alias("no", "line"))


@query(f"""WITH {_NAMES}, {_LINES}, s AS (SELECT DISTINCT line AS str FROM r), {_FEATURES}
SELECT k, no::INT AS no, key, relevance, title, shaped, named AND NOT list_has_all([upper(w), 'WORKS'], words) AS name FROM r JOIN f ON f.str = r.line""")
def label_classifiers(spark, sf):
    """Each line of each page: the title it holds, whether it is a title, is shaped like one, or is a person's name."""
    lines = _lines(spark, sf)
    line, key = F.col("line"), N.title_key(F.col("line"))
    own = F.array(F.upper("w"), F.lit("WORKS"))
    return lines.select("k", "no", key["key"].alias("key"), key["relevance"].alias("relevance"), N.is_title(line).alias("title"), N.is_title_shaped(line).alias("shaped"), N.is_name(line, own).alias("name"))


@query(rf"""WITH {_NAMES}, {_LINES},
q AS (SELECT *, coalesce(lead(line) OVER z, '') AS next, coalesce(lag(line) OVER z, '') AS last, regexp_extract(line, '^(.*?)\s*(?:,|–|—|\||•|\s-\s)\s*(.*)$', ['a', 'b']) AS pair FROM r WINDOW z AS (PARTITION BY k ORDER BY no)),
s AS (SELECT DISTINCT str FROM (SELECT line AS str FROM r UNION ALL SELECT trim(pair.a) FROM q UNION ALL SELECT trim(pair.b) FROM q UNION ALL SELECT '')), {_FEATURES},
c AS (SELECT q.k, q.no, x.bare AS line_name, lf.bare AS left_name, rt.str AS right_title, n.str AS next, v.str AS last, n.title AS next_title, v.title AS last_title, n.shaped AND NOT (n.named AND NOT list_has_all([upper(w), 'WORKS'], n.words)) AS next_shaped,
      v.shaped AND NOT (v.named AND NOT list_has_all([upper(w), 'WORKS'], v.words)) AS last_shaped, rt.title AND rt.str <> '' AS right_is, lf.named AND NOT list_has_all([upper(w), 'WORKS'], lf.words) AS left_named, x.named AND NOT list_has_all([upper(w), 'WORKS'], x.words) AS named
      FROM q JOIN f x ON x.str = q.line JOIN f n ON n.str = q.next JOIN f v ON v.str = q.last JOIN f lf ON lf.str = trim(q.pair.a) JOIN f rt ON rt.str = trim(q.pair.b)),
y AS (SELECT *, CASE WHEN next <> '' AND next_shaped THEN next WHEN last <> '' AND last_shaped THEN last ELSE '' END AS label FROM c),
t AS (SELECT k, no, CASE WHEN right_is AND left_named THEN 'joined' WHEN NOT named THEN NULL WHEN next_title THEN 'name_then_title' WHEN last_title THEN 'title_then_name' WHEN label = '' THEN 'low_grade_untitled'
      WHEN regexp_matches(label, {quoted(N.ROLE_SHAPED)}) THEN 'low_grade_role' ELSE '' END AS layout, CASE WHEN right_is AND left_named THEN left_name ELSE line_name END AS name,
      CASE WHEN right_is AND left_named THEN right_title WHEN next_title THEN next WHEN last_title THEN last ELSE label END AS title FROM y),
i AS (SELECT t.*, CASE WHEN layout = '' THEN 'adjacent_label_not_role_shaped' WHEN layout ^@ 'low' AND m.menu THEN 'low_grade_name_is_label' ELSE '' END AS refused FROM t LEFT JOIN f m ON m.str = t.name WHERE layout IS NOT NULL),
j AS (SELECT * REPLACE (CASE WHEN refused = '' AND row_number() OVER (PARTITION BY k, refused, regexp_replace(lower(name), '[^a-z]', '', 'g') ORDER BY no) > 1 THEN 'duplicate_person' ELSE refused END AS refused) FROM i),
o AS (SELECT * REPLACE (CASE WHEN refused = '' AND layout ^@ 'low' AND NOT EXISTS (SELECT 1 FROM j z WHERE z.k = j.k AND z.refused = '' AND NOT z.layout ^@ 'low' AND abs(z.no - j.no) <= 8) THEN 'low_grade_no_roster_neighbour' ELSE refused END AS refused) FROM j),
w AS (SELECT *, row_number() OVER (PARTITION BY k, layout ^@ 'low', refused ORDER BY no) AS turn FROM o)
SELECT w.k, w.no::INT AS no, w.name, w.title, layout, CASE WHEN w.title = '' THEN 'unconfirmed' WHEN layout = '' OR layout ^@ 'low' THEN 'other' ELSE tk.key END AS key, CASE WHEN layout = '' OR layout ^@ 'low' THEN 'unconfirmed' ELSE tk.relevance END AS relevance,
  CASE layout {' '.join(f"WHEN '{a}' THEN {b}" for a, b in O.CONFIDENCE.items())} END::DOUBLE AS confidence,
  CASE WHEN refused = '' AND layout ^@ 'low' AND turn > 10 THEN 'suppressed_by_low_grade_cap' WHEN refused = '' AND turn > 40 THEN 'suppressed_by_cap' ELSE refused END AS refused FROM w JOIN f tk ON tk.str = w.title""")
def roster_pairs(spark, sf):
    """People of each page: names beside titles in three layouts, the low-grade tier near confirmed people, and everybody refused with the reason."""
    found = O.roster(_lines(spark, sf), "k", "no", "line", F.array(F.upper("w"), F.lit("WORKS")), admit_untitled=True)
    return found.select("k", "no", "name", "title", "layout", "key", "relevance", "confidence", "refused")


REASONS = (
    "The {w} unit ships. A software error stopped it.", "Batch record was not kept; {w} lot.", "The firmware of {w} is new. The housing did not hold.", "The software of {w} found it as designed.", "A manufacturing defect in {w}.",
    "Human error and missing change control at {w}.", "Cracked housing of {w}.", "Equipment failure in analytics and an ERP.", "An equipment malfunction; nothing else.", "Sensor fine. Mislabeled lots were not found.",
    "Allergen control was inadequate, labels missing.", "Sterilization cycle out of specification", "Product may contain undeclared milk", "labelling mix-up; a data entry clerk", "The algorithm works. Traceability works.",
    "CAPA not in compliance with the quality control process", "Manufacturing defects and a training gap", "missing required net weight label", "Environmental monitoring, nonconforming; SCADA", "equipment failure. A defect.",
)


@query(rf"""WITH d AS ({planted(REASONS, '. ')}),
s AS (SELECT k * 100000 + no AS k, k AS doc, no, text FROM (SELECT k, unnest(range(len(l))) AS no, unnest(l) AS text FROM (
      SELECT k, list_transform(string_split(regexp_replace(text, '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)) AS l FROM d)) WHERE text <> '' AND regexp_matches(text, {quoted(P.PROCESS_CAUSE)})),
{themes_sql('s', THEMES, 'h')},
b AS (SELECT x.k, min(h.theme) AS theme FROM s x JOIN h ON h.k = x.k AND admitted GROUP BY x.k),
c AS (SELECT s.*, CASE {' '.join(f"WHEN regexp_matches(text, {quoted(rx)}) THEN {quoted(t)}" for rx, t in P.CAUSES)} ELSE b.theme END AS theme,
      CASE {' '.join(f"WHEN regexp_matches(text, {quoted(rx)}) THEN regexp_extract(text, {quoted(rx)})" for rx, _ in P.CAUSES)} ELSE
      coalesce((SELECT arg_min(regexp_extract(o.own, o.rx), o.generic::INT * 1000 + o.turn) FROM (SELECT *, row_number() OVER () AS turn FROM h_x) o WHERE o.k = s.k AND o.theme = b.theme AND regexp_matches(o.own, o.rx)), '') END AS cue,
      regexp_matches(text, {quoted(P.FAILED)}) AS failed FROM s LEFT JOIN b USING (k)),
f AS (SELECT doc, min(no) FILTER (failed) AS blamed, min(no) FILTER (theme IS NOT NULL) AS weak FROM c GROUP BY doc),
t AS (SELECT d.k, d.text, x.theme AS strong_theme, x.cue AS strong_cue, y.theme AS weak_theme, y.cue AS weak_cue FROM d LEFT JOIN f ON f.doc = d.k LEFT JOIN c x ON x.doc = d.k AND x.no = f.blamed LEFT JOIN c y ON y.doc = d.k AND y.no = f.weak AND regexp_matches(d.text, {quoted(P.FAILED)}))
SELECT k, CASE WHEN strong_theme IS NOT NULL THEN strong_theme WHEN weak_theme IS NOT NULL THEN weak_theme WHEN regexp_matches(text, {quoted(P.SYMPTOM)}) THEN 'digital_transformation_process' END AS theme,
  CASE WHEN strong_theme IS NOT NULL THEN 'strong' WHEN weak_theme IS NOT NULL THEN 'weak' WHEN regexp_matches(text, {quoted(P.SYMPTOM)}) THEN 'weak_symptom' END AS tier,
  CASE WHEN strong_theme IS NOT NULL THEN strong_cue WHEN weak_theme IS NOT NULL THEN weak_cue WHEN regexp_matches(text, {quoted(P.SYMPTOM)}) THEN regexp_extract(text, {quoted(P.SYMPTOM)}) END AS cue FROM t""")
def process_cause(spark, sf):
    """The process that each text blames: in the sentence that tells of the failure, weakly where the failure stands elsewhere, or as a bare symptom."""
    standin(spark, sf)
    return spark.sql(planted(REASONS, ". ")).select("k", P.process_cause(F.col("text")).alias("c")).select("k", "c.theme", "c.tier", "c.cue")


_OWNED = planted(REMARKS, more=", source")


@query(f"WITH d AS ({_OWNED}), {themes_sql('d', THEMES, 'h')} SELECT theme, count(*) FILTER (NOT admitted) AS refused, count(*) FILTER (admitted) AS admitted FROM h GROUP BY theme")
def theme_refusals(spark, sf):
    """How often each theme was seen and not admitted, as only a lone generic term showed it."""
    standin(spark, sf)
    t = spark.sql(_OWNED).select(F.explode(classify(F.col("text"))).alias("t")).select("t.theme", "t.admitted")
    return t.groupBy("theme").agg(F.count_if(~F.col("admitted")).alias("refused"), F.count_if("admitted").alias("admitted"))


@query(f"""WITH d AS ({_OWNED}), {themes_sql('d', THEMES, 'h')} SELECT d.source, h.theme, count(*) AS evidence_count, min(d.k) AS first_id, array_to_string(list_sort(list(CAST(d.k AS VARCHAR)))[1:4], ';') AS ids
FROM h JOIN d ON h.k = d.k WHERE admitted GROUP BY ALL""")
def claim_builder_by_theme(spark, sf):
    """A claim for each source and theme: how much evidence, and the first ids."""
    standin(spark, sf)
    rows = spark.sql(_OWNED).select("source", "k", F.explode(F.filter(classify(F.col("text")), lambda t: t["admitted"])).alias("t")).select("source", "t.theme", F.col("k").alias("doc_id"), F.col("k").cast("string").alias("id"))
    groups = rows.groupBy("source", "theme").agg(F.count("*").alias("evidence_count"), F.min("doc_id").alias("first_id"))
    return coverage.with_first(groups, rows, ["source", "theme"], "id", 4).select("source", "theme", "evidence_count", "first_id", F.array_join("_first", ";").alias("ids"))


#: Three reviews for each employer: documents with remarks, of which those under 40 characters say nothing.
@query(f"""WITH d AS (SELECT * FROM ({planted(REMARKS)}) WHERE length(text) >= 40), {themes_sql('d', THEMES, 'h')}, {themes_sql('d', P.BUYER_VOICE, 'v')},
x AS (SELECT k, theme, regexp_replace(lower(regexp_extract(own, rx)), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') AS term FROM (FROM h_x UNION ALL FROM v_x) WHERE regexp_matches(own, rx)),
a AS (SELECT DISTINCT k, theme FROM (FROM h UNION ALL FROM v) WHERE admitted)
SELECT a.k // 3 AS employer, a.theme, count(DISTINCT a.k) AS reviews, count(DISTINCT x.term) AS terms, count(DISTINCT a.k) >= 2 OR count(DISTINCT x.term) >= 2 AS admitted FROM a JOIN x ON x.k = a.k AND x.theme = a.theme GROUP BY 1, 2""")
def review_theme_admission(spark, sf):
    """Themes of the reviews of each employer: one counts if two reviews or two different terms show it."""
    standin(spark, sf)
    rows = spark.sql(planted(REMARKS)).where(F.length("text") >= 40)
    # A theme's terms are those of both vocabularies, in the reviews that admit it by either.
    both = F.concat(classify(F.col("text"), THEMES), classify(F.col("text"), P.BUYER_VOICE))
    hits = rows.select("k", F.explode(both).alias("t")).select("k", "t.theme", "t.admitted", "t.hits")
    per = hits.groupBy("k", "theme").agg(F.bool_or("admitted").alias("any"), F.flatten(F.collect_list("hits")).alias("hits")).where("any")
    each = per.select(F.expr("k DIV 3").alias("employer"), "theme", "k", F.explode("hits").alias("hit"))
    g = each.groupBy("employer", "theme").agg(F.count_distinct("k").alias("reviews"), F.count_distinct(F.lower("hit")).alias("terms"))
    return g.withColumn("admitted", (F.col("reviews") >= 2) | (F.col("terms") >= 2))
