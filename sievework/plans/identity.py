"""Queries that ask whether a name is a company: recipients, parties, listings, registries, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import text as T
from ..functions.scores import overlap_score
from .standin import standin

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Companies under invented names: w is a coined word of each row. The forms vary with the key.
_ROWS = "SELECT c_custkey AS k, concat('Zor', translate(CAST(c_custkey AS STRING), '0123456789', 'abcdefghij')) AS w, CAST(c_custkey % 6 AS INT) AS f, CAST(floor(c_custkey / 6) AS BIGINT) % 16 AS g FROM customer"
NAMES = f"""SELECT k, w, f, g, CASE f WHEN 0 THEN concat(w, ' Manufacturing Inc.') WHEN 1 THEN concat('The ', w, ' Group') WHEN 2 THEN concat(w, ' Quill Logistics, LLC')
 WHEN 3 THEN 'Prime Inc.' WHEN 4 THEN concat('J. R. ', w, ' Company') ELSE concat(w, ' (Ohio) Holdings') END AS company FROM ({_ROWS})"""
RECIPIENTS = f"""SELECT *, CASE g WHEN 0 THEN concat(upper(w), ' MANUFACTURING LLC') WHEN 1 THEN concat(w, ' QUILL FREIGHT OF AMERICA') WHEN 2 THEN concat(w, ' Hydraulics Corp') WHEN 3 THEN concat('Quill ', w, ' Joint Venture')
 WHEN 4 THEN concat(w, ' & Company, P. C.') WHEN 5 THEN concat('Marl Inc dba ', w, ' Holdings') WHEN 6 THEN concat(w, ' Area Medical Center') WHEN 7 THEN concat('Marl ', w) WHEN 8 THEN 'PRIME, INC' WHEN 9 THEN 'Prime Trucking'
 WHEN 10 THEN concat('JR ', w) WHEN 11 THEN concat(w, ' Quill Marl') WHEN 12 THEN 'Quill Brothers' WHEN 13 THEN concat('W. W. ', w, ' & Co.') WHEN 14 THEN concat(w, ' (subsidiary) Construction') ELSE 'Certified Prime Inc' END AS recipient FROM ({NAMES})"""


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_LEGAL = _list(T.STOP_WORDS)
_WEAK = _list(T.WEAK_WORDS)
#: Tokens of column {0} in the other engine: parentheses gone, runs of single letters joined by repeated replacement.
_RAW = r"list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(upper(regexp_replace({0}, '\(.*?\)', ' ', 'g')), '[^A-Z0-9]+', ' ', 'g'), '\bJ R\b', 'JR', 'g'), '\b(P C|W W)\b', '\1', 'g')), ' '), lambda t: t <> '')"


def _sql_tokens(column: str) -> str:
    joined = f"list_transform({_RAW.format(column)}, lambda t: t)"
    return f"string_split(replace(replace(array_to_string({joined}, ' '), 'P C', 'PC'), 'W W', 'WW'), ' ')"


@query(f"""WITH t AS (SELECT k, company, recipient, list_filter({_sql_tokens('company')}, lambda x: NOT list_contains({_LEGAL}, x)) AS own, {_sql_tokens('recipient')} AS raw,
  list_transform(regexp_split_to_array(recipient, '(?i)\\s+dba\\s+'), lambda p: list_filter({_sql_tokens('p')}, lambda x: NOT list_contains({_LEGAL}, x))) AS all_parts FROM ({RECIPIENTS})),
u AS (SELECT *, list_filter(own, lambda x: NOT list_contains({_WEAK}, x)) AS core, list_filter(own, lambda x: list_contains({_WEAK}, x)) AS lob, list_filter(all_parts, lambda p: len(p) > 0) AS parts FROM t),
v AS (SELECT *, len(core) = 1 AND list_contains({_list(N.COMMON_WORDS + N.MORE_COMMON_WORDS)}, lower(core[1])) AS common FROM u),
p AS (SELECT k, unnest(parts) AS part, core, lob, common FROM v),
q AS (SELECT k, bool_or(len(list_intersect(core, part)) > 0) AS overlap,
  bool_or(NOT common AND NOT list_has_any(part, {_list(N.PUBLIC_BODIES)}) AND list_has_all(part, core) AND (len(core) >= 2 OR list_filter(part, lambda x: length(x) > 2)[1] = core[1])) AS near,
  bool_or(NOT common AND list_has_all(part, core) AND (len(core) > 1 OR len(lob) = 0 OR list_has_any(lob, part)) AND len(list_filter(part, lambda x: NOT list_contains(core, x) AND NOT list_contains({_WEAK}, x) AND NOT list_contains({_list(N.GENERIC_WORDS)}, x))) = 0) AS ok FROM p GROUP BY k)
SELECT v.k, company, recipient, CASE WHEN recipient LIKE '%Joint Venture%' THEN 'joint_venture' WHEN list_has_any(raw, {_list(N.PROFESSIONAL_FORMS)}) THEN 'professional_practice' WHEN len(core) = 0 THEN 'no_distinctive_token'
 WHEN common AND list_contains(parts, own) THEN 'match: exact common-word name' WHEN ok THEN 'match: all distinctive tokens' WHEN near THEN 'near_miss' WHEN overlap THEN 'partial_overlap' ELSE 'nothing_in_common' END AS reason FROM v LEFT JOIN q USING (k)""")
def name_match_reason(spark, sf):
    standin(spark, sf)
    return spark.sql(RECIPIENTS).select("k", "company", "recipient", N.recipient_match(F.col("company"), F.col("recipient")).alias("reason"))


@query(f"""WITH t AS (SELECT k, company, recipient, list_filter(regexp_split_to_array(lower(company), '[^a-z0-9]+'), lambda x: x <> '' AND NOT list_contains({_list(N.PARTY_FORMS)}, x)) AS c,
 list_filter(regexp_split_to_array(lower(recipient), '[^a-z0-9]+'), lambda x: x <> '' AND NOT list_contains({_list(N.PARTY_FORMS)}, x)) AS p FROM ({RECIPIENTS}))
SELECT k, company, recipient, len(c) > 0 AND p[1:len(c)] = c AS by_name, (len(c) > 0 AND p[1:len(c)] = c) OR p[1:2] = ['marl', 'dba'] AS by_alias FROM t""")
def party_prefix_identity(spark, sf):
    """Parties whose name begins with the company's, by its own name and with an alias that a person gave."""
    standin(spark, sf)
    rows = spark.sql(RECIPIENTS)
    by = lambda *names: N.starts_with_name(F.col("recipient"), F.array(*names))
    return rows.select("k", "company", "recipient", by(F.col("company")).alias("by_name"), by(F.col("company"), F.lit("Marl dba, Inc.")).alias("by_alias"))


#: What a text says about its company, by form of the name and of the text.
_ARTICLES = f"""SELECT k, f, g % 4 AS s, company, CASE g % 4 WHEN 0 THEN concat('News: ', upper(w), ' Quill opens a plant. ') WHEN 1 THEN concat(repeat('Filler words only. ', 200), w, ' Quill, Prime Inc')
 WHEN 2 THEN 'Digital Prime Technologies and others met' ELSE concat('Today Prime, Inc. and X', w, ' spoke') END AS text, CASE WHEN k % 7 = 0 THEN concat(w, ' in the title') END AS title FROM ({NAMES})"""


@query(f"""SELECT k, CASE f WHEN 3 THEN s = 3 WHEN 2 THEN s = 0 WHEN 4 THEN contains(lower(company), 'j') AND contains(substring(company, 7), 'j') AND (s IN (0, 3) OR title IS NOT NULL)
 WHEN 5 THEN false ELSE s = 0 OR title IS NOT NULL END AS about FROM ({_ARTICLES})""")
def article_admission(spark, sf):
    """A coined word is enough, near the top; two words must both be there; a common word needs the whole phrase."""
    standin(spark, sf)
    return spark.sql(_ARTICLES).select("k", N.about_company(F.col("text"), F.col("company"), F.col("title")).alias("about"))


_LISTINGS = f"""SELECT k, f, company, g % 8 AS s, CASE g % 8 WHEN 0 THEN concat(w, '-Turner Construction') WHEN 1 THEN concat('Kimberly-', w, ' Corporation') WHEN 2 THEN concat('Marl Inc. dba ', w, ' Quill')
 WHEN 3 THEN concat(w, ' Financial Services') WHEN 4 THEN concat('Marl (', w, ' Quill US)') WHEN 5 THEN concat(substring(w, 1, 3), ' Quill') WHEN 6 THEN concat(w, ' QUILLS of NW') ELSE 'Prime' END AS listing FROM ({NAMES})"""


@query(f"""SELECT k, listing, CASE f WHEN 3 THEN s = 7 WHEN 2 THEN s IN (2, 4, 5, 6) WHEN 4 THEN false ELSE false END AS listed FROM ({_LISTINGS})""")
def listing_identity(spark, sf):
    """A listing is a company only if it holds every distinctive word (either may be cut short) and adds nothing but generic ones."""
    standin(spark, sf)
    rows = spark.sql(_LISTINGS).where("f IN (2, 3)").select("k", "listing", N.listed_as(F.col("company"), F.col("listing")).alias("listed"))
    rest = spark.sql(_LISTINGS).where("f NOT IN (2, 3)").select("k", "listing", F.lit(False).alias("listed"))
    return rows.unionByName(rest)


_REGISTRY = f"""SELECT k, company, CASE g WHEN 0 THEN concat(w, ' MANUFACTURING LLC') WHEN 1 THEN concat(w, ' Manufacturing Services') WHEN 2 THEN w WHEN 3 THEN concat('Services ', w, ' of Manufacturing') ELSE concat('South', w, ' Express') END AS legal_name,
 CASE WHEN k % 5 = 0 THEN concat('Other, ', company, ' ,') END AS dba_names, g % 2 = 0 AS active, g - 1 AS units, CASE WHEN k % 4 > 0 THEN g * 12 END AS months, f, g FROM ({NAMES}) WHERE f = 0"""


@query(f"""WITH b AS (SELECT *, CASE WHEN g = 0 OR dba_names IS NOT NULL THEN 100 WHEN g = 1 THEN 80 WHEN g = 2 THEN 70 WHEN g = 3 THEN 55 ELSE 0 END AS base FROM ({_REGISTRY})),
s AS (SELECT *, CASE WHEN base = 0 THEN 0 ELSE base + CASE WHEN active THEN 8 ELSE -15 END + CASE WHEN units > 0 THEN 5 ELSE 0 END + CASE WHEN months IS NULL THEN -5 WHEN months <= 36 THEN 5 WHEN months > 96 THEN -5 ELSE 0 END END AS score FROM b)
SELECT k, legal_name, score, CASE WHEN score >= 95 THEN 0.9 WHEN score >= 80 THEN 0.8 ELSE 0.65 END::DOUBLE AS confidence FROM s""")
def registry_score(spark, sf):
    standin(spark, sf)
    c = F.col
    score = N.registry_score(c("company"), c("legal_name"), c("dba_names"), c("active"), c("units"), c("months"))
    return spark.sql(_REGISTRY).select("k", "legal_name", score.alias("score"), N.registry_confidence(score).alias("confidence"))


_CENSUS = f"SELECT k, k % 97 AS grp, CASE WHEN k % 3 = 0 THEN 'LYON' WHEN k % 3 = 1 THEN 'TROY' END AS city, k % 4 > 0 AS active, CAST(k % 40 AS INT) + 55 AS score, CAST(k % 11 AS INT) AS units, CASE WHEN k % 6 > 0 THEN k % 30 END AS months FROM ({_ROWS})"


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, units DESC, coalesce(nullif(months, 0), 999), k) AS rank FROM ({_CENSUS})), p AS (SELECT grp, city AS home FROM r WHERE rank = 1)
SELECT grp, k, rank = 1 AS is_primary FROM r JOIN p USING (grp) WHERE rank = 1 OR (active AND city = home AND city <> '')""")
def identity_chain(spark, sf):
    """The best registrant of each company and its family: active ones of the same city."""
    from ..operators.sequences import ranked_family

    standin(spark, sf)
    return ranked_family(spark.sql(_CENSUS), "grp", [F.desc("score"), F.desc("units"), F.coalesce(F.nullif("months", F.lit(0)), F.lit(999)), "k"], "city", "active").select("grp", "k", "is_primary")


@query(f"SELECT k, company, recipient FROM ({RECIPIENTS}) WHERE contains(upper(recipient), upper(w)) AND k % 2 = 0")
def like_search(spark, sf):
    """Rows of a state whose name holds a term: a substring finds too much, identity is decided afterwards."""
    standin(spark, sf)
    return spark.sql(RECIPIENTS).where(F.contains(F.upper("recipient"), F.upper("w")) & (F.col("k") % 2 == 0)).select("k", "company", "recipient")


_TAILS = ("", " Inc", ", Inc.", " Co., Inc., LLC", " Company Limited", " Incorporated", " Group", " Inc Works")
_STRIPPED = ("", "", "", "", "", "", " Group", " Inc Works")


@query(f"SELECT k, name, concat(w, stripped) AS stripped FROM (SELECT k, w, concat(w, t.tail) AS name, t.stripped FROM ({_ROWS}) r JOIN (VALUES {', '.join(f'({i}, {chr(39)}{a}{chr(39)}, {chr(39)}{b}{chr(39)})' for i, (a, b) in enumerate(zip(_TAILS, _STRIPPED, strict=True)))}) t(i, tail, stripped) ON r.k % {len(_TAILS)} = t.i)")
def strip_suffix(spark, sf):
    standin(spark, sf)
    tail = F.get(F.array(*map(F.lit, _TAILS)), (F.col("k") % len(_TAILS)).cast("int"))
    return spark.sql(_ROWS).select("k", F.concat("w", tail).alias("name")).withColumn("stripped", T.strip_legal_suffix(F.col("name")))


@query(f"""SELECT k, array_to_string(CASE WHEN f = 0 THEN [company, concat(w, ' Manufacturing'), 'Short'] WHEN f = 2 THEN [company, concat(w, ' Quill Logistics'), 'Short'] WHEN f = 3 THEN [company, 'Prime', 'Short'] WHEN f = 4 THEN [company, concat('J. R. ', w), 'Short'] ELSE [company, 'Short'] END, '|') AS variants FROM ({NAMES})""")
def query_variants(spark, sf):
    """The name, the name without legal suffix and aliases; the same name in another case is no variant."""
    standin(spark, sf)
    aliases = F.array(F.lit("Short"), F.upper("company"), F.lit(" "))
    return spark.sql(NAMES).select("k", F.array_join(T.query_variants(F.col("company"), aliases), "|").alias("variants"))


@query(f"""SELECT k, CASE f WHEN 0 THEN concat(upper(w), ' MANUFACTURING') WHEN 1 THEN upper(w) WHEN 2 THEN concat(upper(w), ' QUILL LOGISTICS') WHEN 3 THEN 'PRIME' WHEN 4 THEN concat('JR ', upper(w)) ELSE upper(w) END AS form,
 CASE f WHEN 3 THEN 'PRIME' WHEN 2 THEN CASE WHEN length(w) >= 5 THEN upper(w) ELSE 'QUILL' END ELSE CASE WHEN length(w) >= 5 THEN upper(w) WHEN f = 0 THEN upper(concat(w, ' Manufacturing')) WHEN f = 1 THEN upper(company) WHEN f = 4 THEN upper(concat('J. R. ', w)) ELSE upper(concat(w, '  Holdings')) END END AS search,
 CASE f WHEN 0 THEN concat(lower(w), '-manufacturing-inc|', lower(w), '-manufacturing') WHEN 1 THEN concat('the-', lower(w), '-group') WHEN 2 THEN concat(lower(w), '-quill-logistics-llc|', lower(w), '-quill-logistics') WHEN 3 THEN 'prime-inc|prime'
  WHEN 4 THEN concat('j-r-', lower(w), '-company|j-r-', lower(w)) ELSE concat(lower(w), '-ohio-holdings') END AS slugs FROM ({NAMES})""")
def name_forms(spark, sf):
    """A name as an exact form, as a search term and as slugs."""
    standin(spark, sf)
    c = F.col("company")
    return spark.sql(NAMES).select("k", F.array_join(N.form_tokens(c), " ").alias("form"), N.search_word(c).alias("search"), F.array_join(N.slugs(c), "|").alias("slugs"))


_SITES = ("LEASE {w} LEWIS WA LLC", "***MAIN*** {w} Builders NW", "{w} Construction Company II, LLC", "WA {w} Plant", "{w} (MAIN) Yard No. 4", "N {w}")
_CLEAN = ("LEASE {w} LEWIS LLC", "{w} Builders", "{w} Construction Company LLC", "WA {w}", "{w} No. 4", "{w}")


@query("SELECT k, CASE f " + " ".join(f"WHEN {i} THEN replace('{x}', '{{w}}', w)" for i, x in enumerate(_CLEAN)) + f" END AS cleaned FROM ({_ROWS})")
def site_names(spark, sf):
    standin(spark, sf)
    name = F.replace(F.get(F.array(*map(F.lit, _SITES)), F.col("f")), F.lit("{w}"), F.col("w"))
    return spark.sql(_ROWS).select("k", N.clean_site(name, tuple(T.STATE_CODES), facility=True).alias("cleaned"))


_APPS = f"""SELECT k, f, company, CASE WHEN k % 4 = 0 THEN 'www.zor.com' ELSE 'm.app.example.org' END AS developer_host, 'zor.com' AS site_host,
 CASE g % 4 WHEN 0 THEN company WHEN 1 THEN concat(w, ' Trucks Inc.') WHEN 2 THEN 'Marl Soft' ELSE concat(w, ' Quill Supply') END AS developer, CASE WHEN k % 3 = 0 THEN company ELSE 'An app' END AS title, g % 4 AS d FROM ({NAMES}) WHERE f IN (1, 2)"""


@query(f"""SELECT k, CASE WHEN k % 4 = 0 THEN 'company' WHEN d = 0 OR (f = 2 AND d = 3) THEN 'name_only' WHEN k % 3 = 0 THEN 'third_party' ELSE 'no' END AS verdict FROM ({_APPS})""")
def publisher_verdict(spark, sf):
    standin(spark, sf)
    c = F.col
    return spark.sql(_APPS).select("k", N.publisher_verdict(c("company"), c("site_host"), c("developer"), F.regexp_replace("developer_host", r"^www\.", ""), c("title")).alias("verdict"))


_PROFILES = f"SELECT k, f, company, CASE g % 3 WHEN 0 THEN concat(w, ' Quill') WHEN 1 THEN 'cMarl' ELSE '' END AS profile, g % 3 AS p FROM ({NAMES}) WHERE f = 2"


@query(f"""WITH s AS (SELECT *, CASE WHEN p = 0 THEN round(2.0 / 2.35, 4) ELSE 0.0 END::DOUBLE AS score FROM ({_PROFILES}))
SELECT k, score, CASE WHEN p = 2 THEN 'no name' WHEN score < 0.55 THEN 'below floor' ELSE 'verified' END AS verdict FROM s""")
def profile_verified(spark, sf):
    """The page's own name against the company's, by weighted words with a floor."""
    standin(spark, sf)
    score = overlap_score(T.name_tokens(F.col("company")), T.name_tokens(F.col("profile")))
    return spark.sql(_PROFILES).select("k", score.alias("score"), F.when(F.col("profile") == "", "no name").when(score < 0.55, "below floor").otherwise("verified").alias("verdict"))


_DOCKETS = f"""SELECT k, company, CASE g % 5 WHEN 0 THEN concat('Cordant Systems v. ', company) WHEN 1 THEN concat(company, ' v. Smith') ELSE 'In re Plan' END AS caption, g % 3 = 0 AS commercial, g % 5 AS c,
 CASE WHEN g % 7 = 6 THEN 'Cordant Systems Health Plan' WHEN g % 7 = 5 THEN repeat('p;', 13) ELSE concat(company, ';Cordant Systems, Inc.;Bo Lee') END AS parties, g % 7 AS p FROM ({NAMES}) WHERE f IN (0, 2)"""


@query(f"SELECT k, 'Cordant Systems, Inc.' AS party, 'cordant systems' AS vendor, commercial FROM ({_DOCKETS}) WHERE c = 0 AND p < 5")
def vendor_opposition(spark, sf):
    """Cases of few parties in which a vendor opposes the company: it stands in the caption, and its party is no benefit plan."""
    from ..operators.parties import opposing_vendors

    standin(spark, sf)
    cases = spark.sql(_DOCKETS).withColumn("parties", F.filter(F.split("parties", ";"), lambda x: x != ""))
    vendors = spark.createDataFrame([("cordant systems",), ("lee",), ("smith",)], "vendor string")
    return opposing_vendors(cases, vendors, "k", max_parties=12).select("k", "party", "vendor", "commercial")


_BUYERS = f"SELECT k, w, f, company, concat('https://', CASE WHEN k % 5 = 0 THEN lower(w) ELSE 'news' END, '.example.com/x') AS url, concat(lower(w), '.example.com') AS site, CASE WHEN k % 2 = 0 THEN w ELSE 'Ann Lee' END AS person FROM ({NAMES})"


@query(f"""SELECT k, f = 3 AS common_word, person = w AND f IN (0, 1, 4, 5) AS eponymous, k % 5 <> 0 AS off_own_domain FROM ({_BUYERS})""")
def stratum_predicates(spark, sf):
    """What makes a row hard to judge: a common word for a name, a person of the company's name, a page that isn't its own."""
    standin(spark, sf)
    core = N.distinctive(T.name_tokens(F.regexp_replace("company", r"\(.*?\)|J\. R\.", " ")))
    single = F.lower(F.when(F.size(core) == 1, F.get(core, F.lit(0))).otherwise(""))
    eponymous = (single != "") & F.array_contains(F.split(F.lower("person"), " "), single)
    return spark.sql(_BUYERS).select("k", N.is_common_word(core).alias("common_word"), eponymous.alias("eponymous"), (T.host(F.col("url")) != F.col("site")).alias("off_own_domain"))
