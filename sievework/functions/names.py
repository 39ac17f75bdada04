"""Is this name that company? Token rules over organisation names, with reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import overlap_score
from .text import STOP_WORDS, WEAK_WORDS, name_tokens, registrable, strip_legal_suffix

#: Dictionary words that are company names and identify nobody; more of them among procurement names.
COMMON_WORDS = (
    "prime", "summit", "pioneer", "legacy", "liberty", "sterling", "premier", "united", "general", "standard", "superior", "capital", "central", "continental", "empire",
    "frontier", "guardian", "heritage", "horizon", "independent", "keystone", "landmark", "meridian", "monarch", "paramount", "patriot", "pinnacle", "reliable", "republic",
    "sentinel", "signature", "sovereign", "titan", "triumph", "unity", "vanguard", "venture", "western", "eastern", "northern", "southern", "atlantic", "pacific",
    "diamond", "eagle", "falcon", "phoenix", "apex", "alpha", "omega", "delta", "vertex", "crown", "regal", "royal", "elite", "select", "quality", "precision", "advance",
    "advanced", "dynamic", "integrated", "unified", "core", "peak", "crest",
)
MORE_COMMON_WORDS = ("power", "commercial", "coastal", "savage", "crane", "diagnostics", "admiral", "product", "sales", "structures", "engineered", "nicholas")
#: Words that add nothing to an organisation's identity; licensed practices; public bodies; registry suffixes; legal forms of parties.
GENERIC_WORDS = (
    "INTERNATIONAL", "COMPANY", "COMPANIES", "THE", "USA", "US", "NORTH", "AMERICA", "AMERICAN", "HOLDINGS", "GROUP", "ENTERPRISES", "INCORPORATED",
    "OF", "AND", "BROS", "BROTHERS", "BUILDING",
)
PROFESSIONAL_FORMS = ("PC", "PLLC", "PA", "LLP", "CPA", "CPAS")
PUBLIC_BODIES = (
    "CITY", "COUNTY", "TOWN", "TOWNSHIP", "VILLAGE", "STATE", "DISTRICT", "AUTHORITY", "SCHOOL", "SCHOOLS", "UNIVERSITY", "COLLEGE", "HOSPITAL",
    "MEDICAL", "CENTER", "CLINIC", "CHURCH", "DEPARTMENT", "COMMISSION",
)
REGISTRY_SUFFIXES = ("INC", "INCORPORATED", "LLC", "LLP", "LP", "LTD", "CO", "CORP", "CORPORATION", "COMPANY", "GROUP", "HOLDINGS", "THE", "USA", "US")
PARTY_FORMS = ("inc", "incorporated", "llc", "llp", "lp", "ltd", "limited", "corp", "corporation", "co", "company", "plc", "the")
#: Facility words, directions and numerals in site names.
DIRECTIONS = ("N", "S", "E", "W", "NW", "NE", "SW", "SE", "MAIN")
FACILITY_WORDS = ("FACILITY", "FACILITIES", "PLANT", "WAREHOUSE", "SITE", "LOCATION", "TERMINAL", "OFFICE", "OFFICES", "BRANCH", "HUB", "DC", "CAMPUS", "YARD", "DEPOT", "STORE")
NUMERALS = ("II", "III", "IV")
#: Clauses that join two names of one record, and joint ventures.
DBA = r"(?i)\s+(?:dba|d/b/a|doing business as)\s+"
JOINT_VENTURE = r"(?i)\b(?:J\s*V|JOINT\s+VENTURE)\b"


def _has(tokens: Column, token: Column) -> Column:
    return F.array_contains(tokens, token)


def _all_in(needles: Column, tokens: Column) -> Column:
    return F.forall(needles, lambda t: F.array_contains(tokens, t))


def raw_tokens(name: Column) -> Column:
    """Upper-case words without parentheses, legal forms kept; runs of single letters are one word (C.R. gives CR)."""
    text = F.regexp_replace(F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), r"\(.*?\)", " ")), "'", "")
    text = F.regexp_replace(F.trim(F.regexp_replace(text, "[^A-Z0-9]+", " ")), r"(?<=\b[A-Z]) (?=[A-Z]\b)", "")
    return F.filter(F.split(text, " "), lambda t: t != "")


def form_tokens(name: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    return F.filter(raw_tokens(name), lambda t: ~t.isin(*stop))


def distinctive(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*WEAK_WORDS))


def is_common_word(tokens: Column, words: tuple[str, ...] = COMMON_WORDS) -> Column:
    """A name of one distinctive word that the language uses anyway."""
    return (F.size(tokens) == 1) & F.lower(F.coalesce(F.get(tokens, F.lit(0)), F.lit(""))).isin(*words)


def recipient_match(company: Column, recipient: Column) -> Column:
    """Whether a recipient's name is the company, as a reason that starts with match: or says why not, in this order.

    A joint venture; a licensed practice; a company without distinctive words; a part of the name (around dba) with all distinctive
    words and nothing but generic ones besides, where a one-word name is backed by its line of business and a common word needs the exact name;
    a near miss (all distinctive words, but others too); a partial overlap; nothing in common.
    """
    own, core = form_tokens(company), distinctive(form_tokens(company))
    common = is_common_word(core, COMMON_WORDS + MORE_COMMON_WORDS)
    business = F.filter(own, lambda t: t.isin(*WEAK_WORDS))
    parts = F.filter(F.transform(F.split(recipient, DBA), lambda x: form_tokens(x)), lambda c: F.size(c) > 0)

    def accepted(c):
        extras = F.filter(c, lambda t: ~_has(core, t) & ~t.isin(*WEAK_WORDS, *GENERIC_WORDS))
        backed = (F.size(core) != 1) | (F.size(business) == 0) | F.arrays_overlap(business, c)
        return ~common & _all_in(core, c) & backed & (F.size(extras) == 0)

    def near(c):
        lead = F.coalesce(F.get(F.filter(c, lambda t: F.length(t) > 2), F.lit(0)), F.get(c, F.lit(0)))
        return ~common & ~F.exists(c, lambda t: t.isin(*PUBLIC_BODIES)) & _all_in(core, c) & ((F.size(core) >= 2) | (lead == F.get(core, F.lit(0))))

    return (
        F.when(recipient.rlike(JOINT_VENTURE), "joint_venture")
        .when(F.exists(raw_tokens(recipient), lambda t: t.isin(*PROFESSIONAL_FORMS)), "professional_practice")
        .when(F.size(core) == 0, "no_distinctive_token")
        .when(common & F.exists(parts, lambda c: c == own), "match: exact common-word name")
        .when(F.exists(parts, accepted), "match: all distinctive tokens")
        .when(F.exists(parts, near), "near_miss")
        .when(F.exists(parts, lambda c: F.arrays_overlap(core, c)), "partial_overlap")
        .otherwise("nothing_in_common")
    )


def party_tokens(name: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " ")), " ")
    return F.filter(words, lambda t: (t != "") & ~t.isin(*PARTY_FORMS))


def starts_with_name(party: Column, names: Column) -> Column:
    """One of the names, without legal forms, is how the party's name begins: what merely holds it is another company."""
    p = party_tokens(party)
    return F.exists(names, lambda n: (F.size(party_tokens(n)) > 0) & (F.slice(p, 1, F.greatest(F.size(party_tokens(n)), F.lit(1))) == party_tokens(n)))


def _phrase(name: Column) -> Column:
    """A pattern for the words of a name with separators between them."""
    return F.concat(F.lit(r"\b"), F.regexp_replace(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), " ", r"[\\s,.\\-]*"), F.lit(r"\b"))


def about_company(text: Column, name: Column, title: Column | None = None, head: int = 2500) -> Column:
    """Whether the top of a text is about a company: all distinctive words; of a coined one-word name the word; else the whole phrase."""
    top = F.lower(F.concat(F.coalesce(title, F.lit("")) if title is not None else F.lit(""), F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, head)))
    core = distinctive(name_tokens(name))
    first = F.lower(F.get(core, F.lit(0)))
    return (
        F.when(F.size(core) >= 2, F.forall(core, lambda t: F.contains(top, F.lower(t))))
        .when((F.size(core) == 1) & ~first.isin(*COMMON_WORDS), F.regexp_like(top, F.concat(F.lit(r"\b"), first, F.lit(r"\b"))))
        .otherwise((F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")) != "") & F.regexp_like(top, _phrase(name)))
    )


def listed_as(name: Column, listing: Column) -> Column:
    """All distinctive words of a name stand in one part of a listing, either being the start of the other, and what is added is generic or short."""
    core = distinctive(name_tokens(name))
    fits = lambda a, b: F.startswith(a, b) | F.startswith(b, a)
    parts = F.filter(F.transform(F.split(listing, r"(?i)\s+(?:dba|d/b/a|doing business as)\s+|\(|\)|\s+aka\s+"), lambda x: name_tokens(x)), lambda c: F.size(c) > 0)
    generic = [w for w in GENERIC_WORDS if w not in ("OF", "AND", "BROS", "BROTHERS", "BUILDING")]
    good = lambda c: F.forall(core, lambda k: F.exists(c, lambda t: fits(t, k))) & F.forall(c, lambda t: F.exists(core, lambda k: fits(t, k)) | t.isin(*WEAK_WORDS, *generic) | (F.length(t) <= 2))
    return (F.size(core) > 0) & F.exists(parts, good)


def registry_score(company: Column, legal_name: Column, dba_names: Column, active: Column, units: Column, months: Column) -> Column:
    """Points of a registry row: exact 100, prefix 80, truncated 70, subset 55 over its legal and dba names, then activity, fleet and filing age; 0 without a match."""
    tokens = lambda c: F.filter(F.split(F.trim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", " ")), " "), lambda t: (t != "") & ~t.isin(*REGISTRY_SUFFIXES))
    own = tokens(company)
    names = F.concat(F.array(legal_name), F.filter(F.split(F.coalesce(dba_names, F.lit("")), ","), lambda x: F.trim(x) != ""))

    def base(c):
        return (
            F.when((F.size(c) == 0) | (F.size(own) == 0), 0)
            .when(c == own, 100)
            .when(F.slice(c, 1, F.greatest(F.size(own), F.lit(1))) == own, 80)
            .when(F.slice(own, 1, F.greatest(F.size(c), F.lit(1))) == c, 70)
            .when(_all_in(own, c), 55)
            .otherwise(0)
        )

    best = F.array_max(F.transform(names, lambda n: base(tokens(n))))
    filing = F.when(months.isNull(), -5).when(months <= 36, 5).when(months > 96, -5).otherwise(0)
    return F.when(best == 0, 0).otherwise(best + F.when(active, 8).otherwise(-15) + F.when(units > 0, 5).otherwise(0) + filing)


def registry_confidence(score: Column) -> Column:
    return F.when(score >= 95, 0.9).when(score >= 80, 0.8).otherwise(0.65)


def clean_site(name: Column, states: tuple[str, ...], facility: bool = False) -> Column:
    """A name without what a record adds to it: MAIN marks, directions, state codes and numerals (not first), facility words on demand."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\*+\s*MAIN\s*\*+|\(\s*MAIN\s*\)", " "), r"\(.*?\)", " ")
    words = F.filter(F.split(text, r"[^A-Za-z0-9&'+.\-]+"), lambda w: F.regexp_replace(F.upper(w), "[^A-Z0-9]", "") != "")
    plain = lambda w: F.regexp_replace(F.upper(w), "[^A-Z0-9]", "")
    words = F.filter(words, lambda w: ~plain(w).isin(*DIRECTIONS))
    if facility:
        words = F.filter(words, lambda w: ~plain(w).isin(*FACILITY_WORDS))
    return F.array_join(F.filter(words, lambda w, i: (i == 0) | ~plain(w).isin(*states, *NUMERALS)), " ")


def search_word(name: Column) -> Column:
    """What to search by: the longest distinctive word of five letters or more that isn't common, else the name without its legal suffix."""
    bare = F.trim(F.regexp_replace(name, r"\(.*?\)", ""))
    core = distinctive(form_tokens(bare))
    good = F.filter(core, lambda t: t.rlike("^[A-Z]{5,}$") & ~F.lower(t).isin(*COMMON_WORDS, *MORE_COMMON_WORDS))
    longest = F.get(F.filter(good, lambda t: F.length(t) == F.array_max(F.transform(good, lambda x: F.length(x)))), F.lit(0))
    return F.when((F.size(good) > 0) & ~is_common_word(core, COMMON_WORDS + MORE_COMMON_WORDS), longest).otherwise(F.upper(strip_legal_suffix(bare)))


def slugs(name: Column) -> Column:
    """Slugs of a name and of the name without legal suffix, distinct, in this order."""
    one = lambda c: F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]+", " ")), r"\s+", "-"))
    return F.filter(F.array_distinct(F.array(one(name), one(strip_legal_suffix(name)))), lambda x: x != "")


def publisher_verdict(company: Column, site_host: Column, developer: Column, developer_host: Column, title: Column, floor: float = 0.55, title_floor: float = 0.75) -> Column:
    """Who publishes an app: the company by its own domain; a developer of the same name only; a third party; or nobody of that name."""
    own, dev = name_tokens(company), name_tokens(developer)
    core, dcore = F.array_distinct(distinctive(own)), F.array_distinct(distinctive(dev))
    same = (F.size(core) > 0) & (F.array_sort(core) == F.array_sort(dcore))
    site, other = registrable(site_host), registrable(developer_host)
    return (
        F.when((site != "") & (site == other), "company")
        .when(same | ((F.size(core) > 1) & (overlap_score(own, dev) >= floor)), "name_only")
        .when(overlap_score(own, name_tokens(title)) >= title_floor, "third_party")
        .otherwise("no")
    )
