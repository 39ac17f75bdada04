"""Passages over lines: rosters, interviews, bodies and whose page it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import passages as P
from ..functions import people as N
from ..functions.names import COMMON_WORDS, distinctive
from ..functions.text import host, name_tokens

#: Lines that end an article, and hosts of wires.
END_OF_ARTICLE = r"(?i)^(recommended reading|editor\W?s?\W{0,2}\s*picks|filed under\b.*|related (?:articles?|stories)|more from\b.*|topics covered|most popular|read next|trending now|keep up with the story.*)$"
SPEAKER = r"[A-Z][A-Z.'’\-]{1,20}(?:\s+[A-Z][A-Z.'’\-]{1,20}){0,3}:"
WIRES = ("prnewswire.com", "businesswire.com", "globenewswire.com")


#: Confidence by layout; how near a confirmed person a low-grade one must stand; how many of each a page gives.
CONFIDENCE = {"joined": 0.85, "name_then_title": 0.9, "title_then_name": 0.75, "low_grade_role": 0.3, "low_grade_untitled": 0.25}
NEIGHBOUR_LINES, MAX_PEOPLE, MAX_LOW_GRADE = 8, 40, 10


def roster(lines: DataFrame, page: str, no: str, line: str, company_words: Column, admit_untitled: bool = False) -> DataFrame:
    """(page, no, name, title, key, relevance, layout, confidence, refused) of the names that lines give: the people of a page, and who is refused and why (refused is blank for people).

    In this order a line gives: name and title joined; a name before a title; a name behind a title; in the low-grade tier a name beside a label that is shaped like a role but not on the list of titles,
    and on pages known as rosters a bare name. A person's first reading counts, whatever its tier. A low-grade reading stands only near a
    confirmed person, and is refused where the name is a menu's label. Lines of a page are numbered by `no` without gaps.
    """
    w = Window.partitionBy(page).orderBy(no)
    rows = lines.select(page, no, F.col(line).alias("line"), company_words.alias("own"))
    rows = rows.withColumns({"next": F.coalesce(F.lead("line").over(w), F.lit("")), "last": F.coalesce(F.lag("line").over(w), F.lit(""))})
    pair = F.split("line", N.JOINED, 2)
    rows = rows.withColumns({"left": F.trim(F.coalesce(F.get(pair, F.lit(0)), F.lit(""))), "right": F.trim(F.coalesce(F.get(pair, F.lit(1)), F.lit("")))})
    shaped = lambda c: (F.col(c) != "") & N.is_title_shaped(F.col(c)) & ~N.is_name(F.col(c), F.col("own"))
    label = F.when(shaped("next"), F.col("next")).when(shaped("last"), F.col("last")).otherwise(F.lit(""))
    entry = lambda name, title, layout, refused="": F.struct(N.bare_name(F.col(name)).alias("name"), F.trim(title).alias("title"), F.lit(layout).alias("layout"), F.lit(refused).alias("refused"))
    untitled = entry("line", F.lit(""), "low_grade_untitled") if admit_untitled else entry("line", F.lit(""), "", "name_without_adjacent_title")
    named = N.is_name(F.col("line"), F.col("own"))
    beside = F.when(label == "", untitled).when(label.rlike(N.ROLE_SHAPED), entry("line", label, "low_grade_role")).otherwise(entry("line", label, "", "adjacent_label_not_role_shaped"))
    found = (
        F.when((F.col("right") != "") & N.is_name(F.col("left"), F.col("own")) & N.is_title(F.col("right")), entry("left", F.col("right"), "joined"))
        .when(named & N.is_title(F.col("next")), entry("line", F.col("next"), "name_then_title"))
        .when(named & N.is_title(F.col("last")), entry("line", F.col("last"), "title_then_name"))
        .when(named, beside)
    )
    rows = rows.select(page, no, found.alias("p")).where("p IS NOT NULL").select(page, no, "p.*")
    low = F.startswith("layout", F.lit("low_grade"))
    rows = rows.withColumn("refused", F.when((F.col("refused") == "") & low & N.is_label(F.col("name")), "low_grade_name_is_label").otherwise(F.col("refused")))
    # The first reading of a person, confirmed or not.
    same = Window.partitionBy(page, "refused", N.person_key(F.col("name"))).orderBy(no)
    rows = rows.withColumn("refused", F.when((F.col("refused") == "") & (F.row_number().over(same) > 1), "duplicate_person").otherwise(F.col("refused")))
    confirmed = F.when((F.col("refused") == "") & ~low, F.col(no))
    before = F.max(confirmed).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    behind = F.min(confirmed).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    near = F.coalesce(F.col(no) - before <= NEIGHBOUR_LINES, F.lit(False)) | F.coalesce(behind - F.col(no) <= NEIGHBOUR_LINES, F.lit(False))
    rows = rows.withColumn("near", near)
    rows = rows.withColumn("refused", F.when((F.col("refused") == "") & low & ~F.col("near"), "low_grade_no_roster_neighbour").otherwise(F.col("refused")))
    turn = F.row_number().over(Window.partitionBy(page, low, "refused").orderBy(no))
    over = turn > F.when(low, MAX_LOW_GRADE).otherwise(MAX_PEOPLE)
    rows = rows.withColumn("refused", F.when((F.col("refused") == "") & over, F.when(low, "suppressed_by_low_grade_cap").otherwise("suppressed_by_cap")).otherwise(F.col("refused")))
    key = N.title_key(F.col("title"))
    out = rows.withColumns({"low": low, "key": key["key"], "relevance": key["relevance"], "confidence": F.coalesce(*[F.when(F.col("layout") == k, v) for k, v in CONFIDENCE.items()])})
    unsure = F.col("low") | (F.col("layout") == "")
    return out.select(
        page, no, "name", "title", F.when(F.col("title") == "", "unconfirmed").when(unsure, "other").otherwise(F.col("key")).alias("key"),
        F.when(unsure, "unconfirmed").otherwise(F.col("relevance")).alias("relevance"), "layout", "confidence", "refused",
    )


def answers(text: Column, person: Column, least: int = 90, most: int = 700) -> Column:
    """The passages behind a person's labels (full name or surname) in a text with two labels or more, in pieces of whole sentences of `least` to `most` characters."""
    labels = F.transform(F.regexp_extract_all(text, F.lit(rf"\b({SPEAKER})"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, ":$", "")))
    blocks = F.slice(F.split(text, rf"\b{SPEAKER}"), 2, 1_000_000)
    wanted = F.array(F.upper(person), F.upper(P.surname(person)))
    own = F.filter(F.transform(F.filter(F.arrays_zip(labels.alias("who"), blocks.alias("block")), lambda b: F.array_contains(wanted, b["who"])), lambda b: F.trim(F.regexp_replace(b["block"], r"\s+", " "))), lambda b: b != "")

    def pieces(block):
        # The state is (pieces done, the one that grows); a sentence that would make it too long begins the next.
        return F.aggregate(
            P.sentences(block),
            F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now")),
            lambda a, s: F.when(
                F.length(a["now"]) + F.length(s) + 1 > most,
                F.struct(F.when(F.length(a["now"]) >= least, F.array_append(a["done"], a["now"])).otherwise(a["done"]).alias("done"), s.alias("now")),
            ).otherwise(F.struct(a["done"].alias("done"), F.trim(F.concat_ws(" ", a["now"], s)).alias("now"))),
            lambda a: F.when(F.length(a["now"]) >= least, F.array_append(a["done"], a["now"])).otherwise(a["done"]),
        )

    return F.when(F.size(labels) >= 2, F.flatten(F.transform(own, pieces))).otherwise(F.array().cast("array<string>"))


def body_lines(lines: DataFrame, page: str, no: str, line: str) -> DataFrame:
    """The lines that are an article's: prose, and labels before prose, up to the first end marker behind prose."""
    w = Window.partitionBy(page).orderBy(no)
    prose = (F.length(line) >= 110) | ((F.length(line) >= 45) & F.col(line).rlike(r"[.!?][\"”’']?$"))
    rows = lines.withColumn("_prose", prose)
    label = F.col(line).rlike(f"^{SPEAKER}$") & F.coalesce(F.lead("_prose").over(w), F.lit(False))
    rows = rows.withColumn("_keep", F.col("_prose") | label)
    begun = F.max(F.col("_keep")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_end", F.coalesce(begun, F.lit(False)) & F.trim(line).rlike(END_OF_ARTICLE))
    rows = rows.withColumn("_over", F.max("_end").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.where("_keep AND NOT _over").drop("_prose", "_keep", "_end", "_over")


def page_owner(url: Column, own_host: Column) -> Column:
    """own_newsroom, standing_page, wire or third_party."""
    h = host(url)
    own = (h == own_host) | F.endswith(h, F.concat(F.lit("."), own_host))
    return F.when(own, F.when(url.rlike(P.ANNOUNCEMENT_URL), "own_newsroom").otherwise("standing_page")).when(h.isin(*WIRES), "wire").otherwise("third_party")


# Personal names and titles in prose, people who speak for others, how far around a person these and the company's name are looked for.
PERSON = r"[A-Z][a-z]+(?:\s+[A-Z]\.?)?(?:\s+[A-Z][A-Za-z'’\-]+){1,2}"
PROSE_TITLE = (
    r"(?:chief\s+(?:[a-z]{2,20}\s+){1,4}officer|C[EIOFTM]O|president|(?:senior\s+|executive\s+)?vice\s+president|"
    r"(?:S|E)?VP(?:\s+of\s+[a-z]{3,20}(?:\s+[a-z]{3,20})?)?|(?:senior\s+|managing\s+|executive\s+)?director(?:\s+of\s+[a-z]{3,20}(?:\s+[a-z]{3,20})?)?|"
    r"head\s+of\s+[a-z]{3,20}(?:\s+[a-z]{3,20})?|general\s+manager|founder|co-founder|owner|principal)"
)
OUTSIDER = r"(?i)\b(analyst|research|consultan|advisory|partner at|professor|association|institute|council|attorney|counsel|economist)\b"
OUTSIDER_WINDOW, COMPANY_WINDOW, MAX_SPEAKERS = 130, 260, 6
#: Shapes in this order: who comes first in it, the name (1) or the title, and whether the company is named in the shape itself.
SHAPES = (
    ("name_thefirms_title", "({person}),\\s+(?:the\\s+)?(?:firm|company|contractor|carrier|builder)(?:'s|’s)\\s+({title})", True, False),
    ("name_title_at_co", "({person}),\\s+({title})\\s+(?:at|of|for|with)\\s+(?:[\\w,.\\- ]{{0,40}}\\s)?{company}", True, True),
    ("co_title_name", "{company}(?:'s|’s)\\s+({title}),?\\s+({person})", False, True),
    ("name_co_title", "({person}),\\s+{company}(?:'s|’s)\\s+({title})", True, True),
)


def company_pattern(name: Column) -> Column:
    """How prose writes a company: its first two distinctive words with little between them, or the first alone unless the language uses it anyway; null without one."""
    core = distinctive(name_tokens(name))
    phrase = F.array_join(F.slice(core, 1, 2), r"[\w&.,'’\-]*\s*")
    alone = F.when(F.lower(F.get(core, F.lit(0))).isin(*COMMON_WORDS), phrase).otherwise(F.concat(phrase, F.lit("|"), F.get(core, F.lit(0))))
    return F.when(F.size(core) > 0, F.concat(F.lit("(?i:"), alone, F.lit(")")))


def _once(value: Column, use) -> Column:
    """`use` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def speakers(text: Column, company: Column) -> Column:
    """Array of (name, title, shape, refused) of the people that a text asserts to be officers of the company; `refused` says why another is not, and is blank for them.

    Each shape is read through the text with its place: somebody quoted near the name for another body (an analyst, counsel, an institute) refuses it, and where the shape says only "the firm's",
    the company's own name must stand near. A person's first mention counts, shapes in their order; at most six are kept.
    """
    mark = lambda s: F.replace(F.replace(s, F.lit("\x01"), F.lit("")), F.lit("\x02"), F.lit(""))
    none = F.array().cast("array<struct<name:string,title:string,shape:string,refused:string>>")

    def of(known, shape, rx, name_first, inside):
        pattern = F.concat(*[F.lit(p) if p != "{company}" else known for p in _cut(rx.format(person=PERSON, title=PROSE_TITLE, company="{company}"))])

        def people(parts):
            places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: i < F.size(parts))

            def one(x):
                around = lambda n: F.concat(F.substring(x["before"], -n, n), x["whole"], F.substring(x["behind"], 1, n))
                first, second = (F.call_function("regexp_extract", x["whole"], F.concat(F.lit("^(?:"), pattern, F.lit(")$")), F.lit(g)) for g in (1, 2))
                name, title = (first, second) if name_first else (second, first)
                squeeze = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^[ ,]+|[ ,]+$", "")
                title = F.trim(F.regexp_replace(squeeze(title), r"(?i)\s+(and|or|of|the|for|at)$", ""))
                refused = F.when(around(OUTSIDER_WINDOW).rlike(OUTSIDER), "speaks for another")
                if not inside:
                    refused = refused.when(~F.regexp_like(around(COMPANY_WINDOW), known), "company not named near")
                return F.struct(squeeze(name).alias("name"), title.alias("title"), F.lit(shape).alias("shape"), refused.otherwise("").alias("refused"))

            def at(i):
                whole = F.substring_index(F.get(parts, i), "\x02", 1)
                behind = mark(F.concat(F.substring(F.get(parts, i), F.length(whole) + 1, 10_000_000), F.array_join(F.slice(parts, i + 2, F.size(parts)), "")))
                return F.struct(whole.alias("whole"), mark(F.array_join(F.slice(parts, 1, i), "")).alias("before"), behind.alias("behind"))

            return F.filter(F.transform(places, lambda i: _once(at(i), one)), lambda p: (F.size(F.split(p["name"], " ")) >= 2) & (F.length(p["name"]) <= 60))

        found = _once(F.split(F.regexp_replace(text, F.concat(F.lit("("), pattern, F.lit(")")), F.lit("\x01$1\x02")), "\x01"), people)
        # Where a shape has a genitive in it, texts without one are not read through.
        return F.when(F.contains(text, F.lit("'s")) | F.contains(text, F.lit("’s")), found).otherwise(none) if "(?:'s|’s)" in rx else found

    def told(every):
        # A refused mention doesn't stand in the way of a later one.
        first = F.filter(every, lambda p, i: (p["refused"] != "") | ~F.exists(F.slice(every, 1, i), lambda q: (q["refused"] == "") & (F.lower(q["name"]) == F.lower(p["name"]))))
        return F.concat(F.slice(F.filter(first, lambda p: p["refused"] == ""), 1, MAX_SPEAKERS), F.filter(first, lambda p: p["refused"] != ""))

    every = _once(company_pattern(company), lambda known: F.when(known.isNotNull(), F.concat(*[of(known, *s) for s in SHAPES])).otherwise(none))
    return F.when(text.isNotNull(), _once(every, told)).otherwise(none)


def _cut(pattern: str) -> list[str]:
    parts = []
    for k, p in enumerate(pattern.split("{company}")):
        parts += ["{company}"] * (k > 0) + [p] * (p != "")
    return parts
