"""Roll-ups of evidence by company and signal: counts, ladders, picks, allocations and rules of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import rate
from ..functions.text import access_class, access_classes

#: A cluster of postings; months that are recent; kinds of inspections that somebody asked for.
CLUSTER, RECENT_MONTHS = 3, 36
ESCALATIONS = ("complaint", "referral", "accident", "fatality")
#: Primary and low-grade people a company is searched for; titles in order.
MOST_PRIMARY, MOST_LOW = 2, 4
TITLE_ORDER = ("ceo", "coo", "cio_cto", "vp_operations", "president")


def access_combinations(failures: DataFrame, detail: str, by: list[str]) -> DataFrame:
    """Rows per binding class, key and category, with the other classes that the same text shows."""
    classes = access_classes(F.col(detail))
    binding = F.coalesce(access_class(F.col(detail)), F.lit("unclassified"))
    return failures.groupBy(*by, binding.alias("access_class"), F.array_join(F.slice(classes, 2, 10), ",").alias("also")).agg(F.count("*").alias("n"))


def signal_claims(postings: DataFrame, by: list[str], shown: int = 4) -> DataFrame:
    """Per company and signal: count, leadership, strength, confidence and the first titles. postings has place, title, leadership and truncated.

    Only the first titles of each of 64 parts of a group are kept, then those of the group.
    """
    g = postings.groupBy(*by).agg(F.count("*").alias("n"), F.bool_or("leadership").alias("leadership"), F.bool_or("truncated").alias("truncated"))
    strength = F.when(F.col("leadership"), "committed_action").when(F.col("n") >= CLUSTER, "repeated_pattern").otherwise("weak_clue")
    base = F.when(F.col("n") == 1, 0.55).when(F.col("n") < CLUSTER, 0.7).otherwise(0.85)
    confidence = F.greatest(F.lit(0.3), F.least(F.lit(0.95), base + F.when(F.col("leadership"), 0.05).otherwise(0.0) - F.when(F.col("truncated"), 0.05).otherwise(0.0)))
    rows = postings.withColumn("_part", F.pmod(F.xxhash64("place"), F.lit(64)))
    for keys in ([*by, "_part"], by):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("place"))).where(F.col("_n") <= shown)
    titles = rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: x["title"]), "; ").alias("titles"))
    return g.join(titles, by).select(*by, "n", "leadership", strength.alias("strength"), F.round(confidence, 2).alias("confidence"), "titles")


def inspection_profile(inspections: DataFrame, by: str, months: Column) -> DataFrame:
    """Per company: inspections, recent ones, violations (unknown ones counted apart), escalated ones, age of the newest, and what that supports."""
    g = inspections.withColumn("_age", months).groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(F.col("_age") <= RECENT_MONTHS).alias("recent"), F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"),
        F.count_if(F.col("violations").isNull()).alias("unknown_violations"), F.count_if(F.lower("kind").isin(*ESCALATIONS)).alias("escalated"), F.min("_age").alias("newest_months"),
    )
    cited = F.col("violations") > 0
    return g.withColumns({
        "state": F.when(cited, "legacy_constraint").otherwise("unknown"), "strength": F.when(cited & (F.col("n") > 1), "repeated_pattern").otherwise("weak_clue"),
        "confidence": F.when(cited & (F.col("n") > 1), 0.7).when(cited, 0.55).otherwise(0.5),
    })


def facility_profile(facilities: DataFrame, by: str) -> DataFrame:
    """Per company: facilities, violating and significant ones, states, inspections and the ladder."""
    low = F.lower(F.coalesce("status", F.lit("")))
    violating = (low != "") & ~F.contains(low, F.lit("no violation")) & (low != "unknown")
    g = facilities.groupBy(by).agg(F.count("*").alias("n"), F.count_if(violating).alias("violating"), F.count_if(F.col("snc") == "Y").alias("significant"), F.count_distinct(F.nullif("state", F.lit(""))).alias("states"), F.sum("inspections").alias("inspections"))
    return g.withColumn("strength", F.when((F.col("significant") > 0) | (F.col("violating") > 1), "repeated_pattern").otherwise("weak_clue"))


def permit_roles(permits: DataFrame, names: list[str], types: list[str], accepted: DataFrame) -> DataFrame:
    """Permits a company has as contractor or else as owner, and the latest as contractor: many contacts of a permit unpivoted, contractor before owner.

    accepted has company_id and name: the names that have been found to be the company.
    """
    contacts = F.explode(F.array(*[F.struct(F.col(n).alias("name"), F.upper(F.coalesce(F.col(t), F.lit(""))).alias("type")) for n, t in zip(names, types, strict=True)]))
    rows = permits.select("permit", "day", contacts.alias("c")).select("permit", "day", "c.*").join(accepted, "name")
    role = F.max(F.when(F.contains("type", F.lit("CONTRACTOR")), 2).when(F.contains("type", F.lit("OWNER")), 1).otherwise(0))
    own = rows.groupBy("company_id", "permit", "day").agg(role.alias("role"))
    return own.groupBy("company_id").agg(F.count_if(F.col("role") == 2).alias("contractor_permits"), F.count_if(F.col("role") == 1).alias("owner_permits"), F.max(F.when(F.col("role") == 2, F.col("day"))).alias("latest"))


def people_to_search(people: DataFrame, by: str) -> DataFrame:
    """Active primary people first, by title and name, and low-grade ones apart, each up to its cap."""
    low = F.col("relevance") == "unconfirmed"
    order = F.coalesce(*[F.when(F.col("title") == t, k) for k, t in enumerate(TITLE_ORDER)], F.lit(99))
    live = people.where(F.col("relevance").isin("primary", "unconfirmed") & (F.coalesce("status", F.lit("active")) == "active")).withColumn("low_grade", low)
    ranked = live.withColumn("rank", F.row_number().over(Window.partitionBy(by, "low_grade").orderBy(order, "name")))
    return ranked.where(F.col("rank") <= F.when(F.col("low_grade"), MOST_LOW).otherwise(MOST_PRIMARY))


def leadership_links(links: DataFrame, page: str, most: int = 6) -> DataFrame:
    """(page, url, score, rank): own pages that may name leaders. The link's text and last segment score in full, other segments a third; careers and news never.

    links has page, host, url and text.
    """
    from ..functions.text import host

    url = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "/+$", ""), "^http://", "https://")
    own = links.where(host(F.col("url")) == F.col("host")).withColumn("url", url).where(~F.col("url").rlike(r"(?i)\.(pdf|jpe?g|png|gif|zip|mp4|docx?|xlsx?)$"))
    path = F.regexp_extract("url", r"^https?://[^/]+(/.*)?$", 1)
    leaf = F.regexp_extract("url", r"/([^/]*)$", 1)
    marks = ((10, r"(?i)leadership|executive|management[- ]team"), (6, r"(?i)\bteam\b|our[- ]people|who[- ]we[- ]are"), (3, r"(?i)about"))
    best = lambda c: F.coalesce(*[F.when(c.rlike(rx), s) for s, rx in marks], F.lit(0))
    near = best(F.concat_ws(" ", "text", leaf))
    score = F.when(near > 0, near).when(best(path) > 0, F.greatest(F.lit(1), F.floor(best(path) / 3))).otherwise(0)
    kept = own.where(~F.concat_ws(" ", "text", path).rlike(r"(?i)career|jobs") & ~path.rlike(r"(?i)/(news|press|blog)")).withColumn("score", score.cast("int")).where("score > 0")
    top = kept.groupBy(page, "url").agg(F.max("score").alias("score"))
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(page).orderBy(F.desc("score"), F.length("url"), "url"))).where(F.col("rank") <= most)


def disallowed(robots: Column, agents: tuple[str, ...]) -> Column:
    """The Disallow rules of a robots.txt for `*` and the given agents, over all groups that name one."""
    wanted = [a.lower() for a in (*agents, "*")]
    lines = F.filter(F.transform(F.split(robots, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("f"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    # The state: agents of the group, whether it has rules yet, rules taken.
    start = F.struct(F.array().cast("array<string>").alias("agents"), F.lit(False).alias("ruled"), F.array().cast("array<string>").alias("out"))

    def step(a, p):
        agent, rule = p["f"] == "user-agent", p["f"].isin("disallow", "allow", "crawl-delay")
        names = F.when(agent, F.when(a["ruled"], F.array(F.lower(p["v"]))).otherwise(F.array_append(a["agents"], F.lower(p["v"])))).otherwise(a["agents"])
        taken = (p["f"] == "disallow") & (p["v"] != "") & F.exists(a["agents"], lambda x: x.isin(*wanted))
        return F.struct(names.alias("agents"), F.when(agent, False).when(rule, True).otherwise(a["ruled"]).alias("ruled"), F.when(taken, F.array_append(a["out"], p["v"])).otherwise(a["out"]).alias("out"))

    return F.array_distinct(F.aggregate(pairs, start, step, lambda a: a["out"]))


def blocking_rule(rules: Column, path: Column) -> Column:
    """The longest rule that a path matches, `*` standing for anything and `$` for the end where no `*` stands; blank if none."""

    def pattern(rule):
        anchored = F.endswith(rule, F.lit("$"))
        body = F.when(anchored, F.regexp_replace(rule, r"\$$", "")).otherwise(rule)
        quoted = F.concat(F.lit(r"^\Q"), F.replace(body, F.lit("*"), F.lit(r"\E.*?\Q")), F.lit(r"\E"))
        return F.concat(quoted, F.when(anchored & ~F.contains(body, F.lit("*")), F.lit("$")).otherwise(F.lit("")))

    hits = F.filter(rules, lambda r: F.regexp_like(path, pattern(r)))
    longest = F.array_max(F.transform(hits, lambda r: F.length(r)))
    return F.coalesce(F.get(F.filter(hits, lambda r: F.length(r) == longest), F.lit(0)), F.lit(""))


def page_bucket(system: Column, inline: Column, chars: Column, framework: Column, apply_hosts: Column) -> Column:
    """Exactly one bucket of a careers page."""
    return (
        F.when(system.isNotNull(), F.concat(F.lit("ats:"), system))
        .when(inline >= 3, "inline_static_list")
        .when(chars < 2500, F.when(framework, "js_rendered_shell_framework").otherwise("js_rendered_shell"))
        .when(F.size(apply_hosts) > 0, "apply_link_offsite")
        .otherwise("static_page_no_list")
    )


def refusals(pages: DataFrame, evidentiary: tuple[str, ...]) -> DataFrame:
    """(reason, evidentiary, n, hosts): refused pages by the part of the reason before its colon."""
    from ..functions.text import host

    reason = F.trim(F.substring_index("rejected", ":", 1))
    rows = pages.where("coalesce(rejected, '') != ''").select(reason.alias("reason"), host(F.col("url")).alias("host"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts")).withColumn("evidentiary", F.col("reason").isin(*evidentiary))


def first_variant(results: DataFrame, by: str, order: str) -> DataFrame:
    """Per key the first variant that found anything; absence only if all of them came back empty, none of them failed. results has variant, hits and failed."""
    g = results.groupBy(by).agg(
        F.min(F.when(F.col("hits") > 0, F.struct(F.col(order), "variant", "hits"))).alias("won"), F.count("*").alias("tried"), F.bool_or("failed").alias("failed")
    )
    outcome = F.when(F.col("won").isNotNull(), "covered").when(F.col("failed"), "not_covered").otherwise("absent_confirmed")
    return g.select(by, F.col("won.variant").alias("variant"), F.col("won.hits").alias("hits"), "tried", outcome.alias("outcome"))


def allocate_with_floor(sizes: DataFrame, total: int, floor: int) -> DataFrame:
    """(key, n, allotted): proportional allotment by largest remainders, where no stratum gets less than the floor (or all it has). Sizes have (key, n).

    Strata that fall short are set to the floor and the rest is dealt anew, until none does: a fold over the strata in one row, as many rounds at most as there are strata. A stratum is
    one number, so this is no more than the strata themselves, whatever stands behind them. Ties of remainders go by key, and none gets more than it has.
    """
    give = f"least(x.n, CAST({floor} AS BIGINT))"
    open_, room = "filter(s, x -> x.fixed < 0)", f"(CAST({total} AS BIGINT) - aggregate(s, 0L, (a, x) -> a + greatest(x.fixed, 0L)))"
    whole = f"aggregate({open_}, 0L, (a, x) -> a + x.n)"
    # What is left after whole shares goes to the largest remainders: a stratum's turn is the number of those before it.
    share = "CASE WHEN r.room <= 0 OR r.whole = 0 THEN 0L ELSE least(x.n, x.n * r.room DIV r.whole) END"
    rest = "CASE WHEN r.whole = 0 THEN 0L ELSE x.n * greatest(r.room, 0L) % r.whole END"
    dealt = f"""transform(r.open, x -> named_struct('key', x.key, 'n', x.n, 'share', {share}, 'rest', {rest}))"""
    more = "greatest(least(r.room, r.whole), 0L) - aggregate(d, 0L, (a, y) -> a + y.share)"
    turn = "size(filter(d, z -> z.share < z.n AND (z.rest > y.rest OR z.rest = y.rest AND z.key < y.key)))"
    one = f"""transform(array(named_struct('open', {open_}, 'room', {room}, 'whole', {whole})), r -> transform(array({dealt}), d ->
        transform(d, y -> named_struct('key', y.key, 'n', y.n, 'own', y.share + IF(y.share < y.n AND {turn} < {more}, 1L, 0L))))[0])[0]"""
    short = f"map_from_entries(transform(filter({one}, y -> y.own < least(y.n, CAST({floor} AS BIGINT))), y -> struct(y.key, y.own)))"
    step = f"transform(array({short}), m -> transform(s, x -> named_struct('key', x.key, 'n', x.n, 'fixed', IF(x.fixed < 0 AND map_contains_key(m, x.key), {give}, x.fixed))))[0]"
    strata = sizes.agg(F.array_sort(F.collect_list(F.struct(F.col("key").cast("string").alias("key"), F.col("n").cast("long").alias("n"), F.lit(-1).cast("long").alias("fixed")))).alias("s"))
    settled = strata.withColumn("s", F.expr(f"aggregate(sequence(1, greatest(size(s), 1)), s, (s, i) -> {step})"))
    last = settled.select("s", F.expr(f"map_from_entries(transform({one}, y -> struct(y.key, y.own)))").alias("m"))
    return last.select(F.explode("s").alias("x"), "m").select("x.key", "x.n", F.expr("IF(x.fixed >= 0, x.fixed, element_at(m, x.key))").alias("allotted"))


def clean_text(c: Column) -> Column:
    """Control characters, which a cell may not hold, as question marks."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "?")


def relative_risk(part: Column, whole: Column, national: Column, least: int = 20) -> Column:
    """How far a rate is from the national one; nothing below `least` cases."""
    return F.when(whole >= least, F.round(rate(part, whole, 10) - national, 4))
