"""Rules for what may be written: reviews, determinations, relations, migrations and publication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import distinctive, form_tokens, recipient_match
from .integrity import orphans, problems

#: Reporting statuses and the form of a CIK; designs of a sample; roles and verdicts of a review.
SEC_STATUSES = ("active_reporter", "ceased_reporting", "never_registered", "entity_unresolved", "status_uncertain")
CIK = r"(?i)\bCIK\s*\d{1,10}\b"
DESIGNS, ROLES = ("census", "stratified"), ("buyer_acts", "buyer_articulates", "provider_market_responds")


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def sec_problems() -> Column:
    """What forbids a determination of reporting status: each status asks for its own evidence."""
    status, notes = _text("status"), _text("notes")
    return problems(
        (~status.isin(*SEC_STATUSES), "unknown status"),
        (~_text("as_of").rlike(r"^\d{4}-\d{2}-\d{2}$"), "as_of must be an ISO date"),
        (_text("reference") == "", "reference is required"),
        ((status == "entity_unresolved") & (notes == ""), "identity doubt needs notes"),
        ((status == "status_uncertain") & ~_text("reference").rlike(CIK), "status doubt needs the filer's CIK"),
        ((status == "status_uncertain") & (notes == ""), "status doubt needs notes"),
        ((status == "never_registered") & (notes == ""), "never registered needs notes"),
        (status.isin(*SEC_STATUSES) & (status != "never_registered") & (_text("filing") == ""), "filing type is required"),
    )


def review_problems() -> Column:
    """What forbids a row of a role review."""
    census = F.col("design") == "census"
    return problems(
        (~_text("role").isin(*ROLES), "unknown role"),
        (_text("verdict") == _text("role"), "the verdict repeats the role"),
        (_text("source") != "human", "a verdict is a person's"),
        (F.startswith(_text("run"), F.lit("HR-")), "a review is no harness run"),
        (~_text("design").isin(*DESIGNS), "unknown design"),
        (F.col("sample_n") > F.col("population_n"), "sample exceeds population"),
        (census & (F.col("sample_n") != F.col("population_n")), "census without all rows"),
        (~census & (F.col("sample_n") == F.col("population_n")), "all rows reviewed, yet no census"),
        ((_text("verdict") != "correct") & (_text("words") == ""), "the reviewer's words are missing"),
    )


def review_batches(rows: DataFrame) -> DataFrame:
    """(run, problem): a run has one design and size, as many rows as its sample, no row twice, and strata that add up to sample and population."""
    strata = rows.groupBy("run", "stratum").agg(F.count("*").alias("held"), F.min("stratum_n").alias("n"), F.max("stratum_n").alias("top"), F.min("stratum_population").alias("pop"), F.max("stratum_population").alias("pop_top"))
    torn = (F.col("n") != F.col("top")) | (F.col("pop") != F.col("pop_top"))
    per = strata.groupBy("run").agg(F.bool_or(torn).alias("torn"), F.bool_or(~torn & (F.col("held") != F.col("n"))).alias("short"), F.sum(F.when(~torn, F.col("n"))).alias("sampled"), F.sum(F.when(~torn, F.col("pop"))).alias("population"))
    runs = rows.groupBy("run").agg(F.count("*").alias("rows"), F.count_distinct("observation_id").alias("ids"), F.count_distinct("design").alias("designs"), F.count_distinct("sample_n").alias("sizes"), F.min("sample_n").alias("sample_n"), F.min("population_n").alias("population_n")).join(per, "run")
    found = problems(
        (F.col("designs") > 1, "design differs"), (F.col("sizes") > 1, "sample_n differs"), (F.col("ids") != F.col("rows"), "an observation twice"), (F.col("rows") != F.col("sample_n"), "rows are not sample_n"),
        (F.col("torn"), "a stratum states more than one size"), (F.col("short"), "a stratum holds another number of rows"),
        (~F.col("sampled").eqNullSafe(F.col("sample_n")), "strata don't add up to the sample"), (~F.col("population").eqNullSafe(F.col("population_n")), "strata don't add up to the population"),
    )
    return runs.select("run", F.explode(found).alias("problem"))


def broken_relations(relations: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(check, n, first): references without a parent, for relations (name, child, key, parent, parent key)."""
    rows = reduce(DataFrame.unionByName, [orphans(child, key, parent, parent_key, name) for name, child, key, parent, parent_key in relations])
    return rows.groupBy("check").agg(F.count("*").alias("n"), F.min("subject").alias("first"))


def migrate(rows: DataFrame, fills: dict[str, Column], renames: dict[str, dict[str, str]], human: str) -> DataFrame:
    """Columns that are missing are added, blanks filled (nothing else is), old keys renamed; a person's row with an old key stops the job."""
    for column, value in fills.items():
        have = F.nullif(_text(column), F.lit("")) if column in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn(column, F.coalesce(have, value))
    for column, names in renames.items():
        old = F.col(column).isin(*names)
        rows = rows.where(F.when(old & F.col(human), F.raise_error(F.concat(F.lit("a person's row has the old key "), column)).isNull()).otherwise(True))
        rows = rows.replace(names, subset=[column])
    return rows


def rebuild(base: DataFrame, base_rows: int, stale: DataFrame, stale_rows: int, key: str) -> DataFrame:
    """The base with the rows of an older snapshot that it lacks; both must have the stated number of rows, or nothing is built."""
    for name, table, n in (("base", base, base_rows), ("stale", stale, stale_rows)):
        if (have := table.count()) != n:
            raise ValueError(f"{name} has {have} rows, not {n}")
    return base.withColumn("origin", F.lit("base")).unionByName(stale.join(base.select(key), key, "left_anti").withColumn("origin", F.lit("stale")))


def publish(runs: DataFrame, observations: DataFrame, versions: DataFrame, audited: DataFrame) -> DataFrame:
    """(kind, id, publication) of both tables after versions are published; they flip together, and only with an audit artifact."""
    go = versions.select("harness_id", "version").join(audited.select("harness_id", "version").distinct(), ["harness_id", "version"], "left_semi").withColumn("_go", F.lit(True)).distinct()
    parts = []
    for kind, table, name, state in (("run", runs, "run_id", "published"), ("observation", observations, "observation_id", "released")):
        rows = table.join(F.broadcast(go), ["harness_id", "version"], "left")
        parts.append(rows.select(F.lit(kind).alias("kind"), F.col(name).alias("id"), F.when(F.col("_go"), state).otherwise(F.col("publication")).alias("publication")))
    return parts[0].unionByName(parts[1])


def identity_verdict(company: Column, candidate: Column, refused: Column, verified: Column) -> Column:
    """Whether a record's name is the company: names a person refused first, then verified forms, then the recipient rule, where a one-word name needs an exact form."""
    form = lambda c: F.array_join(form_tokens(c), " ")
    own = form(candidate)
    is_one = lambda names: F.exists(names, lambda n: (form(n) != "") & (form(n) == own))
    reason = recipient_match(company, candidate)
    matched = F.startswith(reason, F.lit("match"))
    return (
        F.when(is_one(refused), "refused: a person said so")
        .when(is_one(verified), "match: verified form")
        .when(~matched, reason)
        .when(F.size(distinctive(form_tokens(company))) >= 2, "match: several words")
        .when(own == form(company), "match: exact form")
        .otherwise("refused: unverified form of one word")
    )


def zero_found_bound(population: Column, drawn: Column, share: float = 0.05) -> Column:
    """The largest number of wrong rows in a population that drawing `drawn` rows and finding none still allows; 0 for a census.

    The chance to miss k wrong ones is the product of (population - k - i) / (population - i) over the draws.
    """
    chance = lambda k: F.aggregate(F.sequence(F.lit(0), drawn - 1), F.lit(1.0), lambda a, i: a * F.greatest(F.lit(0.0), (population - k - i) / (population - i)))
    fits = F.filter(F.sequence(F.lit(0), population), lambda k: chance(k) >= share)
    return F.when(drawn >= population, 0).otherwise(F.array_max(fits))
