"""What may be published: released rows, published runs, licensed absences, and the reports over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import version_order
from .coverage import COVERED
from .temporal import ABSENCE_CLASSES, REACH_RANK

#: Roles of the buyer side and of the seller side; the mark of the low-grade tier; rows up to which evidence is thin.
BUYER_ROLES = ("buyer_acts", "buyer_articulates")
SELLER_ROLE = "provider_market_responds"
LOW_GRADE_MARK = "[low-grade:"
THIN_MAX = 2


def buyers(companies: DataFrame) -> DataFrame:
    """Companies that are neither providers by status nor by the form of their id."""
    return companies.where("coalesce(status, '') != 'provider_benchmark' AND NOT startswith(company_id, 'P')")


def published_attempts(attempts: DataFrame, runs: DataFrame) -> DataFrame:
    """An attempt of a run that isn't published counts for nothing yet."""
    return attempts.join(runs.where("publication = 'published'").select("run_id").distinct(), "run_id", "left_semi")


def weakest_reach(sources: DataFrame) -> DataFrame:
    """Per harness the weakest reach among the primary sources of its latest version; unknown reach is weaker than any, the first source wins a tie."""
    order = version_order(F.col("version"))
    latest = sources.withColumn("_top", F.max(order).over(Window.partitionBy("harness_id"))).where(F.col("_top") == order)
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in REACH_RANK.items() for x in kv])[F.col("reach")], F.lit(-1))
    # Of equal versions that are written differently, the first in the table is the latest.
    first = latest.withColumn("_first", F.min_by("version", "turn").over(Window.partitionBy("harness_id"))).where("version = _first AND role = 'primary'")
    return first.groupBy("harness_id").agg(F.min_by(F.struct("version", "reach", "months"), F.struct(rank, "turn")).alias("r")).select("harness_id", "r.*")


def coverage_by_run(runs: DataFrame, attempts: DataFrame, signals: DataFrame, observations: DataFrame, invalid: DataFrame, audited: DataFrame, grandfathered: DataFrame) -> DataFrame:
    """Coverage of every run, recomputed, with the part that rests on invalid rows only, and whether it is the one to quote.

    To quote is the latest published version of a harness; of runs of one version the last. A stored rate that is off by more than 0.0001 diverges.
    """
    bad = invalid.select("observation_id", F.lit(True).alias("bad")).distinct()
    judged = observations.join(bad, "observation_id", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    only_invalid = judged.where("publication = 'released'").groupBy("harness_id", "company_id").agg(F.bool_and("bad").alias("all_bad"))
    per_version = judged.groupBy("harness_id", "version").agg(F.count("*").alias("n_obs"), F.count_if("bad").alias("n_obs_invalid"))
    live = attempts.where("scope = 'scoped'").join(F.broadcast(signals.select("signal", "signal_status")), "signal", "left").where("coalesce(signal_status, 'active') = 'active'")
    done = F.col("outcome").isin(*COVERED)
    live = live.join(F.broadcast(runs.select("run_id", "harness_id")), "run_id").join(only_invalid, ["harness_id", "company_id"], "left")
    counts = live.groupBy("run_id").agg(
        F.count("*").alias("scoped"),
        F.count_if(done).alias("covered"),
        F.count_if(done & (F.col("outcome") != "absent_confirmed") & F.coalesce("all_bad", F.lit(False))).alias("covered_invalid_only"),
    )
    out = runs.join(counts, "run_id", "left").join(per_version, ["harness_id", "version"], "left")
    out = out.na.fill(0, ["scoped", "covered", "covered_invalid_only", "n_obs", "n_obs_invalid"])
    for name, table in (("audited", audited), ("grandfathered", grandfathered)):
        out = out.join(F.broadcast(table.select("harness_id", "version", F.lit(True).alias(name)).distinct()), ["harness_id", "version"], "left").withColumn(name, F.coalesce(name, F.lit(False)))
    share = lambda n: F.when(F.col("scoped") > 0, F.round(n / F.col("scoped"), 6))
    quote = Window.partitionBy("harness_id", F.col("publication") == "published").orderBy(version_order(F.col("version")).desc(), F.desc("turn"))
    return out.select(
        "run_id", "harness_id", "version", "publication", "scoped", "covered", "covered_invalid_only", "n_obs", "n_obs_invalid", "audited", "grandfathered",
        share(F.col("covered")).alias("rate"), share(F.col("covered") - F.col("covered_invalid_only")).alias("valid_rate"),
        F.coalesce(F.abs(F.col("covered") / F.nullif("scoped", F.lit(0)) - F.col("stored_rate")) > 0.0001, F.lit(False)).alias("diverges"),
        ((F.col("publication") == "published") & (F.row_number().over(quote) == 1)).alias("quoted"),
    )


def absence_licence(themes: DataFrame, instruments: DataFrame, signals: DataFrame) -> DataFrame:
    """Per theme the number of instruments that see it, and those whose silence may be read as absence."""
    seen = instruments.join(signals, "signal", "left")
    licensing = F.col("instrument_class").isin(*ABSENCE_CLASSES) & ~F.coalesce("presence_only", F.lit(False))
    own = seen.groupBy("theme").agg(
        F.count("*").alias("n_instruments"),
        F.array_sort(F.collect_set(F.when(licensing, F.col("signal")))).alias("licensing"),
        F.array_sort(F.collect_set(F.when(F.col("presence_only"), F.col("signal")))).alias("presence_only"),
    )
    return themes.join(own, "theme", "left").withColumn("n_instruments", F.coalesce("n_instruments", F.lit(0)))


def licensed_companies(attempts: DataFrame, runs: DataFrame, instruments: DataFrame, signals: DataFrame) -> DataFrame:
    """(theme, company_id): companies that a licensing instrument has covered, with any outcome, in a published run."""
    live = published_attempts(attempts, runs).where("scope = 'scoped'").where(F.col("outcome").isin(*COVERED))
    licensing = signals.where(F.col("instrument_class").isin(*ABSENCE_CLASSES) & ~F.col("presence_only")).join(instruments, "signal")
    return live.join(F.broadcast(licensing.select("signal", "theme")), "signal").select("theme", "company_id").distinct()


def gap_report(themes: DataFrame, observations: DataFrame, invalid: DataFrame, licence: DataFrame, covered: DataFrame, universe: DataFrame) -> DataFrame:
    """Sellers and buyers per theme on valid rows, with those that only invalid or only low-grade rows carry, and what silence means.

    Distinct companies are counted once per (theme, side, company) row, so no set of companies is held.
    """
    side = F.when(F.col("role") == SELLER_ROLE, "seller").when(F.col("role").isin(*BUYER_ROLES), "buyer")
    rows = observations.where("publication = 'released'").join(invalid.select("observation_id", F.lit(True).alias("bad")).distinct(), "observation_id", "left")
    rows = rows.select("theme", "company_id", side.alias("side"), F.coalesce("bad", F.lit(False)).alias("bad"), F.startswith("excerpt", F.lit(LOW_GRADE_MARK)).alias("low"))
    own = rows.where("side IS NOT NULL").groupBy("theme", "side", "company_id").agg(
        F.count_if(~F.col("bad") & ~F.col("low")).alias("valid"), F.count_if(~F.col("low")).alias("any"), F.count_if(~F.col("bad") & F.col("low")).alias("low")
    )
    providers = own.where("side = 'seller' AND valid > 0").agg(F.count_distinct("company_id").alias("n_providers"))
    counts = own.groupBy("theme").agg(
        *[
            F.count_if((F.col("side") == s) & F.expr(rule)).alias(f"{s}s{name}")
            for s in ("seller", "buyer")
            for name, rule in (("", "valid > 0"), ("_total", "any > 0"), ("_invalid_only", "any > 0 AND valid = 0"), ("_low_grade_only", "low > 0 AND valid = 0"))
        ]
    )
    seen = covered.groupBy("theme").agg(F.count_distinct("company_id").alias("n_licensed"))
    out = themes.join(counts, "theme", "left").join(licence, "theme", "left").join(seen, "theme", "left").crossJoin(F.broadcast(providers)).crossJoin(F.broadcast(universe.agg(F.count("*").alias("n_universe"))))
    out = out.na.fill(0)
    under = F.format_string("%d of %d under a licensed instrument", "n_licensed", "n_universe")
    licensed = F.size("licensing") > 0
    status = (
        F.when(F.col("n_instruments") == 0, "NO INSTRUMENT")
        .when(F.col("buyers") > 0, F.when(licensed, F.concat(F.lit("covered ("), under, F.lit(")"))).otherwise("covered"))
        .when(~licensed, "no absence license")
        .when(F.col("n_licensed") > 0, F.concat(F.lit("buyer silent ("), under, F.lit(")")))
        .otherwise(F.format_string("licensed instrument unpublished (0 of %d)", "n_universe"))
    )
    numbers = [f"{s}s{n}" for s in ("seller", "buyer") for n in ("", "_total", "_invalid_only", "_low_grade_only")]
    return out.select("theme", *numbers, F.when(F.col("n_providers") > 0, F.round(F.col("sellers") / F.col("n_providers"), 4)).alias("provider_share"), status.alias("status"))


def evidence_matrix(themes: DataFrame, observations: DataFrame, invalid: DataFrame, tags: DataFrame, licence: DataFrame) -> DataFrame:
    """Released valid rows per theme by role and grade, what was left out and why, and the state of the evidence."""
    rows = observations.join(invalid.select("observation_id", F.lit(True).alias("bad")).distinct(), "observation_id", "left")
    rows = rows.join(tags.where("directionality = 'seller_side'").select("observation_id", F.lit(True).alias("seller_tag")).distinct(), "observation_id", "left")
    buyer, released = F.col("role").isin(*BUYER_ROLES), F.col("publication") == "released"
    kind = (
        F.when(F.coalesce("bad", F.lit(False)), F.when(released, "invalid"))
        .when(~released, "quarantined")
        .when(F.coalesce("seller_tag", F.lit(False)) & buyer, "seller_side")
        .otherwise("valid")
    )
    rows, valid = rows.withColumn("kind", kind), F.col("kind") == "valid"
    counts = rows.groupBy("theme").agg(
        F.count_if(valid).alias("n_valid"),
        *[F.count_if(valid & (F.col("role") == r)).alias(r) for r in (*BUYER_ROLES, SELLER_ROLE)],
        *[F.count_if(valid & (F.col("grade") == g)).alias(f"grade_{g.lower()}") for g in "ABC"],
        F.count_if(valid & buyer).alias("n_buyer"),
        F.count_distinct(F.when(valid & buyer, F.col("company_id"))).alias("n_buyer_companies"),
        F.count_if(valid & buyer & F.startswith("excerpt", F.lit(LOW_GRADE_MARK))).alias("n_buyer_low_grade"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}_excluded") for k in ("invalid", "quarantined", "seller_side")],
    )
    out = themes.join(counts, "theme", "left").na.fill(0).join(licence.select("theme", "licensing"), "theme", "left")
    state = (
        F.when(F.col("n_buyer") == 0, F.when(F.size(F.coalesce("licensing", F.array().cast("array<string>"))) > 0, "confirmed_absence").otherwise("zero_coverage"))
        .when(F.col("n_buyer") <= THIN_MAX, "thin_evidence")
        .otherwise("substantive_evidence")
    )
    return out.withColumn("state", state).drop("licensing")


def reprocessing_required(artifacts: DataFrame) -> DataFrame:
    """Per harness the earliest version whose audit found a wrong entity and that no passing audit of a later version supersedes.

    artifacts has harness_id, version, verdict, wrong_entity (control and strata together) and defect_introduced_in.
    """
    order = version_order(F.col("version"))
    passing = artifacts.where("verdict = 'pass'").groupBy("harness_id").agg(F.max(order).alias("_pass"), F.max_by("version", order).alias("superseded_by"))
    live = artifacts.where("wrong_entity > 0").join(passing, "harness_id", "left").where(F.col("_pass").isNull() | (order >= F.col("_pass")))
    worst = live.groupBy("harness_id").agg(F.min_by(F.struct("version", "wrong_entity", "defect_introduced_in", "superseded_by"), order).alias("w")).select("harness_id", "w.*")
    wide = F.concat("version", F.lit(" and all prior versions of "), "harness_id")
    narrow = F.concat("defect_introduced_in", F.lit(" and later versions up to "), "version", F.lit(" (narrowed by defect_introduced_in)"))
    return worst.select("harness_id", "version", "wrong_entity", F.when(F.col("defect_introduced_in").isNotNull(), narrow).otherwise(wide).alias("blast_radius"), "superseded_by")
