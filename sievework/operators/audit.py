"""The audit gate: samples, strata, rates, verdicts and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import rate

#: The seed of the random control, and exclusion thresholds.
SEED, CONTROL = 20260831, 30


def hash_sample(rows: DataFrame, id_col: str, size: int = CONTROL, seed: int = SEED) -> DataFrame:
    """`size` rows in the order of MD5(seed, id): without replacement, and the same whenever it is drawn."""
    return rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))).orderBy("_h", id_col).limit(size).drop("_h")


def strata_counts(rows: DataFrame, strata: dict[str, Column]) -> DataFrame:
    """Rows per stratum; an empty stratum stays with 0, and rows may lie in several."""
    counts = rows.agg(*[F.count_if(c).alias(k) for k, c in strata.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("stratum"), F.coalesce(F.col(k), F.lit(0)).alias("n")) for k in strata])).alias("s")).select("s.*")


def draw_strata(rows: DataFrame, id_col: str, strata: dict[str, tuple[Column, int]], drawn: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """(stratum, turn, and the row's columns): of each stratum the stated number of rows in the order of MD5(seed, id), without replacement.

    Strata may overlap: they draw in the order given, and a row that an earlier stratum has drawn, or that `drawn` (ids of earlier draws) has, is passed over.
    What is drawn depends on the ids alone, not on how rows are dealt out. Each stratum sends as many rows as all strata up to it draw together,
    found by ranks that are cut in each task first; only those are compared with each other.
    """
    fresh = rows if drawn is None else rows.join(drawn.select(F.col(drawn.columns[0]).alias(id_col)).distinct(), id_col, "left_anti")
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    member = F.array_compact(F.array(*[F.when(inside, F.struct(F.lit(k).alias("no"), F.lit(name).alias("stratum"))) for k, (name, (inside, _)) in enumerate(strata.items())]))
    offered = fresh.select("*", order.alias("_order"), F.explode(member).alias("_s")).select(*rows.columns, "_order", "_s.*")
    need = [sum(n for _, n in list(strata.values())[: k + 1]) for k in range(len(strata))]
    rank = F.row_number().over(Window.partitionBy("no").orderBy("_order", id_col))
    limit = F.element_at(F.array(*map(F.lit, need)), F.col("no") + 1)
    short = offered.withColumn("_rank", rank).where((F.col("_rank") <= max(need, default=0)) & (F.col("_rank") <= limit))
    # In turn: what the strata before have drawn goes, and the first rows of what is left are drawn. These are sum(need) rows at most.
    found, gone = None, None
    for k, (_, n) in enumerate(strata.values()):
        left = short.where(F.col("no") == k)
        left = left if gone is None else left.join(gone, id_col, "left_anti")
        own = left.withColumn("turn", F.row_number().over(Window.partitionBy("no").orderBy("_order", id_col))).where(F.col("turn") <= n)
        found = own if found is None else found.unionByName(own)
        gone = found.select(id_col).distinct()
    return found.select("stratum", "turn", *rows.columns)


def gate(verdicts: DataFrame, by: str, small: int = 20) -> DataFrame:
    """Precision, exclusion and the verdict per key: any wrong entity, or too much exclusion, fails."""
    g = verdicts.groupBy(by).agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "supported").alias("supported"), F.count_if(F.col("verdict") == "excluded").alias("excluded"), F.count_if(F.col("verdict") == "wrong_entity").alias("wrong_entity"))
    exclusion, threshold = rate(F.col("excluded"), F.col("n")), F.when(F.col("n") < small, F.lit(0.15)).otherwise(F.lit(0.10))
    failed = (F.col("wrong_entity") > 0) | (exclusion > threshold)
    return g.select(by, "n", rate(F.col("supported"), F.col("n")).alias("precision"), exclusion.alias("exclusion"), threshold.alias("threshold"), F.when(failed, "fail").otherwise("pass").alias("verdict"))


def allocate(groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Largest-remainder shares of `total`, ties by key, none above its group's size."""
    w = Window.partitionBy(F.lit(1))
    quota = F.col(size) * F.lit(total) / F.sum(size).over(w)
    rows = groups.withColumn("_q", quota).withColumn("_f", F.floor("_q")).withColumn("_left", F.lit(total) - F.sum("_f").over(w))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round(F.col("_q") - F.col("_f"), 9)), key))
    return rows.select(key, size, F.least(F.col(size), F.col("_f") + F.when(rank <= F.col("_left"), 1).otherwise(0)).cast("long").alias("allotted"))


def zero_found_bound(population: int, n: int, confidence: float = 0.95) -> int:
    """The most bad rows a population can hold if none of n drawn was bad, at this confidence; 0 for a census."""
    if n >= population:
        return 0
    bad, miss = 0, 1.0
    while bad < population - n:
        miss *= (population - n - bad) / (population - bad)
        if miss < 1 - confidence:
            break
        bad += 1
    return bad


#: The verdicts that an artifact counts.
VERDICTS = ("supported", "excluded", "wrong_entity", "unclear")


def artifact_json(rows: DataFrame) -> DataFrame:
    """(filename, body) of audit artifacts; every sixth one lacks its population, as older ones do."""
    counts = F.struct((F.col("sampled") - F.col("excluded")).alias("supported"), F.col("excluded").alias("excluded"), F.col("wrong_entity").alias("wrong_entity"), F.lit(0).alias("unclear"))
    population = F.when(F.col("id") % 6 != 0, F.lit(15))
    body = F.to_json(F.struct("harness_id", "version", F.lit(0.15).alias("threshold_applied"), F.struct(F.col("sampled").alias("sampled_n"), population.alias("population_n"), counts.alias("verdict_counts")).alias("random_control")))
    return rows.select(F.concat("harness_id", F.lit("_"), "version", F.lit(".json")).alias("filename"), body.alias("body"))


def artifact_rows(files: DataFrame, name: str, body: str) -> DataFrame:
    """Artifacts as rows with their derived rates, verdict and problems; a file whose name isn't that of its contents has that problem."""
    schema = f"harness_id string, version string, threshold_applied double, random_control struct<sampled_n:bigint,population_n:bigint,verdict_counts:struct<{','.join(f'{v}:bigint' for v in VERDICTS)}>>"
    a = files.withColumn("a", F.from_json(body, schema)).select(name, "a.*")
    control, counts = F.col("random_control"), F.col("random_control.verdict_counts")
    n = control["sampled_n"]
    exclusion = rate(counts["excluded"], n)
    gaps = [(control[f].isNull(), f"random_control is missing {f}") for f in ("sampled_n", "population_n")] + [(counts[v].isNull(), f"random_control.verdict_counts is missing {v}") for v in VERDICTS]
    gaps = [(F.col("harness_id").isNull(), "unreadable"), (F.col(name) != F.concat("harness_id", F.lit("_"), "version", F.lit(".json")), "misnamed"), *gaps]
    problems = F.array_compact(F.array(*[F.when(broken, F.lit(text)) for broken, text in gaps]))
    verdict = F.when((counts["wrong_entity"] > 0) | (counts["excluded"] / n > F.col("threshold_applied")), "fail").otherwise("pass")
    return a.select("harness_id", "version", name, rate(counts["supported"], n).alias("precision_rate"), exclusion.alias("exclusion_rate"), verdict.alias("verdict"), F.array_join(problems, "; ").alias("problems"))


#: Verdicts of a person on a row, those that mean it should not be there, and the fields that a downgrade may change.
JUDGEMENTS = ("supported", "overgraded", "unsupported", "wrong_entity")
EXCLUDED = ("unsupported", "wrong_entity")
DOWNGRADES = ("signal_strength", "organizational_state", "source_grade", "confidence_0_1")


def judge_rows(rows: DataFrame, verdicts: DataFrame, key: str, today: str) -> DataFrame:
    """The rows with a person's verdicts applied, and `refused`: why a verdict was not (blank else). A verdict on a key that no row has gives a row of nulls that says so.

    verdicts has key, verdict, auditor, notes and the DOWNGRADES, null where nothing changes; one verdict a row. `supported` changes nothing but the record of the review; `overgraded` must lower
    something; a row that should not exist is not parked here at a lower grade, but recorded invalid elsewhere. What a person has judged is accepted, released,
    and theirs from then on; the stamp joins earlier notes.
    """
    v = verdicts.select(F.col(key).alias("_key"), "verdict", "auditor", "notes", *[F.col(c).alias(f"_{c}") for c in DOWNGRADES])
    lowered = F.expr(" OR ".join(f"_{c} IS NOT NULL" for c in DOWNGRADES))
    both = rows.join(v, F.col(key) == F.col("_key"), "full")
    refused = (
        F.when(F.col("verdict").isNull() & F.col("_key").isNotNull() | (F.col("verdict").isNotNull() & ~F.col("verdict").isin(*JUDGEMENTS)), "no such verdict")
        .when(F.col(key).isNull() & F.col("_key").isNotNull(), "no such row")
        .when(F.col("verdict").isin(*EXCLUDED), "record it invalid instead")
        .when((F.col("verdict") == "overgraded") & ~lowered, "overgraded must lower something")
        .otherwise("")
    )
    done = both.withColumn("refused", refused).withColumn("_done", F.col("verdict").isNotNull() & (F.col("refused") == ""))
    stamp = F.concat(F.lit(f"[{today} audit by "), F.coalesce("auditor", F.lit("")), F.lit("; verdict "), F.col("verdict"), F.lit("] "), F.coalesce("notes", F.lit("")))
    new = {c: F.when(F.col("_done"), F.coalesce(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)) for c in DOWNGRADES if c in rows.columns}
    new |= {"audit_verdict": F.when(F.col("_done"), F.col("verdict")).otherwise(F.col("audit_verdict")), "review_source": F.when(F.col("_done"), "human").otherwise(F.col("review_source"))}
    new |= {"review_status": F.when(F.col("_done"), "accepted").otherwise(F.col("review_status")), "publication_state": F.when(F.col("_done"), "released").otherwise(F.col("publication_state"))}
    new |= {"reviewer_notes": F.when(F.col("_done"), F.trim(F.concat_ws(" ", F.nullif(F.trim("reviewer_notes"), F.lit("")), F.trim(stamp)))).otherwise(F.col("reviewer_notes"))}
    named = F.coalesce(F.col(key), F.col("_key")).alias(key)
    return done.select(named, *[new.get(c, F.col(c)).alias(c) for c in rows.columns if c != key], "refused")
