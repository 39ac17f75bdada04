"""Entity resolution by weighted token overlap, with refusal instead of guessing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import WEAK_WEIGHT, overlap_score
from ..functions.text import WEAK_WORDS, name_tokens

#: The score a match needs, and how near a runner-up makes it ambiguous.
FLOOR, MARGIN = 0.55, 0.12


def scored_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, candidate_id, score) of all pairs that share a token, however low they score. Inputs have (id, name).

    Pairs meet on tokens, never all with all: without a shared token the score is 0 anyway. A token that most names have meets most with most, so this is for
    few queries; `resolve` doesn't need it.
    """
    q = queries.select(F.col("id").alias("query_id"), name_tokens(F.col("name")).alias("q"))
    c = candidates.select(F.col("id").alias("candidate_id"), name_tokens(F.col("name")).alias("c"))
    met = q.withColumn("t", F.explode(F.array_distinct("q"))).join(c.withColumn("t", F.explode(F.array_distinct("c"))), "t")
    return met.drop("t").dropDuplicates(["query_id", "candidate_id"]).select("query_id", "candidate_id", overlap_score(F.col("q"), F.col("c")).alias("score"))


def token_sets(names: DataFrame) -> DataFrame:
    """(tokens, n, least): the different sets of tokens of (id, name), each with its number of names and the smallest id. Names without tokens are left out."""
    tokens = F.array_sort(F.array_distinct(name_tokens(F.col("name"))))
    return names.select("id", tokens.alias("tokens")).where("size(tokens) > 0").groupBy("tokens").agg(F.count("*").alias("n"), F.min("id").alias("least"))


def query_prefixes(queries: DataFrame, frequencies: DataFrame, floor: float) -> DataFrame:
    """(tokens, t): of each set of tokens the rarest ones, as many as leave less than `floor` of its weight.

    Frequencies are (t, df). A candidate that scores `floor` shares at least that part of the query's weight, so it shares a token of the prefix.
    Tokens that no candidate has are never met: they weigh, but don't take part.
    """
    each = queries.select("tokens", F.explode("tokens").alias("t")).join(frequencies, "t", "left")
    weight = F.when(F.col("t").isin(*WEAK_WORDS), WEAK_WEIGHT).otherwise(1.0)
    ranked = each.withColumn("weight", weight)
    order = Window.partitionBy("tokens").orderBy("df", "t")
    ranked = ranked.withColumns({"before": F.sum("weight").over(order) - F.col("weight"), "all": F.sum("weight").over(Window.partitionBy("tokens"))})
    # A token is needed while what stands from it on could still be enough; scores are rounded to four places.
    return ranked.where((F.col("all") - F.col("before") >= (floor - 0.0001) * F.col("all")) & F.col("df").isNotNull()).select("tokens", "t")


def matches(queries: DataFrame, candidates: DataFrame, floor: float = FLOOR) -> DataFrame:
    """(q, c, n, least, score): the pairs of different token sets that score `floor` or more. Inputs are token_sets.

    Only the rarest tokens of a query are joined, so a token that most names have is joined for those queries alone of which it is most of the weight, and for these every
    candidate that has it is a match. Names with the same tokens are one row on either side.
    """
    index = candidates.select(F.col("tokens").alias("c"), "n", "least", F.explode("tokens").alias("t"))
    frequencies = index.groupBy("t").agg(F.count("*").alias("df"))
    wanted = query_prefixes(queries, frequencies, floor)
    met = wanted.withColumnRenamed("tokens", "q").join(index, "t")
    scored = met.withColumn("score", overlap_score(F.col("q"), F.col("c"))).where(F.col("score") >= floor)
    # A pair may share several tokens of the prefix.
    return scored.groupBy("q", "c").agg(F.min("n").alias("n"), F.min("least").alias("least"), F.min("score").alias("score"))


def resolve(queries: DataFrame, candidates: DataFrame, floor: float = FLOOR, margin: float = MARGIN, accept_multiple: bool = False) -> DataFrame:
    """One row per query: status, winner_id, score, ties. Inputs have (id, name).

    The score is the best one, and null where none reaches the floor (scored_pairs tells how near it came).
    """
    own = F.array_sort(F.array_distinct(name_tokens(F.col("name"))))
    pairs = matches(token_sets(queries).select("tokens"), token_sets(candidates), floor)
    top = pairs.withColumn("best", F.max("score").over(Window.partitionBy("q")))
    best = top.groupBy("q").agg(
        F.max("score").alias("score"),
        F.sum(F.when(F.col("score") >= F.col("best") - margin, F.col("n")).otherwise(0)).alias("ties"),
        F.min(F.when(F.col("score") == F.col("best"), F.col("least"))).alias("winner_id"),
    )
    some = candidates.limit(1).agg((F.count("*") > 0).alias("some"))
    best = queries.select(F.col("id").alias("query_id"), own.alias("q")).join(best, "q", "left").crossJoin(F.broadcast(some))
    status = F.when(~F.col("some"), "no_candidate").when(F.col("score").isNull(), "below_threshold").when((F.col("ties") > 1) & F.lit(not accept_multiple), "ambiguous").otherwise("resolved")
    out = best.withColumn("status", status)
    return out.select("query_id", "status", F.when(F.col("status") == "resolved", F.col("winner_id")).alias("winner_id"), "score", F.coalesce("ties", F.lit(0)).cast("long").alias("ties"))


def longest_prefix(rows: DataFrame, code: str, rules: list[tuple[str, str]]) -> DataFrame:
    """The value of the longest rule prefix that each code starts with; null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r[0]))
    value = F.coalesce(*[F.when(F.col(code).startswith(p), F.lit(v)) for p, v in ordered])
    return rows.withColumn("mapped", value)


def modal_value(rows: DataFrame, by: str, value: str, share: float = 0.6) -> DataFrame:
    """The value that at least `share` of a key's mapped rows have, or a refusal with its reason."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    total = counts.withColumn("all", F.sum("n").over(Window.partitionBy(by))).withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), value)))
    top = total.where("_r = 1").withColumn("share", F.round(F.col("n") / F.col("all"), 4))
    return top.select(by, F.when(F.col("share") >= share, F.col(value)).alias("decided"), "share", F.when(F.col("share") >= share, "decided").otherwise("no_majority").alias("reason"))
