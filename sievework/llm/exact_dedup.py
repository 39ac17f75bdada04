"""Exact dedup as a tree merge of sorted digest runs, in DataFrame operations only.

Rows are dealt by their id into runs; a run is sorted by digest and holds each digest once, with its smallest
id and its row count. In binomial rounds every `fan` runs meet and merge in the order of digests, keeping
the smallest identifier of equal digests, until one run is left. (A run is a sorted sequence over all partitions,
split by the hash of the digest: no task holds a run.) The winners then
go back down the same tree. A text that fills a third of the table is met at most once by each run and round, and
its rows are spread over all runs when they look up the winner. Runs grow in number with the partitions of the session.

Digests are verified at every level, not trusted: entries merge only if SHA-256, a second 64-bit hash
and the length of the normalised text all agree. Texts themselves don't travel.

Cases: a null text counts as empty; ties are settled by the smallest id, and rows that
repeat that id all stay; a null id is larger than any other, and its row stays only if
no row of its group has an id; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialise

_KEY = ["text_sha256", "check", "size"]


def digest_columns(text, lower: bool = False):
    """SHA-256, second hash and length of the text with each whitespace run made one space."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, " ")
    return F.sha2(text, 256).alias("text_sha256"), F.xxhash64(text).alias("check"), F.length(text).alias("size")


def tree_merge(rows: DataFrame, key: list[str], id_col: str, *, runs: int | None = None, fan: int = 4) -> DataFrame:
    """Adds keep_id (the smallest id of the rows with equal `key`) and group_size; keys are not null."""
    if runs is None:
        runs, wanted = 64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        while runs < wanted:
            runs *= fan
    rows = rows.withColumn("run", F.pmod(F.xxhash64(id_col), F.lit(runs)))
    # A least struct is merged from sorted input: Spark sorts each run by digest and merges, level by level.
    entry = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id")))
    levels = [rows.groupBy("run", *key).agg(entry.alias("least"), F.count("*").alias("group_size"))]
    width = runs
    while width > 1:
        width = -(-width // fan)
        levels.append(levels[-1].groupBy((F.floor(F.col("run") / fan)).alias("run"), *key).agg(F.min("least").alias("least"), F.sum("group_size").alias("group_size")))
    winners = levels.pop().withColumn("keep_id", F.col("least.id")).drop("least")
    while levels:
        below = levels.pop().select("run", *key).withColumn("above", F.floor(F.col("run") / fan))
        winners = below.join(winners.withColumnRenamed("run", "above"), ["above", *key]).drop("above")
    return rows.join(winners, ["run", *key]).drop("run")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", runs: int | None = None, fan: int = 4) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), *digest_columns(F.col(text_col).cast("string"))))
    merged = tree_merge(rows, _KEY, "doc_id", runs=runs, fan=fan)
    return merged.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
