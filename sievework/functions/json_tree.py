"""Nested JSON of unknown shape, walked level by level as variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _nested(kind):
    return F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))


def nodes(rows: DataFrame, id_col: str, body: str) -> DataFrame:
    """(id, path, node): the document of each row and all it holds, objects and arrays alike; the order of paths is that of a walk from the top.

    A level is one explode of the level above, over all rows at once; each is asked for one row before it is added, so there are as many as the deepest document has.
    Text inside strings is never read as a key. Members of an object come in the order of their keys, those of an array in their own. What does not parse has no nodes.
    """
    top = rows.select(F.col(id_col).alias("id"), F.array().cast("array<int>").alias("path"), F.try_parse_json(body).alias("node")).where("node IS NOT NULL")
    levels, spark = [top], rows.sparkSession
    while True:
        inner = levels[-1].where(_nested(F.schema_of_variant("node")))
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        below = inner.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()).toDF("pos", "key", "child"))
        levels.append(below.select("id", F.array_append("path", F.col("pos")).alias("path"), F.col("child").alias("node")))


def fields(tree: DataFrame, names: dict[str, str]) -> DataFrame:
    """(id, path, and a column for each name): the members of objects by their path in the object ($.x), as strings; nodes without any of them are left out."""
    found = tree.select("id", "path", *[F.try_variant_get("node", f"$.{path}", "string").alias(name) for name, path in names.items()])
    return found.where(" OR ".join(f"{n} IS NOT NULL" for n in names))
