"""Sheets of different makers: each file has its own header somewhere in its first lines, and its own names for the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_date

#: The names under which lists of notices have each column, and the lines in which a header stands.
NOTICE_COLUMNS = {
    "name": ("JOB_SITE_NAME", "COMPANY"),
    "date": ("NOTICE_DATE", "NOTICE DATE"),
    "count": ("TOTAL_LAYOFF_NUMBER", "NO. OF EMPLOYEES"),
    "city": ("CITY_NAME", "ADDRESS"),
}
HEADER_LINES = 6


def cells(line: Column) -> Column:
    """The cells of a line: split at commas outside of quotes, quotes taken off, blanks trimmed."""
    parts = F.split(F.concat(line, F.lit(",")), r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    plain = lambda c: F.replace(F.regexp_replace(F.trim(c), r'^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda c: F.trim(plain(c)))


def read_sheets(spark: SparkSession, path: str, columns: dict[str, tuple[str, ...]] | None = None, *, key: str = "name", since: str | None = None, header_lines: int = HEADER_LINES) -> DataFrame:
    """(file, and each column, as text; date as a date) of all files under a path, one union however their headers differ.

    The header of a file is the first of its leading lines with a name of the `key` column; a file without one gives no rows. Of several names for a column
    the first that a header has is taken, and a column that it lacks is null. Rows without a key are left out, and rows without
    a date or before `since` where that is given. Lines are read where they lie: a file may be split, and only its header is sent to its other parts.
    """
    columns = NOTICE_COLUMNS if columns is None else columns
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    first = lines.where("block = 0").groupBy("path").agg(F.min("at").alias("top"))
    named = F.transform(cells(F.col("value")), lambda c: F.upper(F.trim(F.regexp_replace(c, r"\s+", " "))))
    leading = lines.where("block = 0").join(first, "path").where(F.col("at") - F.col("top") < header_lines)
    header = leading.withColumn("head", named).where(F.arrays_overlap("head", F.array(*[F.lit(n) for n in columns[key]])))
    header = header.groupBy("path").agg(F.min(F.struct("at", "head")).alias("h")).select("path", F.col("h.at").alias("head_at"), F.col("h.head").alias("head"))
    place = lambda names: F.coalesce(*[F.nullif(F.array_position("head", n), F.lit(0)) for n in names])
    header = header.select("path", "head_at", *[place(names).cast("int").alias(f"_{c}") for c, names in columns.items()])
    body = lines.join(header, "path").where((F.col("block") > 0) | (F.col("at") > F.col("head_at"))).withColumn("cells", cells(F.col("value")))
    value = lambda c: F.get("cells", F.col(f"_{c}") - 1)
    rows = body.select("file", *[(parse_date(value(c)) if c == "date" else F.nullif(value(c), F.lit(""))).alias(c) for c in columns]).where(F.col(key).isNotNull())
    return rows.where(F.col("date") >= since) if since else rows
