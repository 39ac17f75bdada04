"""Tables, archives and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, folder: str, name: str, schema: StructType | None = None) -> DataFrame:
    """A Parquet table. With a schema, columns that are missing or of another type are an error."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if schema is not None:
        have = {f.name: f.dataType for f in df.schema}
        drift = [f.name for f in schema if have.get(f.name) != f.dataType]
        if drift:
            raise ValueError(f"{name} doesn't have its declared columns: {', '.join(drift)}")
        df = df.select(*schema.fieldNames())
    return df


def dealt(df: DataFrame, *key: str, rows: int = 250_000) -> DataFrame:
    """Rows dealt by key over a task a core, or one for each `rows` rows (counted) where these are more, so that what a task sorts or hashes by the key doesn't grow with the table. What is grouped or joined by the key later stays where it is."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 1 + df.count() // rows), *key)


def known_rows(df: DataFrame, key: str, status: str | None = None, statuses: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a key, and of the given statuses where any are given."""
    df = df.where(F.col(key).isNotNull())
    return df.where(F.col(status).isin(*statuses)) if status and statuses else df


def vocabulary(lookups: DataFrame) -> DataFrame:
    """(field, values): the sets of allowed values; blanks are left out."""
    return lookups.where("trim(value) != ''").groupBy("field").agg(F.array_sort(F.collect_set(F.trim("value"))).alias("values"))


def archived(pages: DataFrame, key: str, day: str, today) -> DataFrame:
    """Per key the copy of `today`, or else of the newest day before it: what an offline replay reads."""
    seen = pages.where(F.col(day) <= F.lit(today))
    latest = seen.groupBy(key).agg(F.max(day).alias(day))
    return seen.join(latest, [key, day], "left_semi")


def write_export(df: DataFrame, path: str) -> None:
    """CSV files with a header, quoted where needed, that begin with the mark by which spreadsheets know UTF-8. Parts of it can be put together in any order of files."""
    first, *rest = df.columns
    df.select(F.col(first).alias(f"\ufeff{first}"), *rest).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An export as it was written, with the given types."""
    return spark.read.option("header", True).option("escape", '"').option("enforceSchema", True).option("multiLine", True).schema(schema).csv(path)


def read_feed(spark: SparkSession, rows: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON records of a column as columns; records that don't parse are kept with nulls and flagged."""
    parsed = rows.withColumn("_j", F.from_json(column, schema))
    return parsed.select(*rows.columns, "_j.*", F.col("_j").isNull().alias("unreadable"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of each table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
