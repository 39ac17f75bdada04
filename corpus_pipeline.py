"""A training corpus from raw documents: identify, dedup lines, dedup documents, decontaminate, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet in the shared folder and read again as the next stage's documents.

Cases, of all stages: an empty table passes through; repeated rows are treated alike; extra columns are carried, whatever
their names (the last stage replaces those named like the ones it adds). Null or empty texts are rejected by the first stage; each other
stage passes them on, as nothing in them repeats or is known. Rows with a null doc_id are never removed as copies; they are
removed if they hold a benchmark item, and mixed like any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import shared_folder
from sievework.llm.decontamination import decontaminate, key_of
from sievework.llm.language_id import with_language
from sievework.llm.line_dedup import line_dedup
from sievework.llm.mixing import mix_sources
from sievework.llm.near_dedup import near_dedup


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go."""
    return with_language(docs).where("NOT rejected").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that came before; documents of nothing but such lines go."""
    kept = line_dedup(docs).where("n_removed = 0 OR trim(text) != ''")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    gone = near_dedup(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    rows = docs.select(F.struct("*").alias("row"), key_of("doc_id", "text").alias("key"), "text")
    gone = decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key").select(F.col("doc_id").alias("key")).distinct()
    return rows.join(gone, "key", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture of sources."""
    return mix_sources(docs)


STAGES = [
    ("language_id", identify),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", remove_benchmark),
    ("mixing", mix),
]

#: The stages' models, classes and components are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
