"""The queries that apply each operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as exact
from . import filter_audit as audits
from . import licenses
from . import ranked_search as ranked
from .common import table
from .decontamination import decontaminate
from .exact_dedup import exact_dedup
from .filter_audit import filter_audit
from .fixity import audit, damaged, records
from .language_id import identify_language
from .licenses import license_summary
from .line_dedup import line_dedup
from .mixing import mix_sources
from .near_dedup import near_dedup
from .ranked_search import ranked_search
from .secrets import secret_scan
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, with the items they contain."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), without_id=True)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule of all documents at the square-root weights of their sources."""
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica with known faults."""
    archive = records(table(spark, sf_dir, "pages"))
    return audit(archive, damaged(archive))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_summary(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ALL = (op1_substring_dedup, op2_line_dedup, op3_decontamination, op4_language_id, op5_exact_dedup, op6_suffix_array_dedup, op7_near_dedup, op8_mixing, op9_warc_fixity, op10_secret_scan, op11_ranked_search, op12_license_scan, op13_filter_audit)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {"op5_exact_dedup": exact.SQL, "op11_ranked_search": ranked.SQL, "op12_license_scan": licenses.SQL, "op13_filter_audit": audits.SQL}
