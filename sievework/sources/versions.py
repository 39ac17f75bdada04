"""Versioned tables: a version is committed whole or not at all, is never rewritten, and is read back by its name.

A version's rows are Parquet under a folder of their own. Nothing refers to it until a manifest of the version's name is created, which fails where
one exists. That file is the commit: of two writers of one version one wins, and what a failed or losing
writer left behind is never read. Manifests carry the number of rows and a fingerprint of them, independent of their order.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder where driver and executors see the same files: under the checkpoint folder that the cluster names, which only a local session may lack."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{named or '/tmp/checkpoints'}/{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> tuple[int, str]:
    """(rows, a sum over the rows' hashes): the same however rows are ordered or dealt out."""
    row = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns or df.columns)]), {"ignoreNullFields": "false"})
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(row).cast("decimal(38,0)"))).first()
    return n, str(total or 0)


def versions(spark: SparkSession, path: str) -> DataFrame:
    """(version, rows, fingerprint, folder, note) of the versions that are committed; none for a new path."""
    schema = "version string, rows long, fingerprint string, folder string, note string"
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{path}/manifest")


def write_version(df: DataFrame, path: str, version: str, *, stamps: tuple[str, ...] = (), identity: list[str] | None = None, note: str = "", force: bool = True) -> bool:
    """Commit the rows as a version; False if `force` is off and the newest version has the same rows.

    An existing version is an error and stays as it is. Each row must have its `stamps`: a null or blank one is an error, and nothing is committed.
    `identity` are the columns that the fingerprint covers (all).
    """
    spark = df.sparkSession
    if _exists(spark, f"{path}/manifest/{version}.json"):
        raise ValueError(f"version {version} exists and is append-only")
    folder = f"{path}/data/{version}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    written = spark.read.parquet(folder)
    blank = [c for c in stamps if not written.where(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).isEmpty()]
    if blank:
        raise ValueError(f"rows without their stamps: {', '.join(blank)}")
    rows, own = fingerprint(written, identity)
    if not force:
        last = versions(spark, path).orderBy(F.desc("version")).first()
        if last is not None and (last.rows, last.fingerprint) == (rows, own):
            return False
    p, fs = _path(spark, f"{path}/manifest/{version}.json")
    try:
        out = fs.create(p, False)
    except Exception as e:
        raise ValueError(f"version {version} was committed by another writer") from e
    out.write(bytearray(json.dumps({"version": version, "rows": rows, "fingerprint": own, "folder": folder, "note": note}).encode()))
    out.close()
    return True


def read_version(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The rows of a committed version."""
    found = versions(spark, path).where(F.col("version") == version).first()
    if found is None:
        raise ValueError(f"no version {version} under {path}")
    return spark.read.parquet(found.folder)


def compare_versions(old: DataFrame, new: DataFrame, key: list[str], compared: list[str], evidence: list[str]) -> DataFrame:
    """(key, change): each key of the newer rows that is new, changed (any compared column), or differs in its evidence only; nulls equal each other."""
    differs = lambda columns: F.lit(False) if not columns else F.array_contains(F.array(*[~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns]), True)
    both = new.alias("n").join(old.withColumn("_there", F.lit(True)).alias("o"), [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key], "left")
    change = F.when(F.col("o._there").isNull(), "new").when(differs(compared), "changed").when(differs(evidence), "evidence_only")
    return both.select(*[F.col(f"n.{k}").alias(k) for k in key], change.alias("change")).where("change IS NOT NULL")
