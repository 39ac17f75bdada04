"""Ordered changes of a table's shape and contents, each made once: a ledger of versions says which."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions as V


@dataclass(frozen=True)
class Step:
    """A change. `rows` tells the number of rows it must leave from the number it found; `definition` is what its fingerprint is made of."""

    name: str
    change: Callable[[DataFrame], DataFrame]
    definition: str
    rows: Callable[[int], int] = lambda n: n

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(f"{self.name}\x1f{self.definition}".encode()).hexdigest()[:16]


def run_steps(spark: SparkSession, path: str, base: DataFrame, steps: list[Step]) -> DataFrame:
    """(seq, step, action, rows_before, rows_after): what this run did. The newest version under `path` holds the result.

    The table as it was found is version 000. A step that the ledger has is skipped; if it was recorded under another definition, or out of order, the run stops. A step that leaves
    another number of rows than it states stops the run before it is recorded, so the table stays as the step before left it.
    """
    recorded = {r.version: r for r in V.versions(spark, path).collect()}
    if "000_base" not in recorded:
        V.write_version(base, path, "000_base")
        recorded["000_base"] = V.versions(spark, path).where("version = '000_base'").first()
    last, out = "000_base", []
    for seq, step in enumerate(steps, 1):
        version = f"{seq:03d}_{step.name}"
        before = recorded[last].rows
        if version in recorded:
            if recorded[version].note != step.fingerprint:
                raise ValueError(f"{step.name} is recorded with another definition")
            out.append((seq, step.name, "skipped", before, recorded[version].rows))
        elif any(v > last for v in recorded):
            raise ValueError(f"{step.name} is not recorded, but a later step is")
        else:
            changed = step.change(V.read_version(spark, path, last)).persist()
            n, expected = changed.count(), step.rows(before)
            if n != expected:
                changed.unpersist()
                raise ValueError(f"{step.name} leaves {n} rows, not {expected}")
            V.write_version(changed, path, version, note=step.fingerprint)
            changed.unpersist()
            recorded[version] = V.versions(spark, path).where(F.col("version") == version).first()
            out.append((seq, step.name, "applied", before, recorded[version].rows))
        last = version
    return spark.createDataFrame(out, "seq int, step string, action string, rows_before long, rows_after long")


def rename_keys(rows: DataFrame, column: str, names: dict[str, str], human: str) -> DataFrame:
    """Old keys under their new names; a person's row with an old key is an error, as only that person may change it."""
    old = F.col(column).isin(*names)
    guarded = rows.withColumn(column, F.when(old & F.col(human), F.raise_error(F.concat(F.lit("a person's row has the old key "), column)).cast("string")).otherwise(F.col(column)))
    return guarded.replace(names, subset=[column])
