"""Parties of cases: who opposes whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import starts_with_name

#: Parties that are benefit plans or trusts; the shortest single word that identifies a vendor.
PLAN_PARTY = (
    r"(?i)\b(benefit|welfare|health)\s+plan\b|\btrust\s+fund|\bpension\b|\bannuity\b|"
    r"\b401\s*\(?k\)?\b|\bwelfare\s+fund\b|\bmedical\s+plan\b|\bhealth\s+and\s+welfare\b"
)
SHORTEST_WORD = 6


def opposing_vendors(cases: DataFrame, vendors: DataFrame, key: str, max_parties: int = 12) -> DataFrame:
    """Per case the first party that is a vendor and not the company: (key, party, vendor, commercial).

    cases has key, company, caption, parties (array) and commercial; vendors has vendor, in lower case. Parties meet vendors by the
    words of the vendor's name, first word first, so no case is paired with all vendors.
    """
    names = vendors.where(F.contains("vendor", F.lit(" ")) | (F.length("vendor") >= SHORTEST_WORD)).distinct()
    first = lambda c: F.regexp_extract(c, "^([a-z0-9]+)", 1)
    rows = cases.where(F.size("parties") <= max_parties).select("*", F.posexplode("parties").alias("place", "party"))
    rows = rows.where(~F.col("party").rlike(PLAN_PARTY) & ~starts_with_name(F.col("party"), F.array("company")))
    words = rows.withColumn("word", F.explode(F.array_distinct(F.filter(F.split(F.lower("party"), "[^a-z0-9]+"), lambda x: x != ""))))
    met = words.join(F.broadcast(names.withColumn("word", first("vendor"))), "word") if names.count() <= 100_000 else words.join(names.withColumn("word", first("vendor")), "word")
    bounded = F.concat(F.lit(r"\b\Q"), "vendor", F.lit(r"\E\b"))
    met = met.where(F.regexp_like(F.lower("party"), bounded) & F.regexp_like(F.lower("caption"), bounded))
    return met.groupBy(key).agg(F.min_by(F.struct("party", "vendor", "commercial"), F.struct("place", "vendor")).alias("hit")).select(key, "hit.*")
