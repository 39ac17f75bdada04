"""Dates: tolerant parsing, ISO weeks and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """yyyy-MM-dd, M/d/yyyy or yyyyMMdd; null if none fits."""
    return F.coalesce(*[F.try_to_timestamp(F.when(text.rlike(rx), text), F.lit(p)).cast("date") for rx, p in ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{8}$", "yyyyMMdd"))])


def week_start(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def week_id(day: Column) -> Column:
    """ISO week as YYYY-Www."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def months_before(day: Column, reference: Column) -> Column:
    return (F.year(reference) - F.year(day)) * 12 + F.month(reference) - F.month(day)


def in_five_years(day: Column, reference: Column) -> Column:
    """From the same day five years before (28 February for the 29th) up to the reference."""
    return (day >= F.add_months(reference, -60)) & (day <= reference)
