"""Surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def location_key(country: Column, city: Column) -> Column:
    """Hash of country and city; NULL when either is NULL."""
    return F.md5(F.concat(country, F.lit("|"), city))


def fact_key(date: Column, country: Column, city: Column) -> Column:
    return F.md5(F.concat(date.cast("string"), F.lit("|"), country, F.lit("|"), city))


def date_key(date: Column) -> Column:
    """Date as the number yyyymmdd, by arithmetic instead of format-and-parse."""
    return (F.year(date) * 10000 + F.month(date) * 100 + F.day(date)).cast("bigint")
