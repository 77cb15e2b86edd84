"""Equi-joins of the star schema.

No hint is set: location tables grow with the data, so Spark compares their size
with its broadcast threshold and otherwise sorts and merges, splitting skewed
partitions at run time. Rows of a left join that have no key to look up would all
meet in one task; they get scattered keys that match nothing instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.operators.dedup import top1_per_group

PLACE_KEYS = ["country", "city"]


def attach_location(
    fact: DataFrame, dim: DataFrame, columns: Sequence[str] = ("location_key",)
) -> DataFrame:
    """Left join on country and city; rows without a known place keep NULLs."""
    return fact.join(dim.select(*PLACE_KEYS, *columns), PLACE_KEYS, "left")


# Starts a key that no table holds.
NO_MATCH = "\u0001"
SCATTER = 4096


def scattered(key: Column, present: Column, *spread: str) -> Column:
    """The key where present, else one of ``SCATTER`` keys that match nothing."""
    bucket = F.pmod(F.xxhash64(*spread), F.lit(SCATTER)).cast("string")
    return F.when(present, key).otherwise(F.concat(F.lit(NO_MATCH), bucket))


def join_location_key(fact: DataFrame, dim: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left join on the surrogate key. The key of the result is that of the location
    table: NULL for rows without a match."""
    key = F.col("location_key")
    places = dim.select(key.alias("_key"), key.alias("_matched"), *columns)
    keyed = fact.withColumn("_key", scattered(key, key.isNotNull(), *PLACE_KEYS, "date"))
    return (
        keyed.join(places, "_key", "left").withColumn("location_key", F.col("_matched"))
    ).drop("_key", "_matched")


def join_location_inner(fact: DataFrame, dim: DataFrame, columns: Sequence[str]) -> DataFrame:
    return fact.join(dim.select("location_key", *columns), "location_key", "inner")


def join_dates(fact: DataFrame, dim: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Left join to the calendar on the date key, whichever integer width it has.
    Dates outside the calendar keep NULLs."""
    days = dim.select(F.col("date_key").cast("bigint").alias("date_key"), *columns)
    return fact.join(days, "date_key", "left")


def fill_country_join(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """``fill_country`` with the mapping as a table of (city, code), for mappings too
    long to write down. Of several codes for a city the smallest counts."""
    lacks = F.col("country").isNull() | (F.col("country") == S.UNKNOWN)
    city_key = F.lower(F.trim("city"))
    lookup = (
        mapping.select(city_key.alias("_city_key"), F.col("code").alias("_code"))
        .groupBy("_city_key")
        .agg(F.min("_code").alias("_code"))
    )
    wanted = F.coalesce(lacks & F.col("city").isNotNull(), F.lit(False))
    keyed = df.withColumn("_city_key", scattered(city_key, wanted, *df.columns))
    return (
        keyed.join(lookup, "_city_key", "left")
        .withColumn("country", F.coalesce("_code", "country"))
        .select(*df.columns)
    )


def top1_match(gazetteer: DataFrame) -> DataFrame:
    """The most populous entry of each country and case-folded city name."""
    entries = gazetteer.select(
        "country",
        F.lower(F.trim("city")).alias("_city_key"),
        F.col("population").cast("bigint").alias("population"),
        "feature",
    )
    return top1_per_group(entries, ["country", "_city_key"], ["population", "feature"])


def gazetteer_join(places: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Population and feature code per place. No entry gives 0 and 'PPLA'; an entry
    with a missing field gives 0 or 'PPL' for that field."""
    best = top1_match(gazetteer).withColumn("_found", F.lit(True))
    joined = places.withColumn("_city_key", F.lower(F.trim("city"))).join(
        best, ["country", "_city_key"], "left"
    )
    return joined.select(
        *places.columns,
        F.coalesce("population", F.lit(0)).cast("bigint").alias("population"),
        F.when(F.col("_found"), F.coalesce("feature", F.lit("PPL")))
        .otherwise(F.lit("PPLA"))
        .alias("feature"),
    )
