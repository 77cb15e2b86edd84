"""Cleaned readings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.functions.text import (
    clean_city,
    country_of_city,
    fill_country,
    normalise_country,
    parse_date,
)
from hazeline.operators.dedup import dedup_best
from hazeline.operators.quality import CLEAN_GATES, expect_or_drop
from hazeline.operators.sets import union_sources


def drop_audit(df: DataFrame) -> DataFrame:
    return df.drop(*S.AUDIT_COLUMNS)


def standardised(
    hist: DataFrame,
    *increments: DataFrame,
    aliases: Mapping[str, str] = S.COUNTRY_ALIASES,
    focus: str = S.FOCUS_COUNTRY,
    cities: Sequence[str] = S.FOCUS_CITIES,
    city_map: Mapping[str, str] = S.CITY_COUNTRY,
    observed: Observation | None = None,
) -> DataFrame:
    """Union of all sources with dates parsed, countries and cities standardised and
    the row gates applied. Row-wise only: no shuffle.

    The gates come before the deduplication, which they do not affect (they test its
    keys), so that rows without a key never meet in one task. They are also put in
    terms of the columns as landed: a filter on the cleaned columns would be pushed
    below them with the whole cleaning expression in it. With ``observed`` what each
    gate drops is counted, and the gates stay behind the cleaning."""
    sources = [
        drop_audit(df).withColumn("date", parse_date(F.col("date"))).select(*S.READING_DATA.names)
        for df in (hist, *increments)
    ]
    country, city = F.col("country"), F.col("city")
    aliased = union_sources(*sources).withColumn("country", normalise_country(country, aliases))
    # A city of the focus country is never missing once cleaned; a missing country can
    # still come from the city.
    complete = (
        F.col("date").isNotNull()
        & F.col("specie").isNotNull()
        & (city.isNotNull() | (country == focus))
        & (country.isNotNull() | country_of_city(city, city_map).isNotNull())
    )
    cleaned = (
        (aliased if observed else aliased.filter(complete))
        .withColumn("city", clean_city(country, city, focus, cities))
        .withColumn("country", fill_country(country, city, city_map))
    )
    return expect_or_drop(cleaned, CLEAN_GATES, observed) if observed else cleaned


def readings_clean(hist: DataFrame, *increments: DataFrame, **options) -> DataFrame:
    """One best reading per date, country, city and species."""
    best = dedup_best(standardised(hist, *increments, **options))
    return best.withColumn("_processed_ts", F.current_timestamp())
