"""Dimensions of the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.functions.keys import date_key, location_key
from hazeline.functions.ratios import per_station
from hazeline.functions.rules import calendar_flags, density_score, season
from hazeline.operators.aggregates import distinct_rows
from hazeline.operators.dedup import top1_per_group
from hazeline.operators.quality import (
    DATE_GATES,
    LOCATION_GATES,
    POLLUTANT_GATES,
    expect_or_drop,
)
from hazeline.sources.inline import date_spine, pollutant_rows, surrogate_key


def dim_locations(
    places: DataFrame, unique: bool = True, observed: Observation | None = None
) -> DataFrame:
    """Places with coverage measures. A key listed with several attribute sets would
    multiply every fact row that joins to it, so by default one row per key is kept:
    most stations, then population, lat, lon. ``unique=False`` keeps them all."""
    base = places.select(
        "country",
        "city",
        F.col("city_lat").alias("lat"),
        F.col("city_lon").alias("lon"),
        "population",
        "n_stations",
    )
    base = expect_or_drop(base, LOCATION_GATES, observed)
    if unique:
        base = top1_per_group(base, ["country", "city"], ["n_stations", "population", "lat", "lon"])
    else:
        base = distinct_rows(base, base.columns)
    return base.select(
        location_key(F.col("country"), F.col("city")).alias("location_key"),
        "country",
        "city",
        "lat",
        "lon",
        "population",
        "n_stations",
        per_station(F.col("population"), F.col("n_stations")).alias("population_per_station"),
        density_score(F.col("population"), F.col("n_stations")).alias("monitoring_density_score"),
        F.current_timestamp().alias("created_at"),
        F.current_timestamp().alias("updated_at"),
    )


def dim_pollutants(spark: SparkSession, observed: Observation | None = None) -> DataFrame:
    keyed = surrogate_key(pollutant_rows(spark), "specie_name", "pollutant_key")
    return expect_or_drop(
        keyed.select("pollutant_key", *pollutant_rows(spark).columns), POLLUTANT_GATES, observed
    )


def dim_dates(
    spark: SparkSession,
    start: str = S.SPINE_START,
    last_offset: int = S.SPINE_LAST_OFFSET,
    observed: Observation | None = None,
) -> DataFrame:
    d = F.col("date")
    days = date_spine(spark, start, last_offset).select(
        date_key(d).cast("int").alias("date_key"),
        "date",
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month"),
        F.day(d).alias("day"),
        F.dayofweek(d).alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.weekofyear(d).alias("week_of_year"),
        F.dayofyear(d).alias("day_of_year"),
        season(d).alias("season"),
        *[flag.alias(name) for name, flag in calendar_flags(d).items()],
    )
    return expect_or_drop(days, DATE_GATES, observed)
