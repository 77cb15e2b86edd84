"""Daily fact and its monthly and yearly roll-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.functions.keys import date_key, fact_key
from hazeline.functions.rules import aqi_category, data_quality, trend_label
from hazeline.operators.aggregates import daily_measures
from hazeline.operators.joins import attach_location, join_dates, join_location_key
from hazeline.operators.pivot import metric_columns, pivot_best, pivot_daily
from hazeline.operators.quality import FACT_GATES, expect_or_drop


def _daily(wide: DataFrame, dim_locations: DataFrame, species: Sequence[str]) -> DataFrame:
    d = F.col("date")
    placed = attach_location(wide, dim_locations)
    return placed.select(
        fact_key(d, F.col("country"), F.col("city")).alias("fact_key"),
        date_key(d).alias("date_key"),
        "location_key",
        "date",
        "country",
        "city",
        *metric_columns(species),
        aqi_category(F.col("pm25_median")).alias("aqi_category"),
        data_quality(F.col("pm25_count")).alias("data_quality"),
        F.current_timestamp().alias("created_at"),
    )


def fact_daily(
    clean: DataFrame,
    dim_locations: DataFrame,
    species: Sequence[str] = S.SPECIES,
    known_only: bool = False,
    observed: Observation | None = None,
) -> DataFrame:
    """Daily fact from the stored, already deduplicated readings."""
    fact = _daily(pivot_daily(clean, species, known_only), dim_locations, species)
    return expect_or_drop(fact, FACT_GATES, observed)


def fact_daily_from_readings(
    readings: DataFrame,
    dim_locations: DataFrame,
    species: Sequence[str] = S.SPECIES,
    known_only: bool = False,
) -> DataFrame:
    """The same fact straight from ``standardised``, not yet deduplicated readings:
    deduplication and pivot in one shuffle. The gates of those readings already
    guarantee the keys; testing them again here would only push the whole cleaning
    expression into the scan once more."""
    return _daily(pivot_best(readings, species, known_only), dim_locations, species)


def require_metric(df: DataFrame, column: str = "pm25_median") -> DataFrame:
    return df.filter(F.col(column).isNotNull())


ROLLUP_KEYS = ["location_key", "country", "city", "year", "month", "quarter"]


def _labelled(rolled: DataFrame, period) -> DataFrame:
    measures = [c for c in rolled.columns if c not in ROLLUP_KEYS and c != "_level"]
    return rolled.select(*ROLLUP_KEYS, period.alias("aggregation_period"), *measures)


def _days(fact: DataFrame, dim_dates: DataFrame, dim_locations: DataFrame | None) -> DataFrame:
    needed = [
        "date_key", "location_key", "date", "country", "city",
        "pm25_median", "pm25_min", "pm25_max", "pm25_count", "pm10_median", "no2_median",
    ]
    days = require_metric(fact).select(*needed)
    if dim_locations is not None:
        days = join_location_key(days, dim_locations, [])
    return join_dates(days, dim_dates, ["year", "month", "quarter"])


def monthly_rollup(days: DataFrame) -> DataFrame:
    rolled = days.groupBy(*ROLLUP_KEYS).agg(*daily_measures())
    return _labelled(rolled, F.lit("monthly"))


def yearly_rollup(days: DataFrame) -> DataFrame:
    keys = [k for k in ROLLUP_KEYS if k not in ("month", "quarter")]
    nothing = F.lit(None).cast("int")
    rolled = days.groupBy(*keys).agg(*daily_measures())
    return _labelled(
        rolled.withColumn("month", nothing).withColumn("quarter", nothing), F.lit("yearly")
    )


def period_rollup(days: DataFrame) -> DataFrame:
    """Monthly and yearly roll-up in one scan and one shuffle. The level comes from
    ``grouping_id``, since the month of a real row may be NULL too."""
    yearly = [k for k in ROLLUP_KEYS if k not in ("month", "quarter")]
    rolled = days.groupingSets([ROLLUP_KEYS, yearly], *ROLLUP_KEYS).agg(
        F.grouping_id().alias("_level"), *daily_measures()
    )
    return _labelled(rolled, F.when(F.col("_level") == 0, "monthly").otherwise("yearly"))


def previous_period(column: str = "pm25_avg_median"):
    """The same measure one period before, per place and period length."""
    earlier = Window.partitionBy("country", "city", "aggregation_period").orderBy(
        "year", F.coalesce("month", F.lit(0))
    )
    return F.lag(column).over(earlier)


def fact_aggregated(
    fact: DataFrame, dim_dates: DataFrame, dim_locations: DataFrame | None = None
) -> DataFrame:
    """Monthly and yearly measures with the trend against the previous period.

    The fact already carries ``location_key``; a location table only matters when it
    may hold fewer keys than the fact, or several rows per key, and is then joined."""
    rolled = period_rollup(_days(fact, dim_dates, dim_locations))
    previous = F.col("pm25_prev_period")
    return (
        rolled.withColumn("pm25_prev_period", previous_period())
        .withColumn("trend_indicator", trend_label(F.col("pm25_avg_median"), previous))
        .withColumn("created_at", F.current_timestamp())
    )
