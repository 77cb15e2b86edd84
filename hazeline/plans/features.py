"""Backward-looking features with a forward target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.functions.ratios import recent_ratio, value_range
from hazeline.functions.rules import exceeds, season_flags
from hazeline.operators import series
from hazeline.operators.joins import attach_location, join_dates
from hazeline.plans.facts import require_metric

# History that must be present.
REQUIRED_HISTORY = [
    "pm25_7d_avg", "pm25_30d_avg", "pm25_90d_avg",
    "pm25_lag_1d", "pm25_lag_7d", "pm25_lag_30d",
    S.TARGET,
]
LOCATION_FEATURES = [
    "population", "n_stations", "population_per_station", "monitoring_density_score", "lat", "lon",
]


def require_history(df: DataFrame, columns: Sequence[str] = tuple(REQUIRED_HISTORY)) -> DataFrame:
    return df.dropna(subset=list(columns))


def require_target(df: DataFrame, target: str = S.TARGET) -> DataFrame:
    return df.dropna(subset=[target])


def history(fact: DataFrame, calendar: bool = False) -> DataFrame:
    """All history columns. They share one window specification, hence one shuffle and
    one sort, and only the columns they read go through it."""
    pm25 = "pm25_median"
    days = require_metric(fact).select(
        "date_key", "date", "country", "city", pm25, "pm10_median", "no2_median"
    )
    framed = days.select(
        "*",
        series.rolling_mean(pm25, 7, calendar).alias("pm25_7d_avg"),
        series.rolling_mean(pm25, 30, calendar).alias("pm25_30d_avg"),
        series.rolling_mean(pm25, 90, calendar).alias("pm25_90d_avg"),
        series.rolling_mean("pm10_median", 30, calendar).alias("pm10_30d_avg"),
        series.rolling_mean("no2_median", 30, calendar).alias("no2_30d_avg"),
        series.rolling_std(pm25, 7, calendar).alias("pm25_7d_volatility"),
        series.trend_delta(pm25, 7, 30, calendar).alias("pm25_trend"),
        *[c.alias(name) for name, c in series.lags(pm25, [1, 7, 14, 30], "pm25").items()],
        series.rolling_min(pm25, 30, calendar).alias("pm25_30d_min"),
        series.rolling_max(pm25, 30, calendar).alias("pm25_30d_max"),
        series.forward_mean(pm25, 30, calendar).alias(S.TARGET),
    )
    return framed.drop(pm25, "pm10_median", "no2_median")


def ml_features(
    fact: DataFrame,
    dim_locations: DataFrame,
    dim_dates: DataFrame,
    calendar: bool = False,
) -> DataFrame:
    """Feature table. Windows run first on narrow rows, then rows without enough history
    go, then the dimensions join: the place join finds the rows already partitioned
    and sorted by its keys."""
    kept = require_history(history(fact, calendar))
    placed = attach_location(kept, dim_locations, LOCATION_FEATURES)
    dated = join_dates(placed, dim_dates, ["year", "month", "day_of_week", "quarter", "is_weekend"])
    return dated.select(
        "country",
        "city",
        "date",
        "year",
        "month",
        "day_of_week",
        "quarter",
        "is_weekend",
        *[flag.alias(name) for name, flag in season_flags(F.col("month")).items()],
        *LOCATION_FEATURES,
        "pm25_7d_avg",
        "pm25_30d_avg",
        "pm25_90d_avg",
        "pm10_30d_avg",
        "no2_30d_avg",
        "pm25_7d_volatility",
        "pm25_trend",
        "pm25_lag_1d",
        "pm25_lag_7d",
        "pm25_lag_14d",
        "pm25_lag_30d",
        "pm25_30d_min",
        "pm25_30d_max",
        exceeds(F.col("pm25_7d_avg")).alias("was_exceeding_who_7d"),
        exceeds(F.col("pm25_30d_avg")).alias("was_exceeding_who_30d"),
        recent_ratio(F.col("pm25_lag_1d"), F.col("pm25_30d_avg")).alias("pm25_recent_ratio"),
        value_range(F.col("pm25_30d_min"), F.col("pm25_30d_max")).alias("pm25_30d_range"),
        S.TARGET,
        exceeds(F.col(S.TARGET)).alias("target_will_exceed_who"),
        F.current_timestamp().alias("created_at"),
    )
