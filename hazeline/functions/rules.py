"""Bucketing rules and flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazeline import schemas as S

# Category ladders. Each rung is (bound, label); the first rung
# that holds wins, the last label catches the rest and NULL.
AQI_RUNGS = [
    (12.0, "Good"),
    (35.4, "Moderate"),
    (55.4, "Unhealthy for Sensitive Groups"),
    (150.4, "Unhealthy"),
    (250.4, "Very Unhealthy"),
]
AQI_REST = "Hazardous"
APP_AQI_RUNGS = [
    (12.0, "Good"),
    (35.4, "Moderate"),
    (55.4, "Unhealthy (Sensitive)"),
    (150.4, "Unhealthy"),
    (250.4, "Very Unhealthy"),
]
QUALITY_RUNGS = [(18, "High"), (12, "Medium")]
QUALITY_REST = "Low"
RISK_RUNGS = [(35.0, "Critical"), (25.0, "High"), (15.0, "Moderate")]
RISK_REST = "Low"
RISK_TIER_RUNGS = [(55.4, "high"), (12.0, "medium")]
RISK_TIER_REST = "low"
ACTION_TIER_RUNGS = [(150.4, "immediate"), (35.4, "protective")]
ACTION_TIER_REST = "standard"
DENSITY_RUNGS = [(50_000, 100), (100_000, 80), (250_000, 60), (500_000, 40), (1_000_000, 20)]
DENSITY_REST = 10
SEASON_MONTHS = {
    "winter": [12, 1, 2],
    "spring": [3, 4, 5],
    "summer": [6, 7, 8],
    "fall": [9, 10, 11],
}
WORSENING_FACTOR = 1.1
IMPROVING_FACTOR = 0.9


def at_most(c: Column, rungs: Sequence[tuple], rest) -> Column:
    out = F
    for bound, label in rungs:
        out = out.when(c <= F.lit(bound), F.lit(label))
    return out.otherwise(F.lit(rest))


def at_least(c: Column, rungs: Sequence[tuple], rest) -> Column:
    out = F
    for bound, label in rungs:
        out = out.when(c >= F.lit(bound), F.lit(label))
    return out.otherwise(F.lit(rest))


def above(c: Column, rungs: Sequence[tuple], rest) -> Column:
    out = F
    for bound, label in rungs:
        out = out.when(c > F.lit(bound), F.lit(label))
    return out.otherwise(F.lit(rest))


def aqi_category(c: Column, null_label: str | None = AQI_REST) -> Column:
    """Air-quality category of a PM2.5 value. A missing value reads 'Hazardous'
    unless ``null_label`` says otherwise (``None`` leaves it NULL)."""
    category = at_most(c, AQI_RUNGS, AQI_REST)
    if null_label == AQI_REST:
        return category
    return F.when(c.isNull(), F.lit(null_label)).otherwise(category)


def data_quality(c: Column) -> Column:
    return at_least(c, QUALITY_RUNGS, QUALITY_REST)


def density_score(population: Column, n_stations: Column) -> Column:
    """0 without stations, else a score from people per station; 10 when unknown."""
    per_station = F.when(n_stations != 0, population / n_stations)
    return F.when(n_stations == 0, F.lit(0)).otherwise(
        at_most(per_station, DENSITY_RUNGS, DENSITY_REST)
    )


def season(c: Column) -> Column:
    """Northern season of a date."""
    out = F
    for name, months in SEASON_MONTHS.items():
        out = out.when(F.month(c).isin(months), F.lit(name.capitalize()))
    return out


def season_flags(month: Column) -> dict[str, Column]:
    return {
        f"is_{name}": F.when(month.isin(months), 1).otherwise(0)
        for name, months in SEASON_MONTHS.items()
    }


def calendar_flags(c: Column) -> dict[str, Column]:
    return {
        "is_weekend": F.dayofweek(c).isin(1, 7),
        "is_month_start": F.day(c) == 1,
        "is_month_end": c == F.last_day(c),
    }


def trend_label(current: Column, previous: Column) -> Column:
    return (
        F.when(previous.isNull(), F.lit("No Data"))
        .when(current > previous * WORSENING_FACTOR, F.lit("Worsening"))
        .when(current < previous * IMPROVING_FACTOR, F.lit("Improving"))
        .otherwise(F.lit("Stable"))
    )


def risk_category(c: Column) -> Column:
    return above(c, RISK_RUNGS, RISK_REST)


def exceeds(c: Column, limit: float = S.DAILY_LIMIT["pm25"]) -> Column:
    """1 above the limit, else 0 (also for NULL)."""
    return F.when(c > limit, 1).otherwise(0)


def aqi_label(c: Column) -> Column:
    return at_most(c, APP_AQI_RUNGS, AQI_REST)


def risk_tier(c: Column) -> Column:
    return above(c, RISK_TIER_RUNGS, RISK_TIER_REST)


def action_tier(c: Column) -> Column:
    return above(c, ACTION_TIER_RUNGS, ACTION_TIER_REST)
