"""Reporting queries over the gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.operators.joins import attach_location


def trend(fact: DataFrame, period: str = "month", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean PM2.5 and PM10 per period."""
    start = F.trunc("date", period).alias("period_start")
    return fact.groupBy(*by, start).agg(
        F.avg("pm25_median").alias("avg_pm25"),
        F.avg("pm10_median").alias("avg_pm10"),
        F.count("pm25_median").alias("n_days"),
    )


def focus_trend(
    fact: DataFrame, dim_locations: DataFrame, code: str = S.FOCUS_COUNTRY, period: str = "month"
) -> DataFrame:
    """History of one country's cities with their station coverage."""
    monthly = trend(fact.filter(F.col("country") == code), period, ("country", "city"))
    return attach_location(monthly, dim_locations, ["n_stations", "monitoring_density_score"])


def exceedance_by_city_year(aggregated: DataFrame) -> DataFrame:
    """Share of days above the guideline per city and year."""
    return aggregated.filter(F.col("aggregation_period") == "yearly").select(
        "country",
        "city",
        "year",
        "pm25_exceedance_days",
        "total_days_measured",
        "pm25_exceedance_pct",
    )


def seasonality(fact: DataFrame) -> DataFrame:
    """Means per month of the year."""
    return fact.groupBy(F.month("date").alias("month")).agg(
        F.avg("pm25_median").alias("avg_pm25"),
        F.avg("pm10_median").alias("avg_pm10"),
        F.avg("no2_median").alias("avg_no2"),
        F.count("pm25_median").alias("n_days"),
    )


def coverage(fact: DataFrame, dim_locations: DataFrame) -> DataFrame:
    """Station coverage and completeness per city: share of days in each quality class."""
    per_city = fact.groupBy("country", "city").agg(
        F.count("*").alias("n_days"),
        *[
            (F.count_if(F.col("data_quality") == label) * 100.0 / F.count("*")).alias(
                f"{label.lower()}_pct"
            )
            for label in ("High", "Medium", "Low")
        ],
    )
    return attach_location(
        per_city,
        dim_locations,
        ["population", "n_stations", "population_per_station", "monitoring_density_score"],
    )


def head(df: DataFrame, n: int = 10, order: str | None = None) -> DataFrame:
    """Preview of the first n rows, in an order if given (a top-n, not a full sort)."""
    return (df.orderBy(order) if order else df).limit(n)


def sort_desc(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(F.desc(column))
