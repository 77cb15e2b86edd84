"""A focus country against its peers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.functions.ratios import deviation
from hazeline.functions.rules import risk_category
from hazeline.operators.aggregates import exceedance_pct, weighted_mean
from hazeline.operators.joins import join_location_inner
from hazeline.operators.quality import COMPARISON_GATES, expect_or_drop

LIMIT = S.DAILY_LIMIT["pm25"]


def select_countries(df: DataFrame, codes: Sequence[str]) -> DataFrame:
    codes = list(codes)
    if len(codes) == 1:
        return df.filter(F.col("country") == codes[0])
    return df.filter(F.col("country").isin(codes))


def city_stats(fact: DataFrame, dim_locations: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Long-run means per city of the given countries, with the place's attributes.
    Days are aggregated before the join, so the join sees one row per city. Days
    without a PM2.5 value count in the exceedance share."""
    per_city = (
        select_countries(fact, codes)
        .filter(F.col("location_key").isNotNull())
        .groupBy("location_key", "country", "city")
        .agg(
            F.avg("pm25_median").alias("avg_pm25"),
            F.avg("pm10_median").alias("avg_pm10"),
            F.avg("no2_median").alias("avg_no2"),
            exceedance_pct("pm25_median", LIMIT).alias("pm25_exceedance_pct"),
            F.count("*").alias("total_days"),
        )
    )
    attributes = ["population", "n_stations", "monitoring_density_score"]
    places = dim_locations.select("location_key", *attributes).distinct()
    return join_location_inner(per_city, places, attributes)


def focus_city_stats(
    fact: DataFrame, dim_locations: DataFrame, focus: str = S.FOCUS_COUNTRY
) -> DataFrame:
    return city_stats(fact, dim_locations, [focus]).drop("location_key")


def peer_country_stats(
    fact: DataFrame, dim_locations: DataFrame, peers: Sequence[str] = tuple(S.PEER_COUNTRIES)
) -> DataFrame:
    """Country figures over city figures: cities count equally in the means, and by
    population in the weighted mean."""
    cities = city_stats(fact, dim_locations, peers)
    return cities.groupBy("country").agg(
        F.count_distinct("city").alias("n_cities"),
        F.sum("population").alias("total_population"),
        F.sum("n_stations").alias("total_stations"),
        F.avg("avg_pm25").alias("country_avg_pm25"),
        F.avg("pm25_exceedance_pct").alias("country_exceedance_pct"),
        weighted_mean("avg_pm25", "population").alias("population_weighted_pm25"),
    )


# Country figures whose mean over countries makes the benchmark.
BENCHMARKED = [
    "country_avg_pm25", "country_exceedance_pct", "population_weighted_pm25",
    "total_population", "total_stations",
]


def benchmark_mean(countries: DataFrame) -> DataFrame:
    """Means over the countries: one row."""
    means = countries.agg(*[F.avg(c).alias(c) for c in BENCHMARKED])
    return means.withColumnRenamed("country_avg_pm25", "benchmark_avg_pm25")


NATIONAL = "National Average"


def focus_and_peers(cities: DataFrame, focus: str, peers: Sequence[str]) -> DataFrame:
    """Focus cities as they are and peer countries over their cities, from one pass over
    city figures: a city enters once for itself if in focus, once for its country if that
    is a peer. A focus city is a group of one row, so its means are its own figures."""
    focal = F.col("country") == focus
    roles = F.array_compact(
        F.array(F.when(focal, F.lit(False)), F.when(F.col("country").isin(list(peers)), F.lit(True)))
    )
    national = F.col("national")
    own = lambda c: F.when(~national, F.col(c))
    place = ["location_key", "city", "population", "n_stations", "monitoring_density_score"]
    grouped = (
        cities.withColumn("national", F.explode(roles))
        .groupBy("national", "country", *[own(c).alias(f"own_{c}") for c in place])
        .agg(
            F.sum("population").alias("population"),
            F.sum("n_stations").alias("n_stations"),
            F.avg("avg_pm25").alias("mean_pm25"),
            weighted_mean("avg_pm25", "population").alias("weighted_pm25"),
            F.avg("avg_pm10").alias("mean_pm10"),
            F.avg("avg_no2").alias("mean_no2"),
            F.avg("pm25_exceedance_pct").alias("pm25_exceedance_pct"),
        )
    )
    # One row per focus city and peer country is left, so one task can hold them.
    everything = Window.partitionBy(F.lit(1))
    return grouped.select(
        "country",
        F.when(national, F.lit(NATIONAL)).otherwise(F.col("own_city")).alias("city"),
        "population",
        "n_stations",
        F.col("own_monitoring_density_score").alias("monitoring_density_score"),
        F.when(national, F.col("weighted_pm25")).otherwise(F.col("mean_pm25")).alias("avg_pm25"),
        own("mean_pm10").alias("avg_pm10"),
        own("mean_no2").alias("avg_no2"),
        "pm25_exceedance_pct",
        F.avg(F.when(national, F.col("mean_pm25"))).over(everything).alias("benchmark_avg_pm25"),
    )


def focus_vs_peers(
    fact: DataFrame,
    dim_locations: DataFrame,
    focus: str = S.FOCUS_COUNTRY,
    peers: Sequence[str] = tuple(S.PEER_COUNTRIES),
    observed: Observation | None = None,
) -> DataFrame:
    """Focus cities and peer countries in one table. The fact is built once."""
    cities = city_stats(fact, dim_locations, list(dict.fromkeys([focus, *peers])))
    rows = focus_and_peers(cities, focus, peers)
    pm25 = F.col("avg_pm25")
    view = rows.select(
        "country",
        "city",
        "population",
        "n_stations",
        "monitoring_density_score",
        "avg_pm25",
        "avg_pm10",
        "avg_no2",
        "pm25_exceedance_pct",
        F.lit(LIMIT).alias("who_guideline_24h"),
        deviation(pm25, LIMIT).alias("deviation_from_who"),
        "benchmark_avg_pm25",
        deviation(pm25, F.col("benchmark_avg_pm25")).alias("vs_benchmark"),
        F.col("population").alias("population_at_risk"),
        risk_category(pm25).alias("risk_category"),
    )
    return expect_or_drop(view, COMPARISON_GATES, observed)
