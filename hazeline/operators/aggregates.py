"""Grouped measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline import schemas as S


def exceedance_days(c: str, limit: float) -> Column:
    """Days strictly above the limit."""
    return F.count_if(F.col(c) > limit)


def exceedance_pct(c: str, limit: float) -> Column:
    """Share of all days in the group, in percent; days without a value count as days."""
    return exceedance_days(c, limit) * F.lit(100.0) / F.count("*")


def weighted_mean(value: str, weight: str) -> Column:
    """Sum of value times weight over sum of weights; a weight whose value is missing
    still counts below the line. NULL when the weights sum to zero."""
    total = F.sum(weight).cast("double")
    return F.sum(F.col(value) * F.col(weight)) / F.nullif(total, F.lit(0.0))


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def stations_to_places(stations: DataFrame) -> DataFrame:
    """Mean position and number of named stations per country and city. Rows
    without a country or city are left out."""
    return (
        stations.dropna(subset=["country", "city"])
        .groupBy("country", "city")
        .agg(
            F.avg("station_lat").alias("city_lat"),
            F.avg("station_lon").alias("city_lon"),
            F.count("station_name").alias("n_stations"),
        )
    )


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: name, type, values present, rows. One pass."""
    counted = df.agg(
        F.count("*").alias("_rows"),
        *[F.count(F.col(f"`{c}`")).alias(f"_n_{i}") for i, c in enumerate(df.columns)],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(kind).alias("column_type"),
                F.col(f"_n_{i}").alias("n_present"),
                F.col("_rows").alias("n_rows"),
            )
            for i, (name, kind) in enumerate(df.dtypes)
        ]
    )
    return counted.select(F.inline(lines))


def profile_readings(df: DataFrame) -> DataFrame:
    """Row count, date range, number of distinct species and cities. The first level
    shrinks the data to one row per species and city, so the distinct counts run on that."""
    seen = df.groupBy("specie", "city").agg(
        F.count("*").alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi")
    )
    return seen.agg(
        F.sum("n").alias("n_rows"),
        F.min("lo").alias("first_date"),
        F.max("hi").alias("last_date"),
        F.count_distinct("specie").alias("n_species"),
        F.count_distinct("city").alias("n_cities"),
    )


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins from the minimum to the maximum, both included; empty bins
    are shown. A constant column is spread half a unit to either side first."""
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"))
    bounds = values.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi")))
    counted = (
        values.withColumn("_b", bounds.scalar())
        .select("_v", F.col("_b.lo").alias("_lo"), F.col("_b.hi").alias("_hi"))
        .withColumn("_flat", F.col("_lo") == F.col("_hi"))
        .select(
            F.when(F.col("_flat"), F.lit(bins // 2))
            .otherwise(
                F.least(
                    F.floor(
                        (F.col("_v") - F.col("_lo"))
                        / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
                        * bins
                    ),
                    F.lit(bins - 1),
                )
            )
            .cast("int")
            .alias("bin"),
        )
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    spark = df.sparkSession
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    low, high = F.col("_b.lo"), F.col("_b.hi")
    pad = F.when(low == high, F.lit(0.5)).otherwise(F.lit(0.0))
    width = (high - low + pad * 2) / bins
    return (
        all_bins.join(counted, "bin", "left")
        .withColumn("_b", bounds.scalar())
        .filter(low.isNotNull())
        .select(
            "bin",
            (low - pad + width * F.col("bin")).alias("bin_start"),
            (low - pad + width * (F.col("bin") + 1)).alias("bin_end"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        )
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean absolute error, root mean squared error and share of variance explained,
    over rows that have both values."""
    pairs = df.select(
        F.col(actual).cast("double").alias("_y"), F.col(predicted).cast("double").alias("_p")
    ).dropna()
    error = F.col("_y") - F.col("_p")
    spread = F.var_pop("_y") * F.count("*")
    return pairs.agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (1 - F.sum(error * error) / F.nullif(spread, F.lit(0.0))).alias("r2"),
    )


def daily_measures(limits: dict[str, float] = S.DAILY_LIMIT) -> list[Column]:
    """Measures shared by every period of the roll-up."""
    return [
        F.min("date").alias("period_start_date"),
        F.max("date").alias("period_end_date"),
        F.avg("pm25_median").alias("pm25_avg_median"),
        F.min("pm25_min").alias("pm25_period_min"),
        F.max("pm25_max").alias("pm25_period_max"),
        F.stddev_samp("pm25_median").alias("pm25_std_dev"),
        exceedance_days("pm25_median", limits["pm25"]).alias("pm25_exceedance_days"),
        F.count("*").alias("total_days_measured"),
        F.round(exceedance_pct("pm25_median", limits["pm25"]), 2).alias("pm25_exceedance_pct"),
        F.avg("pm10_median").alias("pm10_avg_median"),
        exceedance_days("pm10_median", limits["pm10"]).alias("pm10_exceedance_days"),
        F.avg("no2_median").alias("no2_avg_median"),
        exceedance_days("no2_median", limits["no2"]).alias("no2_exceedance_days"),
        F.avg("pm25_count").alias("avg_daily_measurements"),
        F.min("pm25_count").alias("min_daily_measurements"),
    ]
