"""Landing datasets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession

from hazeline import schemas as S
from hazeline.operators.dedup import dedup_latest
from hazeline.operators.incremental import lookback
from hazeline.operators.quality import FEED_GATES, SENSOR_GATES, expect_or_drop
from hazeline.operators.sets import union_bronze
from hazeline.sources.files import empty_readings, read_csv_audited, read_parquet_audited
from hazeline.sources.payloads import readings_from_city_feed, readings_from_sensor_days


def bronze_readings(spark: SparkSession, parquet_dir: str, csv_path: str) -> DataFrame:
    """Historical readings from landed Parquet and CSV, aligned by name."""
    landed = read_parquet_audited(spark, parquet_dir).select(*S.READING.names)
    return union_bronze(landed, read_csv_audited(spark, csv_path).select(*S.READING.names))


def sensor_incremental(
    locations: DataFrame | None,
    days: DataFrame | None,
    as_of: datetime | Column | None = None,
    lookback_days: int = 14,
    spark: SparkSession | None = None,
) -> DataFrame:
    """Latest readings of the sensor feed within the lookback, gated. Without any
    landed payload: an empty relation of the right schema."""
    if locations is None or days is None:
        return empty_readings(spark or SparkSession.active())
    recent = lookback(readings_from_sensor_days(locations, days, as_of), as_of, lookback_days)
    return dedup_latest(expect_or_drop(recent, SENSOR_GATES))


def city_feed_incremental(
    feed: DataFrame | None,
    as_of: datetime | Column | None = None,
    spark: SparkSession | None = None,
) -> DataFrame:
    if feed is None:
        return empty_readings(spark or SparkSession.active())
    return dedup_latest(expect_or_drop(readings_from_city_feed(feed, as_of), FEED_GATES))
