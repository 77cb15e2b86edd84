"""Relations that come from constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline import schemas as S

POLLUTANT_SCHEMA = T.StructType(
    [
        T.StructField("specie_name", T.StringType()),
        T.StructField("who_guideline_24h", T.DoubleType()),
        T.StructField("who_guideline_annual", T.DoubleType()),
        T.StructField("health_impact_category", T.StringType()),
        T.StructField("description", T.StringType()),
    ]
)


def pollutant_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.POLLUTANTS, POLLUTANT_SCHEMA)


def surrogate_key(df: DataFrame, order: str, name: str) -> DataFrame:
    """Consecutive numbers in a global order. The order needs a single task, so this
    is for relations of constants only."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(order)))


def date_spine(
    spark: SparkSession, start: str = S.SPINE_START, last_offset: int = S.SPINE_LAST_OFFSET
) -> DataFrame:
    """Every date from start to start + last_offset, both included. A range has exact
    size statistics, so joins to it are broadcast by size, not by hint."""
    return spark.range(last_offset + 1).select(
        F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("date")
    )
