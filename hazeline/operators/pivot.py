"""Long readings to one wide row per date, country and city."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.operators.dedup import BEST_READING_ORDER

DAY_KEYS = ["date", "country", "city"]


def metric_columns(species: Sequence[str] = S.SPECIES) -> list[str]:
    return [f"{specie}_{metric}" for specie in species for metric in S.METRICS]


def pivot_daily(
    clean: DataFrame, species: Sequence[str] = S.SPECIES, known_only: bool = False
) -> DataFrame:
    """Pivot readings that are already unique per key. Species outside the list
    leave no column but still make their day appear, unless ``known_only``."""
    if known_only:
        clean = clean.filter(F.col("specie").isin(list(species)))
    return clean.groupBy(*DAY_KEYS).agg(
        *[
            F.max(F.when(F.col("specie") == specie, F.col(metric))).alias(f"{specie}_{metric}")
            for specie in species
            for metric in S.METRICS
        ]
    )


def pivot_best(
    readings: DataFrame, species: Sequence[str] = S.SPECIES, known_only: bool = False
) -> DataFrame:
    """``pivot_daily(dedup_best(readings))`` as one aggregation and one shuffle: the
    best reading of each species is itself a grouped maximum, so deduplication and
    pivot share the exchange on date, country and city."""
    if known_only:
        readings = readings.filter(F.col("specie").isin(list(species)))
    best = readings.groupBy(*DAY_KEYS).agg(
        *[
            F.max(F.when(F.col("specie") == specie, F.struct(*BEST_READING_ORDER))).alias(specie)
            for specie in species
        ]
    )
    return best.select(
        *DAY_KEYS,
        *[
            F.col(specie)[metric].alias(f"{specie}_{metric}")
            for specie in species
            for metric in S.METRICS
        ],
    )


def unpivot_daily(wide: DataFrame, species: Sequence[str] = S.SPECIES) -> DataFrame:
    """Back to long form; species without any value on a day give no row."""
    entries = F.array(
        *[
            F.struct(
                F.lit(specie).alias("specie"),
                *[F.col(f"{specie}_{metric}").alias(metric) for metric in S.METRICS],
            )
            for specie in species
        ]
    )
    long = wide.select(*DAY_KEYS, F.inline(entries))
    return long.filter(F.coalesce(*[F.col(m).cast("double") for m in S.METRICS]).isNotNull())
