"""Ratios and differences guarded against empty denominators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def per_station(population: Column, n_stations: Column) -> Column:
    return F.when(n_stations > 0, F.round(population / n_stations, 2))


def recent_ratio(recent: Column, baseline: Column) -> Column:
    return recent / F.nullif(baseline, F.lit(0.0))


def value_range(low: Column, high: Column) -> Column:
    return high - low


def deviation(value: Column, reference: Column | float) -> Column:
    return value - reference


def gauge_pct(value: Column, full_scale: float = 300.0) -> Column:
    """Share of the display scale in percent, clipped at 100."""
    return F.when(value.isNotNull(), F.least(value / full_scale * 100, F.lit(100.0)))
