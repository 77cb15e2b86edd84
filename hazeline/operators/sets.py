"""Unions, always aligned by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def concat_by_name(*dfs: DataFrame) -> DataFrame:
    """Stack rows; columns one side lacks are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Stack inputs that must share one set of columns."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


union_bronze = union_sources
