"""Row gates and their report. Rules are ``{name: SQL predicate}``; a predicate
that is NULL for a row counts as failed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

# Gates of the datasets.
CLEAN_GATES = {
    "valid_date": "date IS NOT NULL",
    "valid_country": "country IS NOT NULL",
    "valid_city": "city IS NOT NULL",
    "valid_specie": "specie IS NOT NULL",
}
SENSOR_GATES = {"valid_date": "date IS NOT NULL", "valid_country": "country = 'Nigeria'"}
FEED_GATES = {"valid_date": "date IS NOT NULL", "valid_country": "country IS NOT NULL"}
MEASUREMENT_CHECKS = {"valid_measurements": "min >= 0 AND max >= 0 AND median >= 0"}
LOCATION_GATES = {"valid_country": "country IS NOT NULL", "valid_city": "city IS NOT NULL"}
POLLUTANT_GATES = {
    "valid_pollutant_key": "pollutant_key IS NOT NULL",
    "valid_specie_name": "specie_name IS NOT NULL",
}
DATE_GATES = {"valid_date_key": "date_key IS NOT NULL", "valid_date": "date IS NOT NULL"}
FACT_GATES = {"valid_fact_key": "fact_key IS NOT NULL", "valid_date_key": "date_key IS NOT NULL"}
COMPARISON_GATES = {"valid_country": "country IS NOT NULL"}


def expect_or_drop(
    df: DataFrame, rules: Mapping[str, str], observation: Observation | None = None
) -> DataFrame:
    """Keep the rows that meet every rule. Plain filters, so they reach the scan. With an
    ``observation`` the failures per rule and the dropped rows (``dropped``) are counted
    in the same pass; the filters then stay above the counting."""
    if observation is not None:
        every = " AND ".join(f"({p})" for p in rules.values()) or "true"
        counts = [_failed(p).alias(name) for name, p in rules.items()]
        df = df.observe(observation, *counts, _failed(every).alias("dropped"))
    for predicate in rules.values():
        df = df.filter(F.expr(predicate))
    return df


def _failed(predicate: str):
    return F.count_if(~F.coalesce(F.expr(predicate), F.lit(False)))


def expect(df: DataFrame, rules: Mapping[str, str], observation: Observation) -> DataFrame:
    """Keep every row; the failures per rule are read from ``observation`` after the
    next action, so counting costs no extra pass."""
    return df.observe(observation, *[_failed(p).alias(name) for name, p in rules.items()])


def quality_report(
    df: DataFrame,
    dataset: str,
    drop_rules: Mapping[str, str],
    warn_rules: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per rule: dataset, rule, action, passed, failed. One pass over the data."""
    rules = [(name, "drop", p) for name, p in drop_rules.items()]
    rules += [(name, "warn", p) for name, p in (warn_rules or {}).items()]
    counted = df.agg(
        F.count("*").alias("_rows"),
        *[_failed(p).alias(f"_failed_{i}") for i, (_, _, p) in enumerate(rules)],
    )
    lines = F.array(
        *[
            F.struct(
                F.lit(dataset).alias("dataset"),
                F.lit(name).alias("rule"),
                F.lit(action).alias("action"),
                (F.col("_rows") - F.col(f"_failed_{i}")).alias("passed"),
                F.col(f"_failed_{i}").alias("failed"),
            )
            for i, (name, action, _) in enumerate(rules)
        ]
    )
    return counted.select(F.inline(lines))


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")
