"""One row per key.

Both forms are a grouped ``max`` over a struct whose leading fields are the
ordering. That equals ``row_number() = 1`` over the same fields descending with
nulls last, but it is combined on the map side: a key that holds a third of all
rows leaves each task as one row. A struct has no fixed width, so Spark sorts the rows
of a task by key to group them; no group is sorted by its values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline import schemas as S

# Most hourly samples first, then the highest maximum; the rest only settles ties.
BEST_READING_ORDER = ["count", "max", "min", "median", "variance"]
LATEST_KEYS = ["date", "city", "specie"]


def top1_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` values (descending, nulls last) of each
    key. Columns outside keys and order are appended to the ordering, so the
    result does not depend on how rows arrive."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    ranked = F.max(F.struct(*order, *rest)).alias("_top")
    grouped = df.groupBy(*keys).agg(ranked)
    return grouped.select(
        *[F.col(c) if c in keys else F.col("_top")[c].alias(c) for c in df.columns]
    )


def dedup_best(
    df: DataFrame,
    keys: Sequence[str] = S.READING_KEYS,
    order: Sequence[str] = BEST_READING_ORDER,
) -> DataFrame:
    return top1_per_group(df, keys, order)


def dedup_latest(
    df: DataFrame,
    keys: Sequence[str] = LATEST_KEYS,
    ingest: str = "_ingest_ts",
    ties: Sequence[str] = BEST_READING_ORDER,
) -> DataFrame:
    return top1_per_group(df, keys, [ingest, *ties])
