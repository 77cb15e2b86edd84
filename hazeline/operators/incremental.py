"""Incremental loads: what of a new batch still has to be written."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline import schemas as S
from hazeline.functions.text import strict_iso_date
from hazeline.sources.sinks import staged, staging

#: Column by which loaded rows are laid out, and its value where there is no date.
MONTH = "month"
NO_MONTH = "none"


def lookback(
    df: DataFrame, as_of: datetime | Column | None = None, days: int = 14
) -> DataFrame:
    """Rows of the last days, counted back from the clock time ``as_of``. A date
    stands for its midnight, so the date exactly ``days`` ago is out unless as_of is
    midnight. Missing and unreadable dates are out."""
    if as_of is None:
        as_of = F.current_timestamp()
    elif not isinstance(as_of, Column):
        as_of = F.lit(as_of.isoformat(sep=" "))
    cutoff = as_of.cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    day = strict_iso_date(F.col("date").cast("string"))
    return df.filter(day.cast("timestamp_ntz") >= cutoff)


def after_high_watermark(batch: DataFrame, target: DataFrame, column: str = "date") -> DataFrame:
    """Rows newer than the newest of the target; all rows when the target is empty.
    The bound is a scalar subquery over one column; nothing is collected."""
    newest = target.agg(F.max(column)).scalar()
    return batch.filter(newest.isNull() | (F.col(column) > newest))


def month_of(within: str = "date") -> Column:
    """Month of a date or of its text, as ``yyyy-MM``; unreadable dates share one value."""
    month = F.substring(F.col(within).try_cast("date").cast("string"), 1, 7)
    return F.coalesce(month, F.lit(NO_MONTH))


def _months(batch: DataFrame, within: str) -> DataFrame:
    """The months of a batch, one row each: a hundred years are 1,200 rows. Spark only
    prunes partitions at run time by a side that it takes for selective, hence the
    comparison, which every month passes."""
    return batch.select(month_of(within).alias(MONTH)).filter(F.col(MONTH) > "").distinct()


def unseen(
    batch: DataFrame,
    target: DataFrame,
    keys: Sequence[str] = S.READING_KEYS,
    within: str = "date",
    dated: DataFrame | None = None,
) -> DataFrame:
    """As ``only_new``, for a batch that is cheap to read more than once, or that comes
    from rows ``dated`` which are: they have all of its months."""
    dated = batch if dated is None else dated
    if MONTH not in target.columns:
        span = dated.agg(F.struct(F.min(within).alias("first"), F.max(within).alias("last"))).scalar()
        target = target.filter(F.col(within).between(span["first"], span["last"]))
        target = target.withColumn(MONTH, month_of(within))
    known = target.join(F.broadcast(_months(dated, within)), MONTH, "left_semi")
    return batch.join(known.select(*keys).distinct(), list(keys), "left_anti").select(*batch.columns)


def only_new(
    batch: DataFrame, target: DataFrame, keys: Sequence[str] = S.READING_KEYS, within: str = "date"
) -> DataFrame:
    """Rows whose key the target does not hold yet. The batch is evaluated once, into the
    shared folder. The target is cut to the batch's own months before anything of it is
    shuffled: a target laid out by ``MONTH`` is only read there, so one late row costs its
    month and no more; of any other the date range still reaches the scan. A key stored
    many times costs one row. Gate the batch on its keys first: a NULL key is always new."""
    return unseen(staged(batch, "batch"), target, keys, within)


def write_months(df: DataFrame, path: str, within: str = "date", mode: str = "append") -> None:
    """Write rows by month. A month with many rows is split over several tasks."""
    rows = df.withColumn(MONTH, month_of(within)).hint("rebalance", MONTH)
    rows.write.mode(mode).partitionBy(MONTH).parquet(path)


def read_months(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of ``schema`` laid out by month, with the month; none if nothing is there."""
    empty = spark.createDataFrame([], schema).withColumn(MONTH, F.lit(NO_MONTH))
    empty.write.mode("ignore").partitionBy(MONTH).parquet(path)
    return spark.read.schema(empty.schema).parquet(path)


def load_batch(
    batch: DataFrame,
    path: str,
    keys: Sequence[str] = S.READING_KEYS,
    within: str = "date",
    reduce: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Append the new rows of a batch to a Parquet folder laid out by month; the first
    load makes it. The batch is evaluated once and only its months of the folder are
    read. Running it again, also after a failure, writes nothing more.

    With ``reduce`` the batch, which should then be files that are cheap to read twice, is
    reduced first. Its rows are not staged: a reduction by the keys leaves them where they
    meet the keys of the folder, so that they go through one shuffle for both."""
    if reduce is not None:
        rows = reduce(batch)
        target = read_months(batch.sparkSession, path, rows.schema)
        write_months(unseen(rows, target, keys, within, batch), path, within)
        return
    with staging(batch, "batch") as rows:
        target = read_months(batch.sparkSession, path, batch.schema)
        write_months(unseen(rows, target, keys, within), path, within)


def append_new(
    batch: DataFrame, table: str, keys: Sequence[str] = S.READING_KEYS, within: str = "date"
) -> None:
    """Append the new rows to a catalog table, which is made, laid out by month, if it is
    not there. Running it again writes nothing more."""
    spark = batch.sparkSession
    if not spark.catalog.tableExists(table):
        empty = spark.createDataFrame([], batch.schema).withColumn(MONTH, F.lit(NO_MONTH))
        empty.write.partitionBy(MONTH).format("parquet").saveAsTable(table)
    target = spark.read.table(table)
    with staging(batch, "batch") as rows:
        fresh = unseen(rows, target, keys, within)
        if MONTH in target.columns:
            fresh = fresh.withColumn(MONTH, month_of(within)).hint("rebalance", MONTH)
        fresh.select(*target.columns).write.insertInto(table)
