"""Writes and table management."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.session import scratch_path
from hazeline.sources.files import CSV_SPACES

LAYERS = ["bronze", "silver", "gold"]
CLUSTER_KEYS = ["country", "city", "date"]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Evaluate the rows once, into the shared folder, and go on from there. What reads
    them again, or runs again after a failure, reads the files."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staging(df: DataFrame, label: str, session: SparkSession | None = None) -> Iterator[DataFrame]:
    """As ``staged``, for work that ends within the block: the files go with it. They are
    read in the session of the rows, or in another one."""
    spark, path = session or df.sparkSession, scratch_path(df.sparkSession, label)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ensure_layers(spark: SparkSession, names: Sequence[str] = tuple(LAYERS)) -> None:
    for name in names:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def create_if_absent(df: DataFrame, table: str) -> None:
    """Create the table from the query; a table that exists is left alone, unread."""
    if not df.sparkSession.catalog.tableExists(table):
        df.write.mode("ignore").format("parquet").saveAsTable(table)


def overwrite_table(df: DataFrame, table: str) -> None:
    """Full refresh, schema included."""
    df.write.mode("overwrite").format("parquet").saveAsTable(table)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, **CSV_SPACES).csv(path)


def clustered(df: DataFrame, keys: Sequence[str] = tuple(CLUSTER_KEYS)) -> DataFrame:
    """Rows laid out by key ranges and sorted inside each file, so that row-group
    statistics skip most of the table for a filter on place or date. The date is
    part of the range key: a place with a long history spans several files."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def range_ranks(df: DataFrame, key: str, bits: int) -> DataFrame:
    """``key, rank``: for every value of a column the number of its range, of ``2**bits``
    ranges with about as many different values each; fewer values are spread over all
    numbers. Repeated values are reduced first, so a value that holds a third of all rows
    is one row here. NULL has no rank."""
    values = df.select(key).filter(F.col(key).isNotNull()).distinct()
    ranked = values.repartitionByRange(1 << bits, key).select(key, F.spark_partition_id().alias("rank"))
    ranked = staged(ranked, "ranks")
    ranges = ranked.agg(F.max("rank") + 1).scalar()
    return ranked.select(key, F.floor(F.col("rank") * (1 << bits) / ranges).alias("rank"))


def z_value(ranks: Sequence[Column], bits: int) -> Column:
    """The ranks' bits taken in turn, the first rank's highest bit leading."""
    places = [
        F.shiftleft(F.shiftright(rank, b).bitwiseAND(1).cast("long"), b * len(ranks) + len(ranks) - 1 - k)
        for b in range(bits)
        for k, rank in enumerate(ranks)
    ]
    return sum(places[1:], places[0])


def z_ordered(
    df: DataFrame, keys: Sequence[str] = tuple(CLUSTER_KEYS), bits: int = 6, files: int | None = None
) -> DataFrame:
    """Rows laid out along a curve through the ranges of all keys, so that row-group
    statistics skip most of the table for a filter on any one of them, not only on the
    first. The rows are evaluated once; they then meet the ranks of each key, a row a
    value, and are dealt and sorted by their place on the curve."""
    df = staged(df, "rows")
    placed = df
    for key in keys:
        ranks = range_ranks(df, key, bits).withColumnRenamed("rank", f"_rank_{key}")
        placed = placed.join(ranks, key, "left")
    z = z_value([F.coalesce(f"_rank_{k}", F.lit(0)) for k in keys], bits)
    placed = placed.withColumn("_z", z)
    dealt = placed.repartitionByRange(files, "_z") if files else placed.repartitionByRange("_z")
    return dealt.sortWithinPartitions("_z", *keys).select(*df.columns)


def write_z_ordered(
    df: DataFrame,
    path: str,
    keys: Sequence[str] = tuple(CLUSTER_KEYS),
    bits: int = 6,
    files: int | None = None,
    group_rows: int | None = None,
) -> None:
    """Write the rows ``z_ordered``, in row groups of at most ``group_rows`` rows."""
    writer = z_ordered(df, keys, bits, files).write.mode("overwrite")
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)


def write_clustered(df: DataFrame, path: str, keys: Sequence[str] = tuple(CLUSTER_KEYS)) -> None:
    clustered(df, keys).write.mode("overwrite").parquet(path)
