"""Streaming form of the incremental load."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from hazeline import schemas as S
from hazeline.operators.dedup import dedup_latest
from hazeline.operators.incremental import MONTH, load_batch, unseen, write_months
from hazeline.operators.quality import FEED_GATES, expect_or_drop
from hazeline.sources.sinks import staging


def landed_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType = S.READING,
    files_per_trigger: int | None = None,
    name_glob: str | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def load_new(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    keys: Sequence[str] = S.READING_KEYS,
    gates: Mapping[str, str] = FEED_GATES,
    reduce: Callable[[DataFrame], DataFrame] = dedup_latest,
) -> StreamingQuery:
    """Append to the Parquet folder ``out``, laid out by month, the rows whose key it does
    not hold yet, then stop once everything landed so far is in.

    State is the target itself, not a watermark: late rows are never dropped, and a
    micro-batch that is run again after a failure finds its rows already present.
    """

    def write(batch: DataFrame, _: int) -> None:
        load_batch(expect_or_drop(batch, gates), out, keys, reduce=reduce)

    return _start(stream, write, checkpoint)


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


FIRST, BATCH = "_first", "batch"


def settled_before(
    spark: SparkSession, path: str, schema: T.StructType = S.READING, event: str = "date", delay: str = "30 days"
) -> str | None:
    """The newest ``event`` landed at ``path`` less ``delay``: where the watermark stands once
    all of it is loaded, and so the time before which no key needs to be in the state."""
    at = F.col(event).try_cast("timestamp")
    last = F.max(at) - F.expr(f"INTERVAL {delay}")
    return spark.read.schema(schema).parquet(path).agg(last.cast("string")).head()[0]


def marked_first(
    stream: DataFrame,
    keys: Sequence[str] = S.READING_KEYS,
    event: str = "date",
    delay: str = "30 days",
    since: str | None = None,
) -> DataFrame:
    """The rows of a stream, and beside them one row marked ``FIRST`` for every key that is
    in time and was not seen before. Keys seen are kept in the state store until the
    watermark (the newest ``event`` less ``delay``) has passed them by ``delay``, so the
    state holds the keys of some weeks, however long the stream runs. Rows later than the
    watermark, or without a date, get no mark, nor do rows before ``since``: the first batch
    of a stream has no watermark yet, and years of keys would enter the state and leave it
    at once."""
    seen = (
        stream.withColumn("_at", F.col(event).try_cast("timestamp"))
        .filter(F.col("_at").isNotNull() if since is None else F.col("_at") >= F.lit(since).cast("timestamp"))
        .withWatermark("_at", delay)
        .select(*keys, "_at")
        .dropDuplicatesWithinWatermark(list(keys))
        .select(*keys, F.lit(True).alias(FIRST))
    )
    return stream.withColumn(FIRST, F.lit(False)).unionByName(seen, allowMissingColumns=True)


def loaded(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """What ``load_with_state`` has written, with the columns ``MONTH`` and ``BATCH``."""
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType()), T.StructField(MONTH, T.StringType())])
    spark.createDataFrame([], full).write.mode("ignore").partitionBy(BATCH, MONTH).parquet(out)
    return spark.read.schema(full).option("basePath", out).parquet(out)


def batch_writer(
    out: str,
    keys: Sequence[str] = S.READING_KEYS,
    reduce: Callable[[DataFrame], DataFrame] = dedup_latest,
    session: SparkSession | None = None,
) -> Callable[[DataFrame, int], None]:
    """Writes a micro-batch of ``marked_first``: keys marked go in at once, all others only
    if no earlier batch has written them. A batch has a folder of its own, so one that is
    run again replaces what its first run left. Spark turns adaptive plans off in the session
    of a stream with state; once staged, the rows go on in ``session``, which has them."""

    def write(batch: DataFrame, number: int) -> None:
        spark = session or batch.sparkSession
        with staging(batch, "micro-batch", session) as marked:
            firsts = marked.filter(FIRST).select(*keys, FIRST)
            best = reduce(marked.filter(f"NOT {FIRST}").drop(FIRST)).join(firsts, list(keys), "left")
            with staging(best, "reduced") as rows:
                others = rows.filter(F.col(FIRST).isNull()).drop(FIRST)
                earlier = loaded(spark, out, others.schema).filter(F.col(BATCH) < number)
                fresh = rows.filter(FIRST).drop(FIRST).unionByName(unseen(others, earlier, keys))
                write_months(fresh, f"{out}/{BATCH}={number}", mode="overwrite")

    return write


def load_with_state(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    keys: Sequence[str] = S.READING_KEYS,
    gates: Mapping[str, str] = FEED_GATES,
    reduce: Callable[[DataFrame], DataFrame] = dedup_latest,
    event: str = "date",
    delay: str = "30 days",
    since: str | None = None,
) -> StreamingQuery:
    """As ``load_new``, but keys in time are told from repeats by a state store bounded by
    a watermark and never meet the target. Only repeats and rows later than the watermark
    are looked up there, in their months, so no row is lost for being late. ``since``, as
    ``settled_before`` finds it, keeps the keys of earlier years out of the state when a
    history is loaded at first."""
    marked = marked_first(expect_or_drop(stream, gates), keys, event, delay, since)
    return _start(marked, batch_writer(out, keys, reduce, stream.sparkSession), checkpoint)


def stream_ingest(
    spark: SparkSession, landing: str, out: str, checkpoint: str, **options
) -> None:
    """Load what has landed as Parquet readings and wait for it."""
    load_new(landed_stream(spark, landing), out, checkpoint, **options).awaitTermination()
