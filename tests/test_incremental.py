"""Loads into a target laid out by month, batch-wise and as a stream with state."""

from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.operators import incremental
from hazeline.operators.dedup import dedup_best
from hazeline.sources import sinks
from hazeline.sources.sinks import staged
from hazeline.streaming import ingest

START = date(2015, 1, 1)


def readings(spark, days, specie="pm25", count=5, city="Lagos"):
    rows = [(d, "NG", city, specie, count, 1.0, 2.0, 1.5, 0.1) for d in days]
    return spark.createDataFrame(rows, "date date, country string, city string, specie string, count int, "
                                 "min double, max double, median double, variance double")  # fmt: skip


def nodes(plan):
    """All nodes of an executed plan, inside of what adaptive execution wraps too."""
    yield plan
    for inner in ("executedPlan", "plan"):
        if plan.nodeName() in ("AdaptiveSparkPlan", "ResultQueryStage", "ShuffleQueryStage", "BroadcastQueryStage"):
            try:
                yield from nodes(getattr(plan, inner)())
            except Exception:  # noqa: BLE001 - the other accessor
                pass
    children = plan.children()
    for k in range(children.size()):
        yield from nodes(children.apply(k))


def partitions_read(df, path):
    """Numbers of partitions that scans of a path have read."""
    found = []
    for node in nodes(df._jdf.queryExecution().executedPlan()):
        if node.nodeName().startswith("Scan parquet") and path in node.toString().replace("file:", ""):
            metric = node.metrics().get("numPartitions")
            if metric.isDefined():
                found.append(metric.get().value())
    return found


def test_load_reads_only_the_months_of_the_batch(spark, tmp_path):
    out = str(tmp_path / "target")
    incremental.load_batch(readings(spark, [START + timedelta(days=k) for k in range(1200)]), out)
    days = [START + timedelta(days=k) for k in (1195, 1199, 1200, 1203)] + [START - timedelta(days=1), START]
    batch = staged(readings(spark, days), "batch")
    target = incremental.read_months(spark, out, batch.schema)
    fresh = incremental.unseen(batch, target, S.READING_KEYS, "date")
    assert sorted(r.date for r in fresh.collect()) == sorted([days[2], days[3], days[4]])
    read = partitions_read(fresh, "target")
    months = {(d.year, d.month) for d in days}
    assert read and max(read) <= len(months) < 40
    assert "dynamicpruning" in fresh._jdf.queryExecution().toString()


def test_batch_is_evaluated_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    rows = readings(spark, [START + timedelta(days=k) for k in range(50)])

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    for load in range(1, 3):
        incremental.load_batch(rows.mapInArrow(counted, rows.schema), str(tmp_path / "t"))
        assert seen.value == 50 * load
    assert incremental.only_new(rows.mapInArrow(counted, rows.schema), rows).count() == 0
    assert seen.value == 150
    assert spark.read.parquet(str(tmp_path / "t")).count() == 50


def test_staged_batches_are_removed(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(sinks, "scratch_path", lambda s, label: made.append(str(tmp_path / f"{label}-{len(made)}")) or made[-1])
    incremental.load_batch(readings(spark, [START]), str(tmp_path / "t"))
    with pytest.raises(ZeroDivisionError), sinks.staging(readings(spark, [START]), "x"):
        raise ZeroDivisionError
    assert len(made) == 2 and not any(Path(p).exists() for p in made)


def test_reduced_batches_are_not_staged(spark, tmp_path, monkeypatch):
    """One shuffle of whole rows up to the comparison, not a second one from staged files."""
    made, out = [], str(tmp_path / "t")
    monkeypatch.setattr(sinks, "scratch_path", lambda s, label: made.append(label) or str(tmp_path / label))
    days = [START + timedelta(days=k) for k in range(0, 90, 10)]
    for load, n in ((days[:6], 6), (days, 9), (days, 9)):
        batch = readings(spark, load, count=3).unionByName(readings(spark, load, count=8))
        incremental.load_batch(batch, out, reduce=dedup_best)
        got = incremental.read_months(spark, out, batch.schema).collect()
        assert len(got) == n and {r["count"] for r in got} == {8}
    assert not made


def test_unreadable_dates_have_a_month_of_their_own(spark, tmp_path):
    out = str(tmp_path / "t")
    batch = spark.createDataFrame([("Unknown", "NG", "a", "co"), ("2021-02-03", "NG", "a", "co")], "date string, country string, city string, specie string")
    for _ in range(2):
        incremental.load_batch(batch, out)
    got = incremental.read_months(spark, out, batch.schema).collect()
    assert sorted((r.date, r.month) for r in got) == [("2021-02-03", "2021-02"), ("Unknown", "none")]
    empty = batch.limit(0)
    incremental.load_batch(empty, out)
    incremental.load_batch(empty, str(tmp_path / "other"))
    assert incremental.read_months(spark, str(tmp_path / "other"), batch.schema).count() == 0


def test_append_makes_a_table_by_month(spark):
    name = "appended_by_month"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    try:
        days = [START + timedelta(days=k) for k in range(90)]
        for batch in (days[:60], days, days):
            incremental.append_new(readings(spark, batch), name)
        assert spark.read.table(name).count() == 90
        assert spark.sql(f"SHOW PARTITIONS {name}").count() == 3
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def stream_days(spark, out, schema):
    return sorted((r.date, r["count"], r.batch) for r in ingest.loaded(spark, out, schema).collect())


def test_stream_state_is_bounded_and_loses_nothing(spark, tmp_path):
    landing, out, state = (str(tmp_path / x) for x in ("landing", "out", "state"))
    day = lambda *k: [START + timedelta(days=i) for i in k]
    landings = [
        (range(0, 20), 5),
        (range(15, 200), 6),  # some repeats in time, then the watermark moves on
        ([*range(190, 210), 3, -400], 7),  # repeats, new days, a late repeat and a late new day
    ]
    kept = []
    for days, count in landings:
        # Twice the same key in one landing: the better row counts.
        part = readings(spark, day(*days), count=count).unionByName(readings(spark, day(*days), count=1))
        part.write.mode("append").parquet(landing)
        query = ingest.load_with_state(
            ingest.landed_stream(spark, landing, part.schema), out, state, reduce=dedup_best, delay="10 days"
        )
        query.awaitTermination()
        kept.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    got = {d: c for d, c, _ in stream_days(spark, out, part.schema)}
    want = {}
    for days, count in landings:
        for d in day(*days):
            want.setdefault(d, count)
    assert got == want and len(stream_days(spark, out, part.schema)) == len(want)
    assert max(kept) <= 25 < len(want)


def test_history_stays_out_of_the_state_and_in_few_files(spark, tmp_path):
    landing, out, state = (str(tmp_path / x) for x in ("landing", "out", "state"))
    updated, want = [], {}
    for days, count in ((range(0, 400), 5), ([*range(380, 410), 7, -30], 6)):
        part = readings(spark, [START + timedelta(days=k) for k in days], count=count)
        part.write.mode("append").parquet(landing)
        since = ingest.settled_before(spark, landing, part.schema, delay="10 days")
        stream = ingest.landed_stream(spark, landing, part.schema)
        query = ingest.load_with_state(stream, out, state, reduce=dedup_best, delay="10 days", since=since)
        query.awaitTermination()
        updated += [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]]
        for k in days:
            want.setdefault(START + timedelta(days=k), count)
    assert 0 < max(updated) <= 11
    got = stream_days(spark, out, part.schema)
    assert {d: c for d, c, _ in got} == want and len(got) == len(want)
    months = [m for m in Path(out).glob("batch=*/month=*") if list(m.glob("*.parquet"))]
    assert months and all(len(list(m.glob("*.parquet"))) == 1 for m in months)


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = readings(spark, [START, START + timedelta(days=40)])
    write = ingest.batch_writer(out, reduce=dedup_best)
    first = rows.limit(1).select(*S.READING_KEYS).withColumn("_first", F.lit(True))
    batch = rows.withColumn("_first", F.lit(False)).unionByName(first, allowMissingColumns=True)
    for number in (0, 0, 1, 1, 0):
        write(batch, number)
    got = stream_days(spark, out, rows.schema)
    assert [d for d, _, b in got if b == 0] == [START, START + timedelta(days=40)]
    # The same mark again in a later batch would be the state's doing; unmarked keys are not.
    assert [d for d, _, b in got if b == 1] == [r.date for r in first.collect()]


@pytest.mark.parametrize("count", [0, 1])
def test_stream_without_rows(spark, tmp_path, count):
    landing, out, state = (str(tmp_path / x) for x in ("landing", "out", "state"))
    part = readings(spark, [START]).limit(count)
    part.write.parquet(landing)
    stream = ingest.landed_stream(spark, landing, part.schema)
    ingest.load_with_state(stream, out, state, reduce=dedup_best).awaitTermination()
    assert ingest.loaded(spark, out, part.schema).count() == count
