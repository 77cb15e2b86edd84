"""Layers as files, and the layout that prunes by any key."""

import random
from datetime import date, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.plans import facts, layers
from hazeline.sources import sinks
from hazeline.testbed import adapter as A


def counting(spark, df, seen):
    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def test_layers_read_their_sources_once_and_switch_versions(spark, sf, tmp_path, monkeypatch):
    root, seen = str(tmp_path), spark.sparkContext.accumulator(0)
    raw = A.readings_raw(spark, sf)
    sources = [counting(spark, raw, seen), A.readings_increment(spark, sf)]
    assert layers.newest(spark, root) == 0
    assert layers.build(spark, root, sources, A.places(spark, sf)) == 1
    assert seen.value == raw.count()
    assert layers.published(spark, root).count() == 10
    first = layers.read(spark, root, "fact_daily").count()
    assert first == layers.published(spark, root).filter("dataset = 'fact_daily'").head()["n_rows"]

    # A build that fails on the way changes nothing for readers.
    monkeypatch.setattr(facts, "fact_aggregated", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        layers.build(spark, root, [raw.limit(10)], A.places(spark, sf))
    assert layers.newest(spark, root) == 1 and layers.read(spark, root, "fact_daily").count() == first
    monkeypatch.undo()

    assert layers.build(spark, root, [raw.filter("specie = 'pm25'")], A.places(spark, sf)) == 2
    assert 0 < layers.read(spark, root, "fact_daily").count() < first == layers.read(spark, root, "fact_daily", 1).count()
    gates = layers.gate_counts(spark, root).filter("dataset = 'readings_clean' AND rule = 'dropped'").collect()
    assert sorted(r.version for r in gates) == [1, 2] and all(r.failed > 0 for r in gates)
    with pytest.raises(LookupError):
        layers.read(spark, root, "no_such")


def test_layers_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], S.READING)
    places = spark.createDataFrame([], "country string, city string, city_lat double, city_lon double, population long, n_stations long")
    layers.build(spark, str(tmp_path), [empty], places)
    rows = {r.dataset: r.n_rows for r in layers.published(spark, str(tmp_path)).collect()}
    assert rows["readings"] == rows["fact_daily"] == rows["ml_features"] == 0 and rows["dim_dates"] == 5001


def groups_touched(path, column, value):
    """Row groups whose range of a column holds a value, and all of them."""
    touched = total = 0
    for file in Path(path).glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.to_arrow_schema().names.index(column)
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            total += 1
            touched += stats is None or not stats.has_min_max or stats.min <= value <= stats.max
    return touched, total


def test_z_order_prunes_by_any_key(spark, tmp_path):
    rng = random.Random(1)
    days = [date(2019, 1, 1) + timedelta(days=k) for k in range(300)]
    rows = [(f"C{c % 12:02}", f"city {c * 37 % 200:03}", d, c, 1.0) for c in range(200) for d in days]
    rows += [("C00", "city 000", d, 0, 2.0) for d in days for _ in range(100)]  # a third of all rows in one city
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "country string, city string, date date, n int, v double").repartition(4)
    wanted = {"date": days[123], "city": "city 111", "country": "C07"}
    z, plain = str(tmp_path / "z"), str(tmp_path / "plain")
    sinks.write_z_ordered(df, z, files=256)
    df.repartitionByRange(256, *sinks.CLUSTER_KEYS).sortWithinPartitions(*sinks.CLUSTER_KEYS).write.parquet(plain)
    assert sorted(spark.read.parquet(z).collect()) == sorted(df.collect())
    for column, value in wanted.items():
        touched, total = groups_touched(z, column, value)
        assert total >= 200 and touched < total / 4, (column, touched, total)
    touched, total = groups_touched(plain, "date", wanted["date"])
    assert touched > total / 4


def test_z_order_of_odd_rows(spark, tmp_path):
    rows = [(None, "a", 1), (None, None, 2), ("x", None, 3), ("x", "a", 3), ("x", "a", 3)]
    df = spark.createDataFrame(rows, "country string, city string, rank int")
    for part in (df, df.limit(0)):
        out = sinks.z_ordered(part, ["country", "city"], bits=3)
        assert out.columns == df.columns
        assert sorted(map(str, out.collect())) == sorted(map(str, part.collect()))
    sinks.write_z_ordered(spark.range(100).select("id"), str(tmp_path / "t"), ["id"], files=1, group_rows=10)
    assert pq.ParquetFile(next((tmp_path / "t").glob("*.parquet"))).metadata.num_row_groups >= 5


def test_z_value_takes_bits_in_turn(spark):
    row = spark.range(1).select(sinks.z_value([F.lit(0b101), F.lit(0b011)], 3).alias("z")).head()
    assert row.z == 0b100111
