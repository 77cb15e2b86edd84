import random
from datetime import date, datetime, timedelta
from statistics import mean, stdev

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import Observation

from hazeline import schemas as S
from hazeline.operators import aggregates, dedup, incremental, joins, pivot, quality, series, sets

READING = "date date, country string, city string, specie string, count int, min double, max double, median double, variance double"


def reading(day=1, city="a", specie="pm25", count=1, value=1.0, country="NG"):
    return (date(2020, 1, day), country, city, specie, count, value, value, value, value)


def best_by_hand(rows):
    best = {}
    for r in rows:
        rank = tuple((v is not None, v) if v is not None else (False, 0) for v in (r[4], r[6], r[5], r[7], r[8]))
        if r[:4] not in best or rank > best[r[:4]][0]:
            best[r[:4]] = (rank, r)
    return sorted((r for _, r in best.values()), key=repr)


rows_strategy = st.lists(
    st.builds(
        reading,
        day=st.integers(1, 2),
        specie=st.sampled_from(["pm25", "no2", "junk"]),
        count=st.one_of(st.none(), st.integers(0, 2)),
        value=st.one_of(st.none(), st.sampled_from([0.0, 1.0, 2.0])),
    ),
    min_size=1,
    max_size=12,
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=rows_strategy)
def test_dedup_best_any_order(spark, rows):
    want = best_by_hand(rows)
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, READING).repartition(3)
        once = dedup.dedup_best(df)
        assert sorted((tuple(r) for r in once.collect()), key=repr) == want
    assert dedup.dedup_best(once).count() == len(want)


def test_dedup_hot_key_leaves_one_row_per_task(spark):
    hot = [reading(value=float(i % 7), count=i % 5) for i in range(3000)]
    rows = hot + [reading(day=2 + i % 20, city=f"c{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, READING)
    assert sorted((tuple(r) for r in dedup.dedup_best(df).collect()), key=repr) == best_by_hand(rows)
    assert "partial_max" in dedup.dedup_best(df)._jdf.queryExecution().toString()


def test_dedup_latest(spark):
    rows = [("2020-01-01", "a", "x", datetime(2020, 1, 1), 1), ("2020-01-01", "a", "x", datetime(2020, 1, 2), 0)]
    df = spark.createDataFrame(rows, "date string, city string, specie string, _ingest_ts timestamp, v int")
    assert dedup.dedup_latest(df, ties=["v"]).collect()[0].v == 0


def test_pivot_forms_agree_and_round_trip(spark):
    rng = random.Random(3)
    rows = [
        reading(rng.randint(1, 5), rng.choice("ab"), rng.choice(S.SPECIES + ["junk"]), rng.randint(0, 30), rng.random())
        for _ in range(300)
    ]
    df = spark.createDataFrame(rows, READING)
    clean = dedup.dedup_best(df)
    a = sorted(pivot.pivot_daily(clean).collect(), key=repr)
    assert a == sorted(pivot.pivot_best(df).collect(), key=repr)
    back = pivot.unpivot_daily(pivot.pivot_daily(clean)).select(*clean.columns)
    known = clean.filter(F.col("specie").isin(S.SPECIES))
    assert sorted(back.collect(), key=repr) == sorted(known.collect(), key=repr)
    junk = spark.createDataFrame([reading(specie="junk")], READING)
    assert pivot.pivot_daily(junk).count() == 1
    assert pivot.pivot_daily(junk, known_only=True).count() == 0


def test_quality(spark):
    rows = [reading(), reading(city=None), reading(value=-1.0), reading(value=None)]
    df = spark.createDataFrame(rows, READING)
    assert quality.expect_or_drop(df, quality.CLEAN_GATES).count() == 3
    report = {
        r.rule: (r.action, r.passed, r.failed)
        for r in quality.quality_report(df, "x", quality.CLEAN_GATES, quality.MEASUREMENT_CHECKS).collect()
    }
    assert report["valid_city"] == ("drop", 3, 1)
    assert report["valid_measurements"] == ("warn", 2, 2)
    seen = Observation("seen")
    assert quality.expect(df, quality.MEASUREMENT_CHECKS, seen).count() == 4
    assert seen.get == {"valid_measurements": 2}
    assert [r.n_rows for r in quality.check_unique(df, ["specie"]).collect()] == [4]


def fact_days(spark, values, gap_after=None):
    rows, day = [], date(2020, 1, 1)
    for i, v in enumerate(values):
        rows.append((day, "NG", "a", v))
        day += timedelta(days=11 if i == gap_after else 1)
    return spark.createDataFrame(rows, "date date, country string, city string, v double")


@pytest.mark.parametrize("n", [1, 8, 31, 91])
def test_windows_against_hand(spark, n):
    rng = random.Random(n)
    vs = [None if i % 13 == 5 else rng.uniform(0, 100) for i in range(n)]
    df = fact_days(spark, vs, gap_after=4).select(
        "date",
        series.rolling_mean("v", 7).alias("m7"),
        series.rolling_std("v", 7).alias("s7"),
        series.rolling_min("v", 30).alias("lo"),
        series.rolling_max("v", 30).alias("hi"),
        series.trend_delta("v").alias("trend"),
        series.forward_mean("v", 30).alias("next"),
        *[c.alias(k) for k, c in series.lags("v", [1, 30], "v").items()],
    )

    def present(a, b):
        return [x for x in vs[max(a, 0) : max(b, 0)] if x is not None]

    for i, r in enumerate(df.orderBy("date").collect()):
        m7, m30, back = present(i - 7, i), present(i - 30, i), present(i - 30, i - 7)
        assert r.m7 == (pytest.approx(mean(m7)) if m7 else None)
        assert r.s7 == (pytest.approx(stdev(m7)) if len(m7) > 1 else None)
        assert (r.lo, r.hi) == ((min(m30), max(m30)) if m30 else (None, None))
        assert r.trend == (pytest.approx(mean(m7) - mean(back)) if m7 and back else None)
        ahead = present(i, i + 30)
        assert r.next == (pytest.approx(mean(ahead)) if ahead else None)
        assert r.v_lag_1d == (vs[i - 1] if i >= 1 else None)
        assert r.v_lag_30d == (vs[i - 30] if i >= 30 else None)


def test_history_never_sees_the_present(spark):
    base = [float(i % 9) for i in range(60)]
    changed = base[:40] + [v + 500 for v in base[40:]]

    def history(values):
        df = fact_days(spark, values).select(
            "date", series.rolling_mean("v", 90), series.trend_delta("v"), series.lag("v", 1),
            series.rolling_max("v", 30),
        )
        return [tuple(r) for r in df.orderBy("date").collect()]

    assert history(base)[:41] == history(changed)[:41]


def test_calendar_frame_counts_days(spark):
    df = fact_days(spark, [1.0, 2.0, 3.0, 4.0], gap_after=1)
    got = df.orderBy("date").select(series.rolling_mean("v", 7, calendar=True).alias("m")).collect()
    assert sorted(r.m for r in got if r.m is not None) == [1.0, 3.0]


def test_weighted_mean(spark):
    df = spark.createDataFrame(
        [("a", None, 1), ("a", 4.0, 1), ("b", 4.0, None), ("b", 2.0, 2), ("c", 1.0, 0)],
        "k string, v double, w bigint",
    )
    got = dict(df.groupBy("k").agg(aggregates.weighted_mean("v", "w")).collect())
    assert got == {"a": 2.0, "b": 2.0, "c": None}


def test_stations_to_places(spark):
    rows = [("NG", "a", "s", 1.0), ("NG", "a", None, 3.0), (None, "a", "s", 1.0), ("NG", None, "s", 1.0)]
    df = spark.createDataFrame(rows, "country string, city string, station_name string, station_lat double")
    got = aggregates.stations_to_places(df.withColumn("station_lon", F.lit(1.0))).collect()
    assert [(r.city_lat, r.n_stations) for r in got] == [(2.0, 1)]


def test_histogram_and_metrics(spark):
    df = spark.createDataFrame([(float(i), float(i) + 1) for i in range(101)], "y double, p double")
    bins = aggregates.histogram(df, "y", 40).orderBy("bin").collect()
    assert len(bins) == 40 and sum(b.n for b in bins) == 101
    assert bins[0].bin_start == 0.0 and bins[-1].bin_end == 100.0 and bins[-1].n == 3
    flat = aggregates.histogram(df.select(F.lit(2.0).alias("y")), "y", 4).orderBy("bin").collect()
    assert [b.n for b in flat] == [0, 0, 101, 0] and flat[0].bin_start == 1.5
    m = aggregates.regression_metrics(df, "y", "p").collect()[0]
    assert (m.mae, m.rmse) == (1.0, 1.0) and m.r2 == pytest.approx(1 - 101 / (850 * 101))


def test_gazetteer(spark):
    places = spark.createDataFrame([("NG", "Lagos"), ("NG", "Abuja"), ("NG", "Jos")], "country string, city string")
    gaz = spark.createDataFrame(
        [("lagos", "NG", 5, "PPLA"), ("LAGOS", "NG", 9, None), ("abuja", "NG", None, "PPLC")],
        "city string, country string, population bigint, feature string",
    )
    got = {r.city: (r.population, r.feature) for r in joins.gazetteer_join(places, gaz).collect()}
    assert got == {"Lagos": (9, "PPL"), "Abuja": (0, "PPLC"), "Jos": (0, "PPLA")}


def test_joins_scatter_rows_without_key(spark):
    n = 4000
    df = spark.range(n).select(
        F.when(F.col("id") < 10, "k").alias("location_key"),
        F.lit("NG").alias("country"),
        F.col("id").cast("string").alias("city"),
        F.lit("2020-01-01").alias("date"),
    )
    dim = spark.createDataFrame([("k", 1), ("other", 2)], "location_key string, population int")
    got = joins.join_location_key(df, dim, ["population"])
    assert got.count() == n and got.filter("population = 1 AND location_key = 'k'").count() == 10
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shuffled = joins.join_location_key(df, dim, ["population"])
        largest = shuffled.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert largest < n / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    raw = spark.createDataFrame(
        [(None, "Paris"), ("Unknown", "oslo"), ("DE", "paris"), (None, None)], "country string, city string"
    )
    mapping = spark.createDataFrame([("paris", "FR"), (" PARIS", "FX")], "city string, code string")
    filled = sorted(map(tuple, joins.fill_country_join(raw, mapping).collect()), key=repr)
    assert filled == sorted([("FR", "Paris"), ("Unknown", "oslo"), ("DE", "paris"), (None, None)], key=repr)


def test_concat_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("y", 2)], "b string, a int")
    got = sets.concat_by_name(a, b, a.select("a")).collect()
    assert sorted((r.a, r.b or "") for r in got) == [(1, ""), (1, "x"), (2, "y")]


def test_lookback_bounds(spark):
    days = ["2020-01-01", "2020-01-02", "2020-01-15", "Unknown", None, "2020"]
    df = spark.createDataFrame([(d,) for d in days], "date string")
    got = [r.date for r in incremental.lookback(df, datetime(2020, 1, 15, 9)).collect()]
    assert got == ["2020-01-02", "2020-01-15"]
    assert incremental.lookback(df, datetime(2020, 1, 15)).count() == 3


def test_watermark_and_anti_join(spark):
    batch = spark.createDataFrame([reading(d) for d in (1, 2, 3)], READING)
    target = spark.createDataFrame([reading(2)] * 50, READING)
    assert [r.date.day for r in incremental.after_high_watermark(batch, target).collect()] == [3]
    assert incremental.after_high_watermark(batch, target.limit(0)).count() == 3
    assert sorted(r.date.day for r in incremental.only_new(batch, target).collect()) == [1, 3]
    assert incremental.only_new(batch, target.limit(0)).count() == 3


def test_append_new_twice(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS appended")
    spark.createDataFrame([reading(1)], READING).write.option("path", str(tmp_path / "t")).saveAsTable("appended")
    batch = spark.createDataFrame([reading(d) for d in (1, 2, 3)], READING)
    for _ in range(2):
        incremental.append_new(batch, "appended")
        assert spark.read.table("appended").count() == 3
    spark.sql("DROP TABLE appended")
