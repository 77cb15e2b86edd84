import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.plans import bronze, places
from hazeline.session import shared_dir
from hazeline.sources import files, inline, payloads, sinks
from hazeline.streaming import ingest
from hazeline.testbed import registry


def docs(spark, *payload_rows, keys=()):
    rows = [(*k, json.dumps(p) if not isinstance(p, str) else p) for *k, p in payload_rows]
    names = ", ".join([*keys, "payload string"])
    return spark.createDataFrame(rows, names)


def test_preamble_is_dropped_once_per_file(spark, tmp_path):
    """Also when a file is read in many splits and several files share a task."""
    for name, n in (("a", 4000), ("b", 3), ("c", 0)):
        body = "".join(f"2020-01-01,NG, c{i} ,pm25,{i},1.0,2.0,3.0,4.0\n" for i in range(n))
        head = "note\n\nnote, more\nnote\nDate,Country,City,Specie,count,min,max,median,variance\n"
        (tmp_path / f"{name}.csv").write_text(head + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = files.read_csv_preamble(spark, str(tmp_path / "*.csv"))
        assert df.rdd.getNumPartitions() > 4
        got = df.collect()
        out = str(tmp_path / "out")
        files.csv_preamble_to_parquet(spark, str(tmp_path / "*.csv"), out)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 4003 and sorted({r["count"] for r in got}) == list(range(4000))
    assert {r.city for r in got if r["count"] == 1} == {" c1 "}
    back = spark.read.parquet(out)
    assert dict(back.groupBy("source_name").count().collect()) == {"a": 4000, "b": 3}


def test_source_name_is_cut_without_patterns(spark):
    paths = ["file:/x.csv/a.csv", "file:/x/part-0-c000.txt", "b.csv.csv", "s3://x/.csv", "d"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select(files.source_name(F.col("p")).alias("n"))
    assert [r.n for r in rows.collect()] == ["a", "part-0-c000.txt", "b.csv", ".csv", "d"]
    assert "regexp" not in rows._jdf.queryExecution().toString().lower()


def test_preamble_query_lands_files_that_open_with_prose(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(registry, "scratch_path", lambda s, label: str(tmp_path / label))
    rows = registry.csv_preamble(spark, sf)
    landed = [p.read_text().split("\n") for p in (tmp_path / "preamble").glob("*.txt")]
    assert len(landed) > 1
    assert all(lines[:2] == ["# prose", "# licence"] and lines[4] == ",".join(registry.DATA) for lines in landed)
    assert sum(lines.count("# prose") for lines in landed) == len(landed)
    assert sum(len(lines) - 6 for lines in landed) == rows.count()


def test_preamble_columns_go_by_name(spark, tmp_path):
    prose = "one\ntwo, of a.csv\n\nfour\n"
    (tmp_path / "a.csv").write_text(prose + "Country,Date,City,Specie,count,min,max,median,variance\nNG,2020-01-01,Lagos,pm25,1,1,2,1.5,0.1\n")
    (tmp_path / "b.csv").write_text(prose.replace("a.", "b.") + "extra,MEDIAN,date,country,city,specie,count,min,max\nx,2.5,2020-01-02,KE,\"Nai, robi\",o3,3,1,4\n")
    (tmp_path / "c.csv").write_text("only\nprose\n")
    (tmp_path / "d.csv").write_text("")
    got = files.read_csv_preamble(spark, str(tmp_path / "*.csv")).orderBy("date").collect()
    assert [(r.date, r.country, r.city, r.median, r.variance) for r in got] == [
        ("2020-01-01", "NG", "Lagos", 1.5, 0.1), ("2020-01-02", "KE", "Nai, robi", 2.5, None),
    ]
    plain = files.read_csv_preamble(spark, str(tmp_path / "a.csv"), skip=5, header=False).collect()
    assert [(r.date, r.country) for r in plain] == [("NG", "2020-01-01")]
    assert files.read_csv_preamble(spark, str(tmp_path / "c.csv")).count() == 0


def test_first_lines_open_a_file_only_at_its_start(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"{k}.csv").write_text(f"head {k}\n" + "".join(f"{i},x\n" for i in range(60_000)))
    got = files.first_lines(spark, str(tmp_path), 2)
    assert [lines for _, lines in got] == [[f"head {k}", "0,x"] for k in range(5)]
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != str(1 << 50)
    assert files.csv_headers(spark, str(tmp_path)).keys() == {f"head {k}" for k in range(5)}


def test_bronze_and_sinks(spark, tmp_path):
    rows = [("2020-01-01", "Nigeria", "Lagos ", "pm25", 1, 1.0, 2.0, 1.5, 0.1)]
    df = spark.createDataFrame(rows, S.READING_DATA)
    df.select(*reversed(df.columns)).write.parquet(str(tmp_path / "p"))
    sinks.write_csv(df, str(tmp_path / "c"))
    out = bronze.bronze_readings(spark, str(tmp_path / "p"), str(tmp_path / "c"))
    assert out.columns == S.READING.names
    got = out.collect()
    assert {r._source_format for r in got} == {"parquet", "csv"}
    assert all(r.city == "Lagos " and r._source_file.startswith("file:") for r in got)
    sinks.ensure_layers(spark)
    sinks.ensure_layers(spark)
    table = "bronze.readings_test"
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    sinks.create_if_absent(out, table)
    sinks.create_if_absent(out.limit(0), table)
    assert files.read_table(spark, table).count() == 2
    sinks.overwrite_table(df.select("city"), table)
    assert spark.read.table(table).columns == ["city"]
    spark.sql(f"DROP TABLE {table}")
    assert files.empty_readings(spark).schema == S.READING


def test_clustered_layout_splits_a_long_history(spark, tmp_path):
    df = spark.range(4000).select(
        F.lit("NG").alias("country"), F.lit("a").alias("city"),
        F.date_add(F.lit("2010-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = sinks.clustered(df).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(r["count"] for r in parts) < 3000
    sinks.write_clustered(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4000


def test_places_and_stations_json(spark):
    doc = [
        {
            "Place": {"country": "NG", "name": "Lagos", "feature": "PPL", "geo": [1.5, 2.5], "pop": 7},
            "Stations": [{"Name": "s1", "Latitude": 1.0, "Longitude": 2.0}, {"Name": None}],
            "Sources": [{"name": "x"}, {"url": "y"}],
        },
        {"Place": {"country": "NG", "name": "Jos"}},
        {},
    ]
    df = docs(spark, (doc,), ([],), ("broken",))
    got = payloads.places_from_json(df).collect()
    assert len(got) == 3
    by_city = {r.city: r for r in got}
    assert by_city["Lagos"].n_stations == 2 and by_city["Lagos"].sources == "['x', None]"
    assert (by_city["Lagos"].city_lat, by_city["Lagos"].city_lon) == (1.5, 2.5)
    assert by_city["Jos"].n_stations == 0 and by_city["Jos"].sources == "[]"
    stations = payloads.stations_from_json(df).collect()
    assert sorted((r.city, r.station_name or "") for r in stations) == [("Lagos", ""), ("Lagos", "s1")]


def test_sensor_days_defaults(spark):
    loc = {
        "results": [
            {"name": "Ikeja", "country": {"name": "Ghana"}, "sensors": [{"id": 1, "parameter": {"name": "pm25"}}]},
            {"name": None, "sensors": [{"id": 2}]},
            {"sensors": [{"id": 3}]},
            {"name": "empty"},
        ]
    }
    stamp = {"datetimeFrom": {"local": "2020-01-02T00:00+01:00", "utc": "2020-01-01T23:00Z"}}
    day = lambda summary, period=stamp: {"summary": summary, "period": period}
    days = docs(
        spark,
        (1, {"results": [day({"count": 3, "min": 1, "max": 2.5, "median": 2, "sd": 0.5})]}),
        (2, {"results": [day({"count": None, "min": None})]}),
        (3, {"results": [day({}, {"datetimeFrom": {"utc": "2020-01-01T23:00Z"}}), 5, day({}, {}), {"period": 3}]}),
        (3, {"results": [day({}, {"datetimeFrom": {"local": None, "utc": "2020-01-01T"}}), day({}, {"datetimeFrom": {"local": "soonT"}})]}),
        (9, {"results": [day({})]}),
        (1, "broken"),
        keys=["sensor_id bigint"],
    )
    got = payloads.readings_from_sensor_days(docs(spark, (loc,), (loc,)), days, datetime(2020, 1, 3)).collect()
    by_file = {r._source_file: r for r in got}
    assert len(got) == 3
    one, two, three = (by_file[f"openaq_sensor_{i}"] for i in (1, 2, 3))
    assert (one.city, one.country, one.specie, one.date) == ("Ikeja", "Ghana", "pm25", "2020-01-02")
    assert (one["count"], one.min, one.max, one.variance) == (3, 1.0, 2.5, 0.25)
    assert (two.city, two.country, two.specie) == (None, "Nigeria", "unknown")
    assert (two["count"], two.min, two.max, two.variance) == (None, None, 0.0, 0.0)
    assert (three.city, three.date, three["count"]) == ("Unknown", "2020-01-01", 0)
    recent = bronze.sensor_incremental(docs(spark, (loc,)), days, datetime(2020, 1, 16, 1))
    assert [r.country for r in recent.collect()] == []
    recent = bronze.sensor_incremental(docs(spark, (loc,)), days, datetime(2020, 1, 15, 1))
    assert {r.country for r in recent.collect()} == {"Nigeria"}
    assert bronze.sensor_incremental(None, None, spark=spark).count() == 0
    assert bronze.city_feed_incremental(None, spark=spark).schema == S.READING


def test_city_feed(spark):
    def feed(name, iaqi, status="ok", time=None):
        data = {"iaqi": iaqi, "time": {"s": time} if time else {}}
        if name:
            data["city"] = {"name": name}
        return {"status": status, "data": data}

    df = docs(
        spark,
        ("beijing", feed("Beijing, PRC, China", {"pm25": {"v": 5}, "w": 3, "t": {"x": 1}, "o3": {"v": "1.5"}}, time="2020-01-02 08:00:00")),
        ("paris", feed(None, {"no2": {"v": 2.5}})),
        ("oslo", feed("Oslo", {"no2": {"v": 2.5}}, status="error")),
        ("rome", {"status": "ok", "data": "nothing"}),
        ("bonn", "broken"),
        keys=["feed_name string"],
    )
    got = {(r.city, r.specie): r for r in payloads.readings_from_city_feed(df, datetime(2020, 5, 6)).collect()}
    assert set(got) == {("Beijing", "pm25"), ("Beijing", "o3"), ("paris", "no2")}
    r = got["Beijing", "pm25"]
    assert (r.country, r.date, r["count"], r.min, r.max, r.median, r.variance) == ("China", "2020-01-02", 1, 5.0, 5.0, 5.0, 0.0)
    assert (got["paris", "no2"].country, got["paris", "no2"].date) == ("Unknown", "2020-05-06")


def test_places_from_all_sources(spark):
    search = docs(
        spark,
        ({"status": "ok", "data": [{"station": {"name": "Kano North", "geo": [1.0, 2.0]}}]},),
        ({"status": "error", "data": [{"station": {"name": "Bad", "geo": [1.0, 2.0]}}]},),
    )
    located = docs(spark, ({"results": [{"name": "ABUJA centre", "coordinates": None}, {"name": None, "coordinates": {"latitude": 3.0, "longitude": 4.0}}]},))
    doc = docs(spark, ([{"Place": {"country": "FR", "name": "Paris", "geo": [0.0, 0.0], "pop": 1}}],))
    gaz = spark.createDataFrame([("Kano", "NG", 9, "PPLA2")], "city string, country string, population bigint, feature string")
    got = {r.city: r for r in places.places(doc, search, located, gaz).collect()}
    assert set(got) == {"Paris", "Kano", "Abuja", "Lagos"}
    assert (got["Kano"].population, got["Kano"].feature, got["Kano"].n_stations) == (9, "PPLA2", 1)
    assert (got["Abuja"].population, got["Abuja"].feature, got["Abuja"].city_lat) == (0, "PPLA", None)
    assert (got["Lagos"].n_stations, got["Lagos"].city_lat) == (0, 3.0)
    assert places.stations(doc, search, located).count() == 3


def test_date_spine(spark):
    spine = inline.date_spine(spark)
    got = spine.agg(F.count("*"), F.min("date").cast("string"), F.max("date").cast("string")).first()
    assert tuple(got) == (5001, "2015-01-01", "2028-09-09")


def test_stream_loads_each_key_once(spark, tmp_path):
    def land(name, days):
        rows = [(f"2020-01-{d:02d}", "NG", "a", "pm25", d, 1.0, 1.0, 1.0, 0.0, datetime(2020, 1, d), "f", "x") for d in days]
        spark.createDataFrame(rows * 3, S.READING).write.mode("append").parquet(str(tmp_path / "landing"))

    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for days, total in (((5, 6), 2), ((1, 5, 7), 4), ((), 4)):
        if days:
            land("x", days)
        ingest.stream_ingest(spark, str(tmp_path / "landing"), out, state)
        assert spark.read.parquet(out).count() == total


def test_csv_by_header_name(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text(
        "Country,Date,City,Specie,count,min,max,median,variance\nNG,2020-01-01,Lagos,pm25,1,1,2,1.5,0.1\n"
    )
    (folder / "b.csv").write_text(
        "extra,MEDIAN,date,country,city,specie,count,min,max\nx,2.5,2020-01-02,KE,Nairobi,o3,3,1,4\n"
    )
    (folder / "c.csv").write_text("date,country,city,specie,count,min,max,median,variance\n")
    rows = files.read_csv_audited(spark, str(folder)).orderBy("date").collect()
    assert [(r.date, r.country, r.city, r.median, r.variance) for r in rows] == [
        ("2020-01-01", "NG", "Lagos", 1.5, 0.1), ("2020-01-02", "KE", "Nairobi", 2.5, None),
    ]
    assert [r._source_file.rsplit("/")[-1] for r in rows] == ["a.csv", "b.csv"]


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
