from datetime import date
from hashlib import md5

from pyspark.sql import functions as F

from hazeline.functions import keys, ratios, rules, text


def column(spark, values, kind, *exprs):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [tuple(r) for r in df.select(*exprs).collect()]


def test_aqi_bounds(spark):
    values = [12.0, 12.0001, 35.4, 55.4, 150.4, 250.4, 250.5, None]
    x = F.col("x")
    got = column(spark, values, "double", rules.aqi_category(x), rules.aqi_category(x, None))
    assert [g[0] for g in got] == [
        "Good", "Moderate", "Moderate", "Unhealthy for Sensitive Groups", "Unhealthy",
        "Very Unhealthy", "Hazardous", "Hazardous",
    ]
    assert got[-1][1] is None and got[-2][1] == "Hazardous"


def test_quality_risk_and_tiers(spark):
    x = F.col("x")
    assert column(spark, [18, 17, 12, 11, None], "int", rules.data_quality(x)) == [
        ("High",), ("Medium",), ("Medium",), ("Low",), ("Low",),
    ]
    got = column(
        spark, [35.1, 35.0, 25.0, 15.0, None], "double", rules.risk_category(x), rules.exceeds(x)
    )
    assert got == [("Critical", 1), ("High", 1), ("Moderate", 1), ("Low", 0), ("Low", 0)]
    got = column(
        spark, [150.5, 55.5, 55.4, 35.4, 12.0], "double",
        rules.aqi_label(x), rules.risk_tier(x), rules.action_tier(x),
    )
    assert got == [
        ("Very Unhealthy", "high", "immediate"),
        ("Unhealthy", "high", "protective"),
        ("Unhealthy (Sensitive)", "medium", "protective"),
        ("Moderate", "medium", "standard"),
        ("Good", "low", "standard"),
    ]


def test_density(spark):
    cases = {
        (10, 0): 0, (100, 5): 100, (None, 3): 10, (5, None): 10, (50_000, 1): 100,
        (100_000, 1): 80, (250_000, 1): 60, (500_000, 1): 40, (1_000_000, 1): 20, (1_000_001, 1): 10,
    }
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "p bigint, n bigint, want int")
    out = df.select(
        "want",
        rules.density_score(F.col("p"), F.col("n")).alias("got"),
        ratios.per_station(F.col("p"), F.col("n")).alias("people"),
    ).collect()
    assert all(r.want == r.got for r in out)
    assert out[0].people is None and out[1].people == 20.0 and out[3].people is None


def test_trend_label(spark):
    df = spark.createDataFrame(
        [(5.0, None), (11.0, 10.0), (11.01, 10.0), (9.0, 10.0), (8.9, 10.0), (10.0, 10.0)],
        "c double, p double",
    )
    got = [r[0] for r in df.select(rules.trend_label(F.col("c"), F.col("p"))).collect()]
    assert got == ["No Data", "Stable", "Worsening", "Stable", "Improving", "Stable"]


def test_calendar(spark):
    days = [date(2024, 2, 29), date(2024, 3, 2), date(2024, 12, 1)]
    d = F.col("x")
    flags = rules.calendar_flags(d)
    got = column(
        spark, days, "date", rules.season(d), *flags.values(), keys.date_key(d),
        *rules.season_flags(F.month(d)).values(),
    )
    assert got[0] == ("Winter", False, False, True, 20240229, 1, 0, 0, 0)
    assert got[1] == ("Spring", True, False, False, 20240302, 0, 1, 0, 0)
    assert got[2] == ("Winter", True, True, False, 20241201, 1, 0, 0, 0)


def test_city_text(spark):
    values = [None, "", "lagos ibadan", "IBADAN LAGOS", "Josephine", "ONITSHA", "Ilorin Abuja"]
    x = F.col("x")
    got = column(
        spark, values, "string", text.extract_city(x), text.extract_city(x, ["Ilorin", "Abuja"], "?")
    )
    assert [g[0] for g in got] == ["Lagos", "Lagos", "Lagos", "Lagos", "Jos", "Onitsha", "Abuja"]
    assert got[-1][1] == "Ilorin" and got[0][1] == "?"


def test_country_rules(spark):
    df = spark.createDataFrame(
        [
            (" nigeria", "x"), ("NGN", "x"), ("NG", "x"), (None, " London "), ("Unknown", "newyork"),
            ("Unknown", "New York"), ("FR", "london"), (None, None),
        ],
        "country string, city string",
    )
    c = F.col("country")
    got = df.select(text.normalise_country(c), text.fill_country(c, F.col("city"))).collect()
    assert [r[0] for r in got] == ["NG", "NG", "NG", None, "Unknown", "Unknown", "FR", None]
    assert [r[1] for r in got][3:] == ["GB", "US", "Unknown", "FR", None]


def test_dates_and_labels(spark):
    x = F.col("x")
    values = ["Unknown", "", "2020-02-30", "2020-02-29", "2020", "2020-3-4"]
    got = column(spark, values, "string", text.parse_date(x), text.strict_iso_date(x))
    assert [g[0] for g in got][:4] == [None, None, None, date(2020, 2, 29)]
    assert [g[1] for g in got] == [None, None, None, date(2020, 2, 29), None, date(2020, 3, 4)]
    labels = ["Beijing", " Delhi , India ", "A, B, C"]
    got = column(spark, labels, "string", text.city_of_label(x), text.country_of_label(x))
    assert got == [("Beijing", "Unknown"), ("Delhi", "India"), ("A", "C")]


def test_list_text(spark):
    rows = [["a", "b"], ["it's"], [None], []]
    got = column(spark, rows, "array<string>", text.list_text(F.col("x")))
    assert [g[0] for g in got] == [str(r) for r in rows]


def test_keys_and_ratios(spark):
    df = spark.createDataFrame([("a", "b", 4.0, 0.0), (None, "b", 4.0, 2.0)], "c string, t string, v double, w double")
    got = df.select(
        keys.location_key(F.col("c"), F.col("t")),
        ratios.recent_ratio(F.col("v"), F.col("w")),
        ratios.gauge_pct(F.col("v") * 100),
    ).collect()
    assert got[0][0] == md5(b"a|b").hexdigest()
    assert got[1][0] is None
    assert got[0][1] is None and got[1][1] == 2.0
    assert got[0][2] == 100.0
