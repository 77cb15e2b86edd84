"""Readings, places and payloads derived from the star-schema test tables.

Every row of the source tables takes part; see FIXTURES.md for the idea. The same
rules are stated for DuckDB in ``oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.functions.text import clean_city, fill_country, normalise_country

# Nation key to country code, line number to species.
NATION_CODE = {
    3: "NG", 8: "IN", 12: "CN", 13: "BR", 15: "ZA", 18: "KE", 19: "US", 20: "GB", 21: "DE", 24: "SG",
}
LINE_SPECIE = ["bc", "co", "no2", "o3", "pm10", "pm25", "so2"]
FOCUS_CITY_TEXT = ["Ikeja, LAGOS state", "Abuja Wuse II", "port harcourt GRA", "Unknown site"]
FOCUS_CITY_NAME = ["Lagos", "Abuja", "Port Harcourt", "Lagos"]
DAYS_AHEAD = 7305
VALUE_SCALE = 36750000.0
INCREMENT_FROM = "2021-06-01"
PLACE_MIN_BALANCE = 1000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def country_code(nation: Column) -> Column:
    pairs = [F.lit(part) for pair in NATION_CODE.items() for part in pair]
    known = F.try_element_at(F.create_map(*pairs), nation)
    return F.coalesce(known, F.concat(F.lit("X"), nation.cast("string")))


def raw_city(
    code: Column, suppkey: Column, name: Column, focus_names: list[str] = FOCUS_CITY_TEXT
) -> Column:
    focus = F.element_at(F.array(*map(F.lit, focus_names)), (suppkey % 4 + 1).cast("int"))
    return F.when(code == "NG", focus).when(code == "GB", F.lit("London")).otherwise(name)


def raw_country(code: Column, flag: Column) -> Column:
    """The focus country and GB are spelled differently by return flag; one spelling of
    GB is missing."""
    spelled = ["NGA", "Nigeria", "NGN", " ngn ", "NGR", "NG", "GBA", "Unknown", "GBR", "GB"]
    spelling = F.try_element_at(F.create_map(*map(F.lit, spelled)), F.concat(code, flag))
    return F.when(code.isin("NG", "GB"), spelling).otherwise(code)


def shifted(day: Column) -> Column:
    return F.date_add(day.cast("date"), DAYS_AHEAD)


def _specie(line: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LINE_SPECIE)), line)


def _value(price: Column) -> Column:
    return price * price / F.lit(VALUE_SCALE)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier: its country code and the city text its readings carry."""
    code = country_code(F.col("s_nationkey"))
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", code.alias("code"), raw_city(code, F.col("s_suppkey"), F.col("s_name")).alias("city")
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(
        sites(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey")
    )


def readings_of_lines(lines: DataFrame, *extra: Column) -> DataFrame:
    v = _value(F.col("l_extendedprice"))
    unreadable = (F.col("l_discount") == 0.1) & (F.col("l_returnflag") == "R")
    return lines.select(
        F.when(unreadable, F.lit("Unknown"))
        .otherwise(shifted(F.col("l_shipdate")).cast("string"))
        .alias("date"),
        raw_country(F.col("code"), F.col("l_returnflag")).alias("country"),
        "city",
        _specie(F.col("l_linenumber")).alias("specie"),
        F.col("l_quantity").cast("int").alias("count"),
        (v * 0.5).alias("min"),
        (v * 1.5).alias("max"),
        v.alias("median"),
        (F.col("l_discount") * F.col("l_discount") * 100.0).alias("variance"),
        *extra,
    )


def readings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_of_lines(_lines(spark, sf_dir))


def readings_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later load that overlaps the first: one more sample and ten percent higher
    values from ``INCREMENT_FROM`` on, with audit columns."""
    second = F.unix_date(shifted(F.col("l_shipdate"))) * 86400 + F.col("l_orderkey") % 86400
    rows = readings_of_lines(
        _lines(spark, sf_dir), F.timestamp_seconds(second).alias("_ingest_ts")
    )
    recent = rows.filter(F.col("date").try_cast("date") >= F.lit(INCREMENT_FROM).cast("date"))
    return recent.select(
        "date",
        "country",
        "city",
        "specie",
        (F.col("count") + 1).alias("count"),
        *[(F.col(c) * 1.1).alias(c) for c in ("min", "max", "median")],
        "variance",
        "_ingest_ts",
        F.lit("batch").alias("_source_file"),
        F.lit("synthetic").alias("_source_format"),
    )


def place_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier, under its cleaned country and city: several rows per place.
    Suppliers with a balance below ``PLACE_MIN_BALANCE`` are spelled so that no reading
    matches them, which leaves some readings without a place."""
    sites = table(spark, sf_dir, "supplier")
    code = country_code(F.col("s_nationkey"))
    city = raw_city(code, F.col("s_suppkey"), F.col("s_name"), FOCUS_CITY_NAME)
    listed = F.col("s_acctbal") >= PLACE_MIN_BALANCE
    city = F.when(listed, city).otherwise(F.concat(F.lit("Off map "), F.col("s_name")))
    return sites.select(
        code.alias("country"),
        city.alias("city"),
        (F.col("s_nationkey") * 1.5 - 20).alias("city_lat"),
        (F.col("s_nationkey") * 3.0 - 30).alias("city_lon"),
        F.floor(F.col("s_acctbal") * 300).cast("bigint").alias("population"),
        (F.col("s_suppkey") % 7).cast("bigint").alias("n_stations"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_rows(spark, sf_dir).groupBy("country", "city").agg(
        F.max("city_lat").alias("city_lat"),
        F.max("city_lon").alias("city_lon"),
        F.sum("population").alias("population"),
        F.sum("n_stations").alias("n_stations"),
    )


def standard_names(df: DataFrame) -> DataFrame:
    """Clean country and city of raw readings, nothing else."""
    country, city = F.col("country"), F.col("city")
    return (
        df.withColumn("country", normalise_country(country))
        .withColumn("city", clean_city(country, city))
        .withColumn("country", fill_country(country, city))
    )


def places_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per place row, with as many stations as the place has, named after
    it, and the supplier's market as source. A place without stations lacks the key."""
    rows = place_rows(spark, sf_dir)
    stations = F.transform(
        F.sequence(F.lit(1), F.col("n_stations").cast("int")),
        lambda i: F.struct(
            F.concat("city", F.lit(" station "), i.cast("string")).alias("Name"),
            (F.col("city_lat") + i * 0.25).alias("Latitude"),
            (F.col("city_lon") - i * 0.25).alias("Longitude"),
        ),
    )
    entry = F.struct(
        F.struct(
            "country",
            F.col("city").alias("name"),
            F.lit("PPL").alias("feature"),
            F.array("city_lat", "city_lon").alias("geo"),
            F.col("population").alias("pop"),
        ).alias("Place"),
        F.when(F.col("n_stations") > 0, stations).alias("Stations"),
        F.array(
            F.struct(F.col("country").alias("name")), F.struct(F.lit("People's net").alias("name"))
        ).alias("Sources"),
    )
    return rows.select(F.to_json(F.array(entry)).alias("payload"))


def sensor_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One location page per supplier: seven sensors, one per species. Suppliers with a
    negative balance lack a country, those with at least 9000 lack coordinates."""
    rich = F.col("s_acctbal") >= 9000
    sensors = F.transform(
        F.sequence(F.lit(1), F.lit(len(LINE_SPECIE))),
        lambda i: F.struct(
            (F.col("s_suppkey") * 10 + i).alias("id"),
            F.struct(_specie(i).alias("name")).alias("parameter"),
        ),
    )
    location = F.struct(
        F.col("s_name").alias("name"),
        F.when(
            F.col("s_acctbal") >= 0, F.struct(country_code(F.col("s_nationkey")).alias("name"))
        ).alias("country"),
        F.when(
            ~rich,
            F.struct(
                (F.col("s_nationkey") * 1.5).alias("latitude"),
                (F.col("s_nationkey") * 3.0).alias("longitude"),
            ),
        ).alias("coordinates"),
        sensors.alias("sensors"),
    )
    return table(spark, sf_dir, "supplier").select(
        F.to_json(F.struct(F.array(location).alias("results"))).alias("payload")
    )


def sensor_day_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One day payload per line: local time for flag O, UTC otherwise; the standard
    deviation is missing when the discount is zero, the count for returned lines."""
    day = F.concat(shifted(F.col("l_shipdate")).cast("string"), F.lit("T00:00:00"))
    v = _value(F.col("l_extendedprice"))
    entry = F.struct(
        F.struct(
            F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("int")).alias("count"),
            (v * 0.5).alias("min"),
            (v * 1.5).alias("max"),
            v.alias("median"),
            F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("sd"),
        ).alias("summary"),
        F.struct(
            F.struct(
                F.when(F.col("l_linestatus") == "O", F.concat(day, F.lit("+01:00"))).alias("local"),
                F.concat(day, F.lit("Z")).alias("utc"),
            ).alias("datetimeFrom")
        ).alias("period"),
    )
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("sensor_id"),
        F.to_json(F.struct(F.array(entry).alias("results"))).alias("payload"),
    )


def city_feed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed per order: the customer as city, labelled with its nation except in one
    market segment; two readings, one entry that is no object and one without value;
    failed status for cancelled-priority orders."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey)
    label = F.when(F.col("c_mktsegment") == "MACHINERY", F.col("c_name")).otherwise(
        F.concat("c_name", F.lit(", Region, "), country_code(F.col("c_nationkey")))
    )
    entries = F.struct(
        F.struct((F.col("o_totalprice") / 2000).alias("v")).alias("pm25"),
        F.struct((F.col("o_totalprice") / 1000).alias("v")).alias("no2"),
        F.lit(5).alias("w"),
        F.struct(F.lit("none").alias("note")).alias("t"),
    )
    doc = F.struct(
        F.when(F.col("o_orderpriority") == "5-LOW", "error").otherwise("ok").alias("status"),
        F.struct(
            F.struct(label.alias("name")).alias("city"),
            F.struct(
                F.concat(shifted(F.col("o_orderdate")).cast("string"), F.lit(" 12:00:00")).alias("s")
            ).alias("time"),
            entries.alias("iaqi"),
        ).alias("data"),
    )
    return rows.select(F.col("c_name").alias("feed_name"), F.to_json(doc).alias("payload"))


def station_search_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search result per customer."""
    name = F.concat("c_mktsegment", F.lit(" station of "), "c_name")
    hit = F.struct(
        F.struct(
            name.alias("name"),
            F.array(F.col("c_nationkey") * 1.5, F.col("c_nationkey") * 3.0).alias("geo"),
        ).alias("station")
    )
    doc = F.struct(
        F.when(F.col("c_acctbal") < 0, "error").otherwise("ok").alias("status"),
        F.array(hit).alias("data"),
    )
    return table(spark, sf_dir, "customer").select(F.to_json(doc).alias("payload"))


def station_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One station per customer; some lack a city, some a name."""
    return table(spark, sf_dir, "customer").select(
        country_code(F.col("c_nationkey")).alias("country"),
        F.when(F.col("c_acctbal") >= -900, F.col("c_mktsegment")).alias("city"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("station_name"),
        (F.col("c_acctbal") / 210).alias("station_lat"),
        (F.col("c_acctbal") / 110).alias("station_lon"),
    )


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per order under the customer's country, the city being the market
    segment in lower case; one segment is spelled differently, fields may be missing."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey)
    site = F.when(F.col("c_mktsegment") == "BUILDING", "building site")
    return rows.select(
        F.coalesce(site, F.lower("c_mktsegment")).alias("city"),
        country_code(F.col("c_nationkey")).alias("country"),
        F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice").cast("bigint")).alias(
            "population"
        ),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("feature"),
    )
