"""Landed JSON payloads to rows.

Payload text is parsed once into a VARIANT and taken apart by one cast to the wanted
shape. Fields with a default stay VARIANT there: a missing key reads NULL and gets
the default, an explicit null does not. Whatever has another shape reads NULL
without harm to its neighbours. Arrays are exploded row by row; nothing is grouped.

Parsed documents are only exploded with the outer form, empties dropped afterwards:
for the inner form, and for a filter on a parsed field, Spark would put a copy of the
expression in front and parse every document again.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.functions.text import (
    city_of_label,
    country_of_label,
    first_word,
    list_text,
    strict_iso_date,
)

# Defaults and audit labels of the two feeds.
SENSOR_DEFAULTS = {"city": "Unknown", "country": "Nigeria", "specie": "unknown"}
SENSOR_FILE_PREFIX, SENSOR_FORMAT = "openaq_sensor_", "api_openaq"
FEED_FILE_PREFIX, FEED_FORMAT = "aqicn_", "api_aqicn"
STATION_SOURCES = "OPENAQ_AQICN"

PLACES_DOC = (
    "array<struct<"
    "Place: struct<country: string, name: string, feature: string, geo: array<double>, pop: bigint>,"
    "Stations: array<struct<Name: string, Latitude: double, Longitude: double>>,"
    "Sources: array<struct<name: string>>>>"
)


# Shapes of the payloads.
LOCATION_PAGE = (
    "struct<results: array<struct<name: variant, country: struct<name: variant>,"
    "sensors: array<struct<id: bigint, parameter: struct<name: variant>>>>>>"
)
DAY_PAGE = (
    "struct<results: array<struct<"
    "summary: struct<count: variant, min: variant, max: variant, median: variant, sd: double>,"
    "period: struct<datetimeFrom: struct<local: variant, utc: string>>>>>"
)
FEED_DOC = (
    "struct<status: string, data: struct<city: struct<name: variant>,"
    "time: struct<s: string>, iaqi: map<string, variant>>>"
)
SEARCH_DOC = (
    "struct<status: string, data: array<struct<station: struct<name: string, geo: array<double>>>>>"
)
COORDINATES_PAGE = (
    "struct<results: array<struct<name: string,"
    "coordinates: struct<latitude: double, longitude: double>>>>"
)


def _shaped(payload: str, shape: str) -> Column:
    return F.try_variant_get(F.try_parse_json(payload), "$", shape)


def _value(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _value_or(v: Column, kind: str, default) -> Column:
    """The default only where the key is missing."""
    return F.when(v.isNull(), F.lit(default)).otherwise(_value(v, kind))


def _entries(df: DataFrame, array: str | Column, *keep: str) -> DataFrame:
    """One row per array entry, as ``_e``."""
    return df.select(*keep, F.explode_outer(array).alias("_e")).filter("_e IS NOT NULL")


def places_documents(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per entry of each places document, still nested."""
    docs = df.select(F.from_json(payload, PLACES_DOC).alias("_doc"))
    return _entries(docs, "_doc").select("_e.*")


def places_from_json(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per place."""
    place = F.col("Place")
    return places_documents(df, payload).select(
        place["country"].alias("country"),
        place["name"].alias("city"),
        place["feature"].alias("feature"),
        F.get(place["geo"], 0).alias("city_lat"),
        F.get(place["geo"], 1).alias("city_lon"),
        place["pop"].alias("population"),
        F.coalesce(F.size("Stations"), F.lit(0)).cast("bigint").alias("n_stations"),
        list_text(
            F.coalesce(F.transform("Sources", lambda s: s["name"]), F.array().cast("array<string>"))
        ).alias("sources"),
    )


def stations_from_json(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per station, with the country and city of its place."""
    nested = places_documents(df, payload).select(
        F.col("Place.country").alias("country"),
        F.col("Place.name").alias("city"),
        F.explode("Stations").alias("_s"),
    )
    return nested.select(
        "country",
        "city",
        F.col("_s.Name").alias("station_name"),
        F.col("_s.Latitude").alias("station_lat"),
        F.col("_s.Longitude").alias("station_lon"),
    )


def sensors_from_locations(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per sensor of each location: sensor_id, city, country, specie. A sensor
    listed again with the same attributes is kept once."""
    page = df.select(_shaped(payload, LOCATION_PAGE).alias("_page"))
    location = _entries(page, "_page.results").select(
        _value_or(F.col("_e.name"), "string", SENSOR_DEFAULTS["city"]).alias("city"),
        _value_or(F.col("_e.country.name"), "string", SENSOR_DEFAULTS["country"]).alias("country"),
        F.explode("_e.sensors").alias("_s"),
    )
    return location.select(
        F.col("_s.id").alias("sensor_id"),
        "city",
        "country",
        _value_or(F.col("_s.parameter.name"), "string", SENSOR_DEFAULTS["specie"]).alias("specie"),
    ).distinct()


def sensor_days(df: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per sensor and day of the landed (sensor_id, payload) rows. Days
    without a readable date are out."""
    page = df.select("sensor_id", _shaped(payload, DAY_PAGE).alias("_page"))
    day = _entries(page, "_page.results", "sensor_id")
    local, utc = F.col("_e.period.datetimeFrom.local"), F.col("_e.period.datetimeFrom.utc")
    stamp = F.when(local.isNull(), utc).otherwise(_value(local, "string"))
    sd = F.col("_e.summary.sd")
    rows = day.select(
        "sensor_id",
        F.split_part(stamp, F.lit("T"), F.lit(1)).alias("date"),
        _value_or(F.col("_e.summary.count"), "int", 0).alias("count"),
        _value_or(F.col("_e.summary.min"), "double", 0.0).alias("min"),
        _value_or(F.col("_e.summary.max"), "double", 0.0).alias("max"),
        _value_or(F.col("_e.summary.median"), "double", 0.0).alias("median"),
        F.coalesce(sd * sd, F.lit(0.0)).alias("variance"),
    )
    return rows.filter(strict_iso_date(F.col("date")).isNotNull())


def readings_from_sensor_days(
    locations: DataFrame, days: DataFrame, ingest_ts: datetime | Column | None = None
) -> DataFrame:
    """Audited readings from landed sensor locations and sensor-day payloads."""
    stamp = _clock(ingest_ts)
    joined = sensor_days(days).join(sensors_from_locations(locations), "sensor_id")
    return joined.select(
        *S.READING_DATA.names,
        stamp.alias("_ingest_ts"),
        F.concat(F.lit(SENSOR_FILE_PREFIX), F.col("sensor_id").cast("string")).alias("_source_file"),
        F.lit(SENSOR_FORMAT).alias("_source_format"),
    )


def readings_from_city_feed(
    df: DataFrame, ingest_ts: datetime | Column | None = None, payload: str = "payload"
) -> DataFrame:
    """Audited readings from landed (feed_name, payload) rows whose status is ok: one
    row per pollutant entry that is an object with a numeric ``v``."""
    stamp = _clock(ingest_ts)
    feed = df.select("feed_name", _shaped(payload, FEED_DOC).alias("_doc"))
    good = F.col("_doc.status") == "ok"
    name, time_text = F.col("_doc.data.city.name"), F.col("_doc.data.time.s")
    entry = feed.select(
        F.when(name.isNull(), F.col("feed_name")).otherwise(_value(name, "string")).alias("_label"),
        F.when(F.coalesce(time_text, F.lit("")) != "", F.split_part(time_text, F.lit(" "), F.lit(1)))
        .otherwise(F.date_format(stamp, "yyyy-MM-dd"))
        .alias("date"),
        "feed_name",
        F.explode_outer(F.when(good, F.col("_doc.data.iaqi"))).alias("specie", "_entry"),
    )
    value = entry.select(
        "date",
        country_of_label(F.col("_label")).alias("country"),
        city_of_label(F.col("_label")).alias("city"),
        "specie",
        "feed_name",
        F.try_variant_get("_entry", "$.v", "double").alias("v"),
    ).filter("v IS NOT NULL")
    return value.select(
        "date",
        "country",
        "city",
        "specie",
        F.lit(1).alias("count"),
        F.col("v").alias("min"),
        F.col("v").alias("max"),
        F.col("v").alias("median"),
        F.lit(0.0).alias("variance"),
        stamp.alias("_ingest_ts"),
        F.concat(F.lit(FEED_FILE_PREFIX), "feed_name").alias("_source_file"),
        F.lit(FEED_FORMAT).alias("_source_format"),
    )


def stations_from_search(
    df: DataFrame, country: str = S.FOCUS_COUNTRY, payload: str = "payload"
) -> DataFrame:
    """Stations from landed search results whose status is ok; the city is the first
    word of the station name."""
    found = df.select(_shaped(payload, SEARCH_DOC).alias("_doc"))
    hits = F.when(F.col("_doc.status") == "ok", F.col("_doc.data"))
    station = _entries(found, hits).select("_e.station.*")
    return station.select(
        F.lit(country).alias("country"),
        first_word(F.col("name")).alias("city"),
        F.col("name").alias("station_name"),
        F.get("geo", 0).alias("station_lat"),
        F.get("geo", 1).alias("station_lon"),
    )


def stations_from_locations(
    df: DataFrame, country: str = S.FOCUS_COUNTRY, payload: str = "payload"
) -> DataFrame:
    """Stations from landed location pages; coordinates may be missing."""
    page = df.select(_shaped(payload, COORDINATES_PAGE).alias("_page"))
    location = _entries(page, "_page.results")
    return location.select(
        F.lit(country).alias("country"),
        F.col("_e.name").alias("station_name"),
        F.col("_e.coordinates.latitude").alias("station_lat"),
        F.col("_e.coordinates.longitude").alias("station_lon"),
    )


def _clock(moment: datetime | Column | None) -> Column:
    if moment is None:
        return F.current_timestamp()
    return moment if isinstance(moment, Column) else F.lit(moment)
