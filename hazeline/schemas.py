"""Schemas and fixed values shared by the whole library.

Everything here is a default: each function that uses one takes it as a
parameter, so another focus country, species list or guideline needs no code.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Reading keys, metrics and audit columns.
READING_KEYS = ["date", "country", "city", "specie"]
METRICS = ["min", "max", "median", "variance", "count"]
AUDIT_COLUMNS = ["_ingest_ts", "_source_file", "_source_format"]

# Columns of a reading, as landed and with audit columns.
READING_DATA = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("specie", T.StringType()),
        T.StructField("count", T.IntegerType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("median", T.DoubleType()),
        T.StructField("variance", T.DoubleType()),
    ]
)

READING = T.StructType(
    READING_DATA.fields
    + [
        T.StructField("_ingest_ts", T.TimestampType()),
        T.StructField("_source_file", T.StringType()),
        T.StructField("_source_format", T.StringType()),
    ]
)

# Pollutant species of the daily fact, in column order.
SPECIES = ["pm25", "pm10", "no2", "o3", "so2", "co", "bc"]

# Pollutant dimension. Columns: specie, 24 h guideline,
# annual guideline, health impact, description.
POLLUTANTS = [
    ("bc", None, None, "High", "Black Carbon – no numeric WHO guideline (good practice only)"),
    ("co", 4.0, None, "Moderate", "Carbon Monoxide – 24-h WHO AQG 4 mg/m³"),
    ("no2", 25.0, 10.0, "High", "Nitrogen Dioxide – 24-h 25 µg/m³, annual 10 µg/m³"),
    ("o3", 100.0, 60.0, "Moderate", "Ozone – 8-h 100 µg/m³, peak season 60 µg/m³"),
    ("pm10", 45.0, 15.0, "High", "Particulate Matter (PM10) – 24-h 45 µg/m³, annual 15 µg/m³"),
    ("pm25", 15.0, 5.0, "Critical", "Fine Particulate Matter (PM2.5) – 24-h 15 µg/m³, annual 5 µg/m³"),
    ("so2", 40.0, None, "Moderate", "Sulfur Dioxide – 24-h WHO AQG 40 µg/m³"),
]

DAILY_LIMIT = {specie: daily for specie, daily, *_ in POLLUTANTS}

# Country spellings, focus country and its peers.
COUNTRY_ALIASES = {"NIGERIA": "NG", "NGN": "NG"}
FOCUS_COUNTRY = "NG"
PEER_COUNTRIES = ["IN", "CN", "BR", "ZA", "KE", "US", "GB", "DE", "SG"]
UNKNOWN = "Unknown"

# City names looked for in free text; the first in the list wins.
FOCUS_CITIES = [
    "Lagos", "Abuja", "Kano", "Ibadan", "Port Harcourt", "Benin City", "Maiduguri", "Zaria",
    "Abeokuta", "Ilorin", "Calabar", "Ogun", "Enugu", "Kaduna", "Jos", "Onitsha",
]
STATION_CITIES = ["Ilorin", "Abuja", "Lagos", "Calabar"]
DEFAULT_CITY = "Lagos"

# Country of cities that arrive without one.
CITY_COUNTRY = {
    "beijing": "CN",
    "london": "GB",
    "newyork": "US",
    "delhi": "IN",
    "tokyo": "JP",
    "paris": "FR",
    "losangeles": "US",
    "shanghai": "CN",
    "mumbai": "IN",
    "sydney": "AU",
}

# Model inputs and target.
FEATURES = [
    "year", "month", "day_of_week", "quarter", "is_weekend",
    "is_winter", "is_spring", "is_summer", "is_fall",
    "population", "n_stations", "population_per_station", "monitoring_density_score",
    "lat", "lon",
    "pm25_7d_avg", "pm25_30d_avg", "pm25_90d_avg", "pm10_30d_avg", "no2_30d_avg",
    "pm25_7d_volatility",
    "pm25_lag_1d", "pm25_lag_7d", "pm25_lag_14d", "pm25_lag_30d",
    "pm25_30d_min", "pm25_30d_max", "pm25_30d_range",
    "pm25_trend", "pm25_recent_ratio",
    "was_exceeding_who_7d", "was_exceeding_who_30d",
]
TARGET = "target_next_30d_pm25_median"

# Calendar spine.
SPINE_START = "2015-01-01"
SPINE_LAST_OFFSET = 5000
