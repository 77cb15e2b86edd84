"""Places and stations from landed documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.functions.text import extract_city
from hazeline.operators.aggregates import stations_to_places
from hazeline.operators.joins import gazetteer_join
from hazeline.operators.sets import concat_by_name
from hazeline.sources.payloads import (
    STATION_SOURCES,
    places_from_json,
    stations_from_json,
    stations_from_locations,
    stations_from_search,
)

PLACE_COLUMNS = [
    "country", "city", "feature", "city_lat", "city_lon", "population", "n_stations", "sources",
]
STATION_COLUMNS = ["country", "city", "station_name", "station_lat", "station_lon"]


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns)


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def focus_stations(search: DataFrame, locations: DataFrame) -> DataFrame:
    """Stations of the focus country from both station sources; the second has no city
    of its own, so it is read from the station name."""
    located = stations_from_locations(locations).withColumn(
        "city", extract_city(F.col("station_name"), S.STATION_CITIES)
    )
    return concat_by_name(stations_from_search(search), located).select(*STATION_COLUMNS)


def stations(docs: DataFrame, search: DataFrame, locations: DataFrame) -> DataFrame:
    return concat_by_name(stations_from_json(docs), focus_stations(search, locations))


def places(
    docs: DataFrame, search: DataFrame, locations: DataFrame, gazetteer: DataFrame
) -> DataFrame:
    """Documented places, then those aggregated from focus-country stations."""
    grouped = stations_to_places(focus_stations(search, locations))
    enriched = with_constant(gazetteer_join(grouped, gazetteer), "sources", STATION_SOURCES)
    return concat_by_name(
        project(places_from_json(docs), PLACE_COLUMNS), project(enriched, PLACE_COLUMNS)
    )
