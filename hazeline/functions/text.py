"""Text clean-up columns. All native expressions: no Python worker is started."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazeline import schemas as S

WHITESPACE = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def parse_date(c: Column) -> Column:
    """Text or timestamp to DATE; anything unreadable becomes NULL for the gate to drop."""
    return c.try_cast("date")


def strict_iso_date(c: Column) -> Column:
    """DATE from year-month-day text only; a bare year or year-month is not a date."""
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), c.try_cast("date"))


def normalise_country(c: Column, aliases: Mapping[str, str] = S.COUNTRY_ALIASES) -> Column:
    """Replace known spellings (upper-case, trimmed) by their code; others pass unchanged."""
    by_code: dict[str, list[str]] = {}
    for spelling, code in aliases.items():
        by_code.setdefault(code, []).append(spelling)
    spelled = F.upper(F.trim(c))
    out = c
    for code, spellings in by_code.items():
        out = F.when(spelled.isin(spellings), F.lit(code)).otherwise(out)
    return out


def extract_city(
    c: Column,
    cities: Sequence[str] = S.FOCUS_CITIES,
    default: str = S.DEFAULT_CITY,
) -> Column:
    """First city of the list, in list order, contained in the text whatever its
    case; the default when none is, or when the text is NULL."""
    folded = F.lower(c)
    hits = [F.when(folded.contains(city.lower()), F.lit(city)) for city in cities]
    return F.coalesce(*hits, F.lit(default))


def clean_city(
    country: Column,
    city: Column,
    focus: str = S.FOCUS_COUNTRY,
    cities: Sequence[str] = S.FOCUS_CITIES,
    default: str = S.DEFAULT_CITY,
) -> Column:
    return F.when(country == focus, extract_city(city, cities, default)).otherwise(city)


def fill_country(
    country: Column, city: Column, city_map: Mapping[str, str] = S.CITY_COUNTRY
) -> Column:
    """Country from the city where it is NULL or unknown; unmatched rows keep what they had.
    For a mapping that is itself a table see ``operators.joins.fill_country_join``."""
    found = F.when(country.isNull() | (country == S.UNKNOWN), country_of_city(city, city_map))
    return F.coalesce(found, country)


def country_of_city(city: Column, city_map: Mapping[str, str] = S.CITY_COUNTRY) -> Column:
    pairs = [F.lit(part) for pair in city_map.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(city)))


def first_word(c: Column) -> Column:
    return F.split_part(c, F.lit(" "), F.lit(1))


def city_of_label(c: Column) -> Column:
    """'City, Region, Country' to its first part."""
    return strip(F.split_part(c, F.lit(","), F.lit(1)))


def country_of_label(c: Column) -> Column:
    """'City, Region, Country' to its last part; unknown when there is no comma."""
    return F.when(c.contains(","), strip(F.split_part(c, F.lit(","), F.lit(-1)))).otherwise(
        F.lit(S.UNKNOWN)
    )


def list_text(names: Column) -> Column:
    """Array of names as bracketed, quoted text: ``['a', 'b']``, a missing name as ``None``."""

    def quoted(x: Column) -> Column:
        single = F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))
        double = F.concat(F.lit('"'), x, F.lit('"'))
        return (
            F.when(x.isNull(), F.lit("None"))
            .when(x.contains("'") & ~x.contains('"'), double)
            .otherwise(single)
        )

    return F.concat(F.lit("["), F.array_join(F.transform(names, quoted), ", "), F.lit("]"))
