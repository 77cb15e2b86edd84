"""DuckDB statements of the registered queries, over the same tables.

Written from the rules, not from the Spark code: keys by window functions where
Spark uses grouped maxima, pivots by conditional aggregates, and so on.
"""

from __future__ import annotations

from collections.abc import Sequence

from hazeline import schemas as S
from hazeline.functions import rules as R
from hazeline.testbed import adapter as A


def _q(text) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def _ladder(c: str, op: str, rungs: Sequence[tuple], rest) -> str:
    def value(x):
        return _q(x) if isinstance(x, str) else str(x)

    steps = " ".join(f"WHEN {c} {op} {bound} THEN {value(label)}" for bound, label in rungs)
    return f"CASE {steps} ELSE {value(rest)} END"


def _code(nation: str) -> str:
    steps = " ".join(f"WHEN {k} THEN {_q(v)}" for k, v in A.NATION_CODE.items())
    return f"CASE {nation} {steps} ELSE 'X' || CAST({nation} AS VARCHAR) END"


def _list(values: Sequence[str]) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _extract(c: str, cities: Sequence[str] = tuple(S.FOCUS_CITIES)) -> str:
    steps = " ".join(f"WHEN contains(lower({c}), {_q(x.lower())}) THEN {_q(x)}" for x in cities)
    return f"CASE {steps} ELSE {_q(S.DEFAULT_CITY)} END"


def _alias(c: str) -> str:
    return f"CASE WHEN upper(trim({c})) IN ('NIGERIA', 'NGN') THEN 'NG' ELSE {c} END"


def _fill(country: str, city: str) -> str:
    steps = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in S.CITY_COUNTRY.items())
    return (
        f"CASE WHEN {country} IS NULL OR {country} = 'Unknown' "
        f"THEN coalesce(CASE lower(trim({city})) {steps} END, {country}) ELSE {country} END"
    )


def _raw_city(code: str, key: str, name: str) -> str:
    return (
        f"CASE {code} WHEN 'NG' THEN {_list(A.FOCUS_CITY_TEXT)}[{key} % 4 + 1] "
        f"WHEN 'GB' THEN 'London' ELSE {name} END"
    )


V = f"(l_extendedprice * l_extendedprice / {A.VALUE_SCALE})"
SHIP = f"(CAST(l_shipdate AS DATE) + {A.DAYS_AHEAD})"
SPECIE = f"{_list(A.LINE_SPECIE)}[l_linenumber]"
DENSITY = (
    "CASE WHEN n_stations = 0 THEN 0 ELSE "
    + _ladder("population / nullif(n_stations, 0)", "<=", R.DENSITY_RUNGS, R.DENSITY_REST)
    + " END"
)
PER_STATION = "CASE WHEN n_stations > 0 THEN round(population / n_stations, 2) END"
LIMIT = S.DAILY_LIMIT
METRIC_NAMES = [f"{s}_{m}" for s in S.SPECIES for m in S.METRICS]
BEST = ", ".join(f"{c} DESC NULLS LAST" for c in ("count", "max", "min", "median", "variance"))
DATA = ", ".join(S.READING_DATA.names)


def _months(c: str, months: Sequence[int]) -> str:
    return f"{c} IN ({', '.join(map(str, months))})"


def _roll(level: str, month: str, quarter: str, keys: str) -> str:
    return f"""
      SELECT location_key, country, city, year, {month} AS month, {quarter} AS quarter,
        '{level}' AS aggregation_period,
        min(date) AS period_start_date, max(date) AS period_end_date,
        avg(pm25_median) AS pm25_avg_median, min(pm25_min) AS pm25_period_min,
        max(pm25_max) AS pm25_period_max, stddev_samp(pm25_median) AS pm25_std_dev,
        count(*) FILTER (pm25_median > {LIMIT['pm25']}) AS pm25_exceedance_days,
        count(*) AS total_days_measured,
        count(*) FILTER (pm25_median > {LIMIT['pm25']}) * 100.0::DOUBLE / count(*) AS pct,
        avg(pm10_median) AS pm10_avg_median,
        count(*) FILTER (pm10_median > {LIMIT['pm10']}) AS pm10_exceedance_days,
        avg(no2_median) AS no2_avg_median,
        count(*) FILTER (no2_median > {LIMIT['no2']}) AS no2_exceedance_days,
        avg(pm25_count) AS avg_daily_measurements, min(pm25_count) AS min_daily_measurements
      FROM dated WHERE pm25_median IS NOT NULL GROUP BY {keys}"""


# name -> (needs, body)
CTES: dict[str, tuple[list[str], str]] = {
    "lines": (
        [],
        f"SELECT l.*, s_name, s_nationkey, {_code('s_nationkey')} AS code "
        "FROM lineitem l JOIN supplier ON l_suppkey = s_suppkey",
    ),
    "raw": (
        ["lines"],
        f"""SELECT l_orderkey, {SHIP} AS ship,
          CASE WHEN l_discount = 0.1 AND l_returnflag = 'R' THEN 'Unknown'
               ELSE CAST({SHIP} AS VARCHAR) END AS date,
          CASE WHEN code = 'NG' THEN
                 CASE l_returnflag WHEN 'A' THEN 'Nigeria' WHEN 'N' THEN ' ngn ' ELSE 'NG' END
               WHEN code = 'GB' THEN
                 CASE l_returnflag WHEN 'A' THEN 'Unknown' WHEN 'R' THEN 'GB' END
               ELSE code END AS country,
          {_raw_city('code', 'l_suppkey', 's_name')} AS city,
          {SPECIE} AS specie, CAST(l_quantity AS INTEGER) AS count,
          {V} * 0.5::DOUBLE AS min, {V} * 1.5::DOUBLE AS max, {V} AS median,
          l_discount * l_discount * 100.0::DOUBLE AS variance
        FROM lines""",
    ),
    "increment": (
        ["raw"],
        f"""SELECT date, country, city, specie, count + 1 AS count, min * 1.1::DOUBLE AS min,
          max * 1.1::DOUBLE AS max, median * 1.1::DOUBLE AS median, variance,
          CAST(ship AS TIMESTAMP) + to_seconds(l_orderkey % 86400) AS _ingest_ts
        FROM raw WHERE try_cast(date AS DATE) >= DATE '{A.INCREMENT_FROM}'""",
    ),
    "landed": (
        ["raw", "increment"],
        f"SELECT {DATA} FROM raw UNION ALL SELECT {DATA} FROM increment",
    ),
    "aliased": (["landed"], f"SELECT * REPLACE ({_alias('country')} AS country) FROM landed"),
    "citied": (
        ["aliased"],
        f"SELECT * REPLACE (CASE WHEN country = 'NG' THEN {_extract('city')} ELSE city END AS city) "
        "FROM aliased",
    ),
    "named": (
        ["citied"],
        f"SELECT * REPLACE (try_cast(date AS DATE) AS date, {_fill('country', 'city')} AS country) "
        "FROM citied",
    ),
    "gated": (
        ["named"],
        "SELECT * FROM named WHERE date IS NOT NULL AND country IS NOT NULL "
        "AND city IS NOT NULL AND specie IS NOT NULL",
    ),
    "clean": (
        ["gated"],
        "SELECT * FROM gated QUALIFY row_number() OVER "
        f"(PARTITION BY date, country, city, specie ORDER BY {BEST}) = 1",
    ),
    "wide": (
        ["clean"],
        "SELECT date, country, city, "
        + ", ".join(
            f"max({m}) FILTER (specie = {_q(s)}) AS {s}_{m}" for s in S.SPECIES for m in S.METRICS
        )
        + " FROM clean GROUP BY ALL",
    ),
    "place_rows": (
        [],
        f"""SELECT country, CASE WHEN off IS NOT NULL THEN off
            WHEN country = 'NG' THEN {_extract('city')} ELSE city END AS city,
          city_lat, city_lon, population, n_stations
        FROM (SELECT {_code('s_nationkey')} AS country,
          {_raw_city(_code('s_nationkey'), 's_suppkey', 's_name')} AS city,
          CASE WHEN s_acctbal < {A.PLACE_MIN_BALANCE} THEN 'Off map ' || s_name END AS off,
          s_nationkey * 1.5::DOUBLE - 20 AS city_lat, s_nationkey * 3.0::DOUBLE - 30 AS city_lon,
          CAST(floor(s_acctbal * 300) AS BIGINT) AS population,
          CAST(s_suppkey % 7 AS BIGINT) AS n_stations
        FROM supplier)""",
    ),
    "places": (
        ["place_rows"],
        """SELECT country, city, max(city_lat) AS lat, max(city_lon) AS lon,
          CAST(sum(population) AS BIGINT) AS population, CAST(sum(n_stations) AS BIGINT) AS n_stations
        FROM place_rows GROUP BY ALL""",
    ),
    "dim": (
        ["places"],
        f"""SELECT md5(country || '|' || city) AS location_key, *,
          {PER_STATION} AS population_per_station, {DENSITY} AS monitoring_density_score
        FROM places""",
    ),
    "fact": (
        ["wide", "dim"],
        f"""SELECT md5(CAST(date AS VARCHAR) || '|' || country || '|' || city) AS fact_key,
          CAST(strftime(date, '%Y%m%d') AS BIGINT) AS date_key, location_key, date, country, city,
          {', '.join(METRIC_NAMES)},
          {_ladder('pm25_median', '<=', R.AQI_RUNGS, R.AQI_REST)} AS aqi_category,
          {_ladder('pm25_count', '>=', R.QUALITY_RUNGS, R.QUALITY_REST)} AS data_quality
        FROM wide LEFT JOIN dim USING (country, city)""",
    ),
    "days": (
        [],
        f"""SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS date,
          CAST(year(d) AS INTEGER) AS year, CAST(quarter(d) AS INTEGER) AS quarter,
          CAST(month(d) AS INTEGER) AS month, CAST(day(d) AS INTEGER) AS day,
          CAST(dayofweek(d) + 1 AS INTEGER) AS day_of_week, dayname(d) AS day_name,
          monthname(d) AS month_name, CAST(weekofyear(d) AS INTEGER) AS week_of_year,
          CAST(dayofyear(d) AS INTEGER) AS day_of_year,
          CASE {' '.join(f"WHEN {_months('month(d)', ms)} THEN {_q(n.capitalize())}" for n, ms in R.SEASON_MONTHS.items())} END AS season,
          dayofweek(d) IN (0, 6) AS is_weekend, day(d) = 1 AS is_month_start,
          d = last_day(d) AS is_month_end
        FROM (SELECT DATE '{S.SPINE_START}' + CAST(i AS INTEGER) AS d
              FROM range({S.SPINE_LAST_OFFSET + 1}) t(i))""",
    ),
    "dated": (
        ["fact", "days"],
        "SELECT fact.*, year, month, quarter, day_of_week, is_weekend "
        "FROM fact LEFT JOIN days ON fact.date_key = days.date_key",
    ),
    "monthly": (["dated"], _roll("monthly", "month", "quarter", "ALL")),
    "yearly": (
        ["dated"],
        _roll(
            "yearly", "CAST(NULL AS INTEGER)", "CAST(NULL AS INTEGER)",
            "location_key, country, city, year",
        ),
    ),
    "rolled": (
        ["monthly", "yearly"],
        """SELECT *, lag(pm25_avg_median) OVER (PARTITION BY country, city, aggregation_period
            ORDER BY year NULLS FIRST, coalesce(month, 0)) AS prev
        FROM (SELECT * FROM monthly UNION ALL SELECT * FROM yearly)""",
    ),
    "city_stats": (
        ["fact", "dim"],
        f"""SELECT f.country, f.city, population, n_stations, monitoring_density_score,
          avg(pm25_median) AS avg_pm25, avg(pm10_median) AS avg_pm10, avg(no2_median) AS avg_no2,
          count(*) FILTER (pm25_median > {LIMIT['pm25']}) * 100.0::DOUBLE / count(*) AS pct,
          count(*) AS total_days
        FROM fact f JOIN dim ON f.location_key = dim.location_key GROUP BY ALL""",
    ),
    "peers": (
        ["city_stats"],
        f"""SELECT country, count(DISTINCT city) AS n_cities,
          CAST(sum(population) AS BIGINT) AS total_population,
          CAST(sum(n_stations) AS BIGINT) AS total_stations,
          avg(avg_pm25) AS country_avg_pm25, avg(pct) AS country_exceedance_pct,
          sum(avg_pm25 * population) / nullif(sum(population), 0) AS population_weighted_pm25
        FROM city_stats WHERE country IN ({', '.join(map(_q, S.PEER_COUNTRIES))}) GROUP BY country""",
    ),
    "windows": (
        ["dated"],
        """SELECT *,
          avg(pm25_median) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS pm25_7d_avg,
          avg(pm25_median) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS pm25_30d_avg,
          avg(pm25_median) OVER (w ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) AS pm25_90d_avg,
          avg(pm10_median) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS pm10_30d_avg,
          avg(no2_median) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS no2_30d_avg,
          stddev_samp(pm25_median) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS pm25_7d_volatility,
          avg(pm25_median) OVER (w ROWS BETWEEN 30 PRECEDING AND 8 PRECEDING) AS earlier,
          lag(pm25_median, 1) OVER w AS pm25_lag_1d, lag(pm25_median, 7) OVER w AS pm25_lag_7d,
          lag(pm25_median, 14) OVER w AS pm25_lag_14d, lag(pm25_median, 30) OVER w AS pm25_lag_30d,
          min(pm25_median) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS pm25_30d_min,
          max(pm25_median) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS pm25_30d_max,
          avg(pm25_median) OVER (w ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS target
        FROM dated WHERE pm25_median IS NOT NULL
        WINDOW w AS (PARTITION BY country, city ORDER BY date)""",
    ),
    "features": (
        ["windows", "dim"],
        """SELECT w.*, lat, lon, population, n_stations, population_per_station,
          monitoring_density_score, pm25_7d_avg - earlier AS pm25_trend
        FROM windows w LEFT JOIN dim USING (country, city)
        WHERE pm25_7d_avg IS NOT NULL AND pm25_30d_avg IS NOT NULL AND pm25_90d_avg IS NOT NULL
          AND pm25_lag_1d IS NOT NULL AND pm25_lag_7d IS NOT NULL AND pm25_lag_30d IS NOT NULL
          AND target IS NOT NULL""",
    ),
    "place_docs": (
        ["place_rows"],
        "SELECT *, '[''' || country || ''', \"People''s net\"]' AS sources FROM place_rows",
    ),
    "sensor_rows": (
        [],
        f"""SELECT CAST({SHIP} AS VARCHAR) AS date, {SHIP} AS day,
          CASE WHEN s_acctbal >= 0 THEN {_code('s_nationkey')} ELSE 'Nigeria' END AS country,
          s_name AS city, {SPECIE} AS specie,
          CASE WHEN l_returnflag = 'R' THEN 0 ELSE CAST(l_quantity AS INTEGER) END AS count,
          {V} * 0.5::DOUBLE AS min, {V} * 1.5::DOUBLE AS max, {V} AS median,
          l_discount * l_discount AS variance,
          'openaq_sensor_' || CAST(l_suppkey * 10 + l_linenumber AS VARCHAR) AS _source_file
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    ),
    "feed_rows": (
        [],
        f"""SELECT CAST(CAST(o_orderdate AS DATE) + {A.DAYS_AHEAD} AS VARCHAR) AS date,
          CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Unknown' ELSE {_code('c_nationkey')} END AS country,
          c_name AS city, k AS specie, 1 AS count, v AS min, v AS max, v AS median,
          0.0::DOUBLE AS variance, 'aqicn_' || c_name AS _source_file
        FROM (SELECT *, unnest(['pm25', 'no2']) AS k,
                unnest([o_totalprice / 2000, o_totalprice / 1000]) AS v
              FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority <> '5-LOW')""",
    ),
    "station_rows": (
        [],
        f"""SELECT {_code('c_nationkey')} AS country,
          CASE WHEN c_acctbal >= -900 THEN c_mktsegment END AS city,
          CASE WHEN c_acctbal >= 0 THEN c_name END AS station_name,
          c_acctbal / 210 AS station_lat, c_acctbal / 110 AS station_lon FROM customer""",
    ),
    "station_places": (
        ["station_rows"],
        """SELECT country, city, avg(station_lat) AS city_lat, avg(station_lon) AS city_lon,
          count(station_name) AS n_stations FROM station_rows
        WHERE country IS NOT NULL AND city IS NOT NULL GROUP BY ALL""",
    ),
    "gazetteer": (
        [],
        f"""SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'building site'
            ELSE lower(c_mktsegment) END AS city, {_code('c_nationkey')} AS country,
          CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) END AS population,
          CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS feature
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    ),
}


def statement(needs: Sequence[str], select: str) -> str:
    """The select with the common table expressions it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in CTES[name][0]:
            visit(other)
        order.append(name)

    for name in needs:
        visit(name)
    if not order:
        return select
    named = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    select = select.strip()
    if select.startswith("WITH "):
        return f"WITH {named},\n{select.removeprefix('WITH ')}"
    return f"WITH {named}\n{select}"


def rounded(columns: Sequence[str], digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)
