"""Registered queries: each with its Spark form and, where SQL can say it, its
DuckDB form. Every query reads the test tables whole. Clock columns are left out,
and computed doubles are rounded, since engines add up in different orders."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.functions import rules as R
from hazeline.functions import text
from hazeline.functions.keys import location_key
from hazeline.functions.ratios import per_station
from hazeline.operators import aggregates, dedup, incremental, joins, pivot, quality, series, sets
from hazeline.plans import (
    bronze,
    compare,
    dims,
    facts,
    features,
    layers,
    model,
    places,
    reports,
    silver,
)
from hazeline.session import scratch_path
from hazeline.sources import files, payloads, sinks
from hazeline.streaming import ingest
from hazeline.testbed import adapter as A
from hazeline.testbed import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AS_OF = datetime(2021, 10, 20, 12, 0, 0)
DATA = S.READING_DATA.names
D = 4  # digits kept of computed doubles


def register(name: str, needs: Sequence[str] = (), sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = O.statement(needs, sql)
        return fn

    return add


def rounded(df: DataFrame, columns: Sequence[str], digits: int = D) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---------------------------------------------------------------- inputs


def landed(spark, d):
    return sets.union_sources(
        A.readings_raw(spark, d), silver.drop_audit(A.readings_increment(spark, d))
    )


def standard(spark, d):
    return silver.standardised(A.readings_raw(spark, d), A.readings_increment(spark, d))


def clean(spark, d):
    return silver.readings_clean(A.readings_raw(spark, d), A.readings_increment(spark, d))


def locations(spark, d):
    return dims.dim_locations(A.places(spark, d))


def fact(spark, d):
    return facts.fact_daily_from_readings(standard(spark, d), locations(spark, d))


def metric_fact(spark, d):
    """Fact for queries that only use days with a PM2.5 value: days that have none of
    the three species read are not built."""
    return facts.fact_daily_from_readings(
        standard(spark, d), locations(spark, d), ["pm25", "pm10", "no2"], known_only=True
    )


def feature_rows(spark, d):
    return features.ml_features(metric_fact(spark, d), locations(spark, d), dims.dim_dates(spark))


# ---------------------------------------------------------------- bronze and silver


@register("readings_raw", ["raw"], f"SELECT {', '.join(DATA)} FROM raw")
def readings_raw(spark, d):
    return A.readings_raw(spark, d)


@register(
    "bronze_readings",
    ["raw"],
    " UNION ALL ".join(
        f"SELECT {', '.join(DATA)}, '{kind}' AS _source_format FROM raw" for kind in ("parquet", "csv")
    ),
)
def bronze_readings(spark, d):
    """Readings landed as Parquet and as CSV, in two other column orders, and read back."""
    rows, folder = A.readings_raw(spark, d).select(*DATA), scratch_path(spark, "landing")
    rows.select(*reversed(DATA)).write.parquet(f"{folder}/parquet")
    sinks.write_csv(rows.select(*DATA[3:], *DATA[:3]), f"{folder}/csv")
    both = bronze.bronze_readings(spark, f"{folder}/parquet", f"{folder}/csv")
    return both.select(*DATA, "_source_format")


@register("union_sources", ["landed"], "SELECT * FROM landed")
def union_sources(spark, d):
    return landed(spark, d)


@register(
    "profile_readings",
    ["landed"],
    """SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date,
       count(DISTINCT specie) AS n_species, count(DISTINCT city) AS n_cities FROM landed""",
)
def profile_readings(spark, d):
    return aggregates.profile_readings(landed(spark, d))


@register(
    "profile_columns",
    ["raw"],
    " UNION ALL ".join(
        f"SELECT '{f.name}' AS column_name, '{f.dataType.simpleString()}' AS column_type, "
        f"count({f.name}) AS n_present, count(*) AS n_rows FROM raw"
        for f in S.READING_DATA.fields
    ),
)
def profile_columns(spark, d):
    return aggregates.profile_columns(A.readings_raw(spark, d))


@register(
    "distinct_species",
    ["landed"],
    "SELECT DISTINCT specie FROM landed",
)
def distinct_species(spark, d):
    return aggregates.distinct_rows(landed(spark, d), ["specie"])


@register(
    "clean_country",
    ["landed"],
    f"SELECT country AS raw, {O._alias('country')} AS country, count(*) AS n "
    "FROM landed GROUP BY ALL",
)
def clean_country(spark, d):
    out = landed(spark, d).select(
        F.col("country").alias("raw"), text.normalise_country(F.col("country")).alias("country")
    )
    return out.groupBy("raw", "country").agg(F.count("*").alias("n"))


@register(
    "clean_city",
    ["aliased"],
    f"""SELECT country, city AS raw,
        CASE WHEN country = 'NG' THEN {O._extract('city')} ELSE city END AS city, count(*) AS n
        FROM aliased GROUP BY ALL""",
)
def clean_city(spark, d):
    named = landed(spark, d).withColumn("country", text.normalise_country(F.col("country")))
    out = named.select(
        "country",
        F.col("city").alias("raw"),
        text.clean_city(F.col("country"), F.col("city")).alias("city"),
    )
    return out.groupBy("country", "raw", "city").agg(F.count("*").alias("n"))


@register(
    "fill_country",
    ["citied"],
    f"SELECT country AS raw, city, {O._fill('country', 'city')} AS country, count(*) AS n "
    "FROM citied GROUP BY ALL",
)
def fill_country(spark, d):
    c, city = F.col("country"), F.col("city")
    named = (
        landed(spark, d)
        .withColumn("country", text.normalise_country(c))
        .withColumn("city", text.clean_city(c, city))
    )
    out = named.select(c.alias("raw"), "city", text.fill_country(c, city).alias("country"))
    return out.groupBy("raw", "city", "country").agg(F.count("*").alias("n"))


@register(
    "fill_country_join",
    ["landed"],
    f"""SELECT date, city, specie, count, min, max, median, variance,
        CASE WHEN country IS NULL OR country = 'Unknown'
             THEN coalesce(m.code, country) ELSE country END AS country
        FROM landed LEFT JOIN (SELECT lower(trim(s_name)) AS k, min({O._code('s_nationkey')}) AS code
          FROM supplier GROUP BY 1 UNION ALL SELECT 'london', 'GB') m ON lower(trim(city)) = m.k""",
)
def fill_country_join(spark, d):
    named = A.table(spark, d, "supplier").select(
        F.col("s_name").alias("city"), A.country_code(F.col("s_nationkey")).alias("code")
    )
    mapping = named.groupBy("city").agg(F.min("code").alias("code"))
    extra = spark.createDataFrame([("london", "GB")], "city string, code string")
    return joins.fill_country_join(landed(spark, d), mapping.union(extra))


@register(
    "parse_date",
    ["landed"],
    """SELECT date AS raw, try_cast(date AS DATE) AS date, count(*) AS n
       FROM landed GROUP BY ALL""",
)
def parse_date(spark, d):
    out = landed(spark, d).select(
        F.col("date").alias("raw"), text.parse_date(F.col("date")).alias("date")
    )
    return out.groupBy("raw", "date").agg(F.count("*").alias("n"))


@register(
    "dedup_best_reading",
    ["landed"],
    f"""SELECT * FROM landed QUALIFY row_number() OVER
        (PARTITION BY date, country, city, specie ORDER BY {O.BEST}) = 1""",
)
def dedup_best_reading(spark, d):
    return dedup.dedup_best(landed(spark, d))


@register("readings_clean", ["clean"], f"SELECT {', '.join(DATA)} FROM clean")
def readings_clean(spark, d):
    return clean(spark, d).drop("_processed_ts")


@register("pivot_daily", ["wide"], "SELECT * FROM wide")
def pivot_daily(spark, d):
    return pivot.pivot_daily(clean(spark, d))


@register("pivot_best", ["wide"], "SELECT * FROM wide")
def pivot_best(spark, d):
    return pivot.pivot_best(standard(spark, d))


# ---------------------------------------------------------------- gold: fact and dims


@register("fact_daily", ["fact"], "SELECT * FROM fact")
def fact_daily(spark, d):
    return fact(spark, d).drop("created_at")


@register(
    "aqi_category",
    ["fact"],
    """SELECT aqi_category, pm25_median IS NULL AS missing, count(*) AS n_days
       FROM fact GROUP BY ALL""",
)
def aqi_category(spark, d):
    days = fact(spark, d)
    return days.groupBy("aqi_category", F.isnull("pm25_median").alias("missing")).agg(
        F.count("*").alias("n_days")
    )


@register(
    "data_quality",
    ["fact"],
    """SELECT data_quality, min(pm25_count) AS lowest, max(pm25_count) AS highest,
       count(*) AS n_days FROM fact GROUP BY ALL""",
)
def data_quality(spark, d):
    return fact(spark, d).groupBy("data_quality").agg(
        F.min("pm25_count").alias("lowest"),
        F.max("pm25_count").alias("highest"),
        F.count("*").alias("n_days"),
    )


AGG_DOUBLES = [
    "pm25_avg_median", "pm25_period_min", "pm25_period_max", "pm25_std_dev",
    "pm10_avg_median", "no2_avg_median", "avg_daily_measurements", "pm25_prev_period",
]
AGG_EXACT = [
    "location_key", "country", "city", "year", "month", "quarter", "aggregation_period",
    "period_start_date", "period_end_date", "pm25_exceedance_days", "total_days_measured",
    "pm10_exceedance_days", "no2_exceedance_days", "min_daily_measurements",
]


@register(
    "fact_aggregated",
    ["rolled"],
    f"""SELECT {', '.join(AGG_EXACT)}, round(pct, 2) AS pm25_exceedance_pct,
      {O.rounded(AGG_DOUBLES[:-1])}, round(prev, {D}) AS pm25_prev_period,
      CASE WHEN prev IS NULL THEN 'No Data'
           WHEN pm25_avg_median > prev * {R.WORSENING_FACTOR}::DOUBLE THEN 'Worsening'
           WHEN pm25_avg_median < prev * {R.IMPROVING_FACTOR}::DOUBLE THEN 'Improving'
           ELSE 'Stable' END AS trend_indicator
      FROM rolled""",
)
def fact_aggregated(spark, d):
    out = facts.fact_aggregated(metric_fact(spark, d), dims.dim_dates(spark))
    return rounded(out.drop("created_at"), AGG_DOUBLES)


@register(
    "monthly_rollup",
    ["monthly"],
    "SELECT country, city, year, month, total_days_measured, pm25_exceedance_days, "
    f"{O.rounded(['pm25_avg_median', 'pm25_std_dev'])} FROM monthly",
)
def monthly_rollup(spark, d):
    days = joins.join_dates(
        facts.require_metric(metric_fact(spark, d)), dims.dim_dates(spark), ["year", "month", "quarter"]
    )
    out = facts.monthly_rollup(days).select(
        "country", "city", "year", "month", "total_days_measured", "pm25_exceedance_days",
        "pm25_avg_median", "pm25_std_dev",
    )
    return rounded(out, ["pm25_avg_median", "pm25_std_dev"])


@register(
    "yearly_rollup",
    ["yearly"],
    "SELECT country, city, year, total_days_measured, pm25_exceedance_days, "
    f"{O.rounded(['pm25_avg_median', 'pm25_std_dev'])} FROM yearly",
)
def yearly_rollup(spark, d):
    days = joins.join_dates(
        facts.require_metric(metric_fact(spark, d)), dims.dim_dates(spark), ["year", "month", "quarter"]
    )
    out = facts.yearly_rollup(days).select(
        "country", "city", "year", "total_days_measured", "pm25_exceedance_days",
        "pm25_avg_median", "pm25_std_dev",
    )
    return rounded(out, ["pm25_avg_median", "pm25_std_dev"])


DIM = [
    "location_key", "country", "city", "lat", "lon", "population", "n_stations",
    "population_per_station", "monitoring_density_score",
]


@register("dim_locations", ["dim"], f"SELECT {', '.join(DIM)} FROM dim")
def dim_locations(spark, d):
    return locations(spark, d).select(*DIM)


@register(
    "distinct_locations",
    ["place_rows"],
    f"""SELECT DISTINCT md5(country || '|' || city) AS location_key, country, city,
        city_lat AS lat, city_lon AS lon, population, n_stations,
        {O.PER_STATION} AS population_per_station, {O.DENSITY} AS monitoring_density_score
        FROM place_rows""",
)
def distinct_locations(spark, d):
    return dims.dim_locations(A.place_rows(spark, d), unique=False).select(*DIM)


@register(
    "unique_locations",
    ["place_rows"],
    f"""SELECT md5(country || '|' || city) AS location_key, country, city, city_lat AS lat,
        city_lon AS lon, population, n_stations, {O.PER_STATION} AS population_per_station,
        {O.DENSITY} AS monitoring_density_score
        FROM place_rows QUALIFY row_number() OVER (PARTITION BY country, city
          ORDER BY n_stations DESC, population DESC, city_lat DESC, city_lon DESC) = 1""",
)
def unique_locations(spark, d):
    return dims.dim_locations(A.place_rows(spark, d)).select(*DIM)


@register(
    "dim_pollutants",
    ["clean"],
    "WITH p AS (SELECT row_number() OVER (ORDER BY s) AS pollutant_key, * FROM (VALUES "
    + ", ".join(
        "(" + ", ".join("NULL" if v is None else O._q(v) if isinstance(v, str) else str(v) for v in row) + ")"
        for row in S.POLLUTANTS
    )
    + ") t(s, daily, annual, impact, about)) "
    """SELECT CAST(pollutant_key AS INTEGER) AS pollutant_key, s AS specie_name,
       CAST(daily AS DOUBLE) AS who_guideline_24h, CAST(annual AS DOUBLE) AS who_guideline_annual,
       impact AS health_impact_category, about AS description, count(c.specie) AS n_readings,
       count(*) FILTER (c.median > daily) AS n_above
       FROM p LEFT JOIN clean c ON c.specie = p.s GROUP BY ALL""",
)
def dim_pollutants(spark, d):
    """The pollutant dimension with the readings that refer to it and how many exceed
    its daily guideline. Readings are counted per species before the join."""
    pollutants = dims.dim_pollutants(spark)
    used = clean(spark, d).groupBy("specie").agg(
        F.count("*").alias("n_readings"),
        *[
            F.count_if((F.col("specie") == name) & (F.col("median") > limit)).alias(f"_{name}")
            for name, limit in S.DAILY_LIMIT.items()
            if limit is not None
        ],
    )
    above = sum((F.col(f"_{n}") for n, v in S.DAILY_LIMIT.items() if v is not None), F.lit(0))
    counts = used.select("specie", "n_readings", above.cast("bigint").alias("n_above"))
    return (
        pollutants.join(counts, F.col("specie_name") == F.col("specie"), "left")
        .drop("specie")
        .fillna(0, ["n_readings", "n_above"])
    )


@register(
    "dim_dates",
    ["clean", "days"],
    """SELECT days.*, coalesce(n_readings, 0) AS n_readings FROM days
       LEFT JOIN (SELECT date, count(*) AS n_readings FROM clean GROUP BY date) USING (date)""",
)
def dim_dates(spark, d):
    """All calendar rows, with how many readings refer to each."""
    used = clean(spark, d).groupBy("date").agg(F.count("*").alias("n_readings"))
    return dims.dim_dates(spark).join(used, "date", "left").fillna(0, ["n_readings"])


@register(
    "density_score",
    ["places"],
    f"""SELECT {O.DENSITY} AS score, count(*) AS n_places,
        CAST(sum(population) AS BIGINT) AS people FROM places GROUP BY ALL""",
)
def density_score(spark, d):
    score = R.density_score(F.col("population"), F.col("n_stations")).alias("score")
    return A.places(spark, d).groupBy(score).agg(
        F.count("*").alias("n_places"), F.sum("population").alias("people")
    )


def _report_sql(source: str, drop: dict, warn: dict) -> str:
    lines = [(n, "drop", p) for n, p in drop.items()] + [(n, "warn", p) for n, p in warn.items()]
    return " UNION ALL ".join(
        f"SELECT 'readings' AS dataset, '{n}' AS rule, '{a}' AS action, "
        f"count(*) FILTER (coalesce({p}, false)) AS passed, "
        f"count(*) FILTER (NOT coalesce({p}, false)) AS failed FROM {source}"
        for n, a, p in lines
    )


@register(
    "quality_report",
    ["named"],
    _report_sql("named", quality.CLEAN_GATES, quality.MEASUREMENT_CHECKS),
)
def quality_report(spark, d):
    named = A.standard_names(landed(spark, d)).withColumn("date", text.parse_date(F.col("date")))
    return quality.quality_report(
        named, "readings", quality.CLEAN_GATES, quality.MEASUREMENT_CHECKS
    )


@register("expect_or_drop", ["gated"], "SELECT * FROM gated")
def expect_or_drop(spark, d):
    named = A.standard_names(landed(spark, d)).withColumn("date", text.parse_date(F.col("date")))
    return quality.expect_or_drop(named, quality.CLEAN_GATES)


def _failures_sql(name: str, predicate: str) -> str:
    return f"count(*) FILTER (WHERE NOT coalesce({predicate}, false)) AS {name}"


@register(
    "gate_counts",
    ["named"],
    "SELECT "
    + ", ".join(
        _failures_sql(n, p)
        for n, p in {
            **quality.CLEAN_GATES,
            "dropped": " AND ".join(quality.CLEAN_GATES.values()),
            **quality.MEASUREMENT_CHECKS,
        }.items()
    )
    + " FROM named",
)
def gate_counts(spark, d):
    """What the gates drop and the checks find, counted while the rows pass by."""
    named = A.standard_names(landed(spark, d)).withColumn("date", text.parse_date(F.col("date")))
    checks, gates = Observation(), Observation()
    seen = quality.expect(named, quality.MEASUREMENT_CHECKS, checks)
    kept = quality.expect_or_drop(seen, quality.CLEAN_GATES, gates)
    kept.write.format("noop").mode("overwrite").save()
    counts = {**gates.get, **checks.get}
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{n} long" for n in counts))


@register(
    "key_uniqueness",
    ["place_rows"],
    """SELECT md5(country || '|' || city) AS location_key, count(*) AS n_rows
       FROM place_rows GROUP BY 1 HAVING count(*) > 1""",
)
def key_uniqueness(spark, d):
    keyed = A.place_rows(spark, d).select(
        location_key(F.col("country"), F.col("city")).alias("location_key")
    )
    return quality.check_unique(keyed, ["location_key"])


@register(
    "people_per_station",
    ["places"],
    f"SELECT country, city, {O.PER_STATION} AS people FROM places",
)
def people_per_station(spark, d):
    people = per_station(F.col("population"), F.col("n_stations")).alias("people")
    return A.places(spark, d).select("country", "city", people)


# ---------------------------------------------------------------- comparison

CITY_DOUBLES = ["avg_pm25", "avg_pm10", "avg_no2", "pm25_exceedance_pct"]


@register(
    "focus_city_stats",
    ["city_stats"],
    f"""SELECT country, city, population, n_stations, monitoring_density_score, total_days,
        {O.rounded(CITY_DOUBLES[:3])}, round(pct, {D}) AS pm25_exceedance_pct
        FROM city_stats WHERE country = 'NG'""",
)
def focus_city_stats(spark, d):
    return rounded(
        compare.focus_city_stats(fact(spark, d), locations(spark, d)), CITY_DOUBLES
    )


PEER_DOUBLES = ["country_avg_pm25", "country_exceedance_pct", "population_weighted_pm25"]


@register(
    "peer_country_stats",
    ["peers"],
    f"SELECT country, n_cities, total_population, total_stations, {O.rounded(PEER_DOUBLES)} FROM peers",
)
def peer_country_stats(spark, d):
    return rounded(
        compare.peer_country_stats(fact(spark, d), locations(spark, d)), PEER_DOUBLES
    )


@register(
    "weighted_mean",
    ["fact", "dim"],
    f"""SELECT fact.country, round(sum(pm25_median * population)
          / nullif(sum(population), 0), {D}) AS weighted_pm25
        FROM fact LEFT JOIN dim ON fact.location_key = dim.location_key GROUP BY ALL""",
)
def weighted_mean(spark, d):
    days = joins.join_location_key(fact(spark, d), locations(spark, d), ["population"])
    out = days.groupBy("country").agg(
        aggregates.weighted_mean("pm25_median", "population").alias("weighted_pm25")
    )
    return rounded(out, ["weighted_pm25"])


@register(
    "benchmark_mean",
    ["peers"],
    f"SELECT round(avg(country_avg_pm25), {D}) AS benchmark_avg_pm25 FROM peers",
)
def benchmark_mean(spark, d):
    countries = compare.peer_country_stats(fact(spark, d), locations(spark, d))
    return rounded(
        compare.benchmark_mean(countries).select("benchmark_avg_pm25"), ["benchmark_avg_pm25"]
    )


VIEW_DOUBLES = CITY_DOUBLES + ["deviation_from_who", "benchmark_avg_pm25", "vs_benchmark"]


@register(
    "focus_vs_peers",
    ["city_stats", "peers"],
    f"""SELECT country, city, population, n_stations, monitoring_density_score,
        {O.rounded(CITY_DOUBLES)}, {S.DAILY_LIMIT['pm25']}::DOUBLE AS who_guideline_24h,
        round(avg_pm25 - {S.DAILY_LIMIT['pm25']}, {D}) AS deviation_from_who,
        round(mean, {D}) AS benchmark_avg_pm25, round(avg_pm25 - mean, {D}) AS vs_benchmark,
        population AS population_at_risk,
        {O._ladder('avg_pm25', '>', R.RISK_RUNGS, R.RISK_REST)} AS risk_category
        FROM (SELECT country, city, population, n_stations, monitoring_density_score, avg_pm25,
                avg_pm10, avg_no2, pct AS pm25_exceedance_pct FROM city_stats WHERE country = 'NG'
              UNION ALL
              SELECT country, 'National Average', total_population, total_stations, NULL,
                population_weighted_pm25, NULL, NULL, country_exceedance_pct FROM peers),
             (SELECT avg(country_avg_pm25) AS mean FROM peers)""",
)
def focus_vs_peers(spark, d):
    return rounded(compare.focus_vs_peers(fact(spark, d), locations(spark, d)), VIEW_DOUBLES)


# ---------------------------------------------------------------- windows


def _days(spark, d):
    return facts.require_metric(metric_fact(spark, d))


PLACE_DAY = ["country", "city", "date"]


@register(
    "rolling_means",
    ["windows"],
    "SELECT country, city, date, "
    + O.rounded(["pm25_7d_avg", "pm25_30d_avg", "pm25_90d_avg", "pm10_30d_avg", "no2_30d_avg"])
    + " FROM windows",
)
def rolling_means(spark, d):
    means = {
        "pm25_7d_avg": series.rolling_mean("pm25_median", 7),
        "pm25_30d_avg": series.rolling_mean("pm25_median", 30),
        "pm25_90d_avg": series.rolling_mean("pm25_median", 90),
        "pm10_30d_avg": series.rolling_mean("pm10_median", 30),
        "no2_30d_avg": series.rolling_mean("no2_median", 30),
    }
    return _days(spark, d).select(
        *PLACE_DAY, *[F.round(c, D).alias(name) for name, c in means.items()]
    )


@register(
    "rolling_volatility",
    ["windows"],
    f"SELECT country, city, date, {O.rounded(['pm25_7d_volatility'])} FROM windows",
)
def rolling_volatility(spark, d):
    return _days(spark, d).select(
        *PLACE_DAY, F.round(series.rolling_std("pm25_median", 7), D).alias("pm25_7d_volatility")
    )


@register(
    "rolling_min_max",
    ["windows"],
    "SELECT country, city, date, pm25_30d_min, pm25_30d_max FROM windows",
)
def rolling_min_max(spark, d):
    return _days(spark, d).select(
        *PLACE_DAY,
        series.rolling_min("pm25_median", 30).alias("pm25_30d_min"),
        series.rolling_max("pm25_median", 30).alias("pm25_30d_max"),
    )


@register(
    "trend_delta",
    ["windows"],
    f"SELECT country, city, date, round(pm25_7d_avg - earlier, {D}) AS pm25_trend FROM windows",
)
def trend_delta(spark, d):
    return _days(spark, d).select(
        *PLACE_DAY, F.round(series.trend_delta("pm25_median"), D).alias("pm25_trend")
    )


@register(
    "lags",
    ["windows"],
    "SELECT country, city, date, pm25_lag_1d, pm25_lag_7d, pm25_lag_14d, pm25_lag_30d FROM windows",
)
def lags(spark, d):
    steps = series.lags("pm25_median", [1, 7, 14, 30], "pm25")
    return _days(spark, d).select(*PLACE_DAY, *[c.alias(name) for name, c in steps.items()])


@register(
    "forward_target",
    ["windows"],
    f"SELECT country, city, date, round(target, {D}) AS {S.TARGET} FROM windows",
)
def forward_target(spark, d):
    return _days(spark, d).select(
        *PLACE_DAY, F.round(series.forward_mean("pm25_median", 30), D).alias(S.TARGET)
    )


@register(
    "calendar_rolling_mean",
    ["dated"],
    f"""SELECT country, city, date, round(avg(pm25_median) OVER (PARTITION BY country, city
          ORDER BY date RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), {D})
          AS pm25_30_days FROM dated WHERE pm25_median IS NOT NULL""",
)
def calendar_rolling_mean(spark, d):
    mean = series.rolling_mean("pm25_median", 30, calendar=True)
    return _days(spark, d).select(*PLACE_DAY, F.round(mean, D).alias("pm25_30_days"))


HISTORY = [
    "pm25_7d_avg", "pm25_30d_avg", "pm25_90d_avg", "pm10_30d_avg", "no2_30d_avg",
    "pm25_7d_volatility", "pm25_trend", "pm25_lag_1d", "pm25_lag_7d", "pm25_lag_14d",
    "pm25_lag_30d", "pm25_30d_min", "pm25_30d_max",
]


@register(
    "ml_features",
    ["features"],
    f"""SELECT country, city, date, year, month, day_of_week, quarter, is_weekend,
      {', '.join(f"CASE WHEN {O._months('month', ms)} THEN 1 ELSE 0 END AS is_{n}" for n, ms in R.SEASON_MONTHS.items())},
      population, n_stations, population_per_station, monitoring_density_score, lat, lon,
      {O.rounded(HISTORY)},
      CASE WHEN pm25_7d_avg > 15 THEN 1 ELSE 0 END AS was_exceeding_who_7d,
      CASE WHEN pm25_30d_avg > 15 THEN 1 ELSE 0 END AS was_exceeding_who_30d,
      round(pm25_lag_1d / nullif(pm25_30d_avg, 0), {D}) AS pm25_recent_ratio,
      round(pm25_30d_max - pm25_30d_min, {D}) AS pm25_30d_range,
      round(target, {D}) AS {S.TARGET},
      CASE WHEN target > 15 THEN 1 ELSE 0 END AS target_will_exceed_who
      FROM features""",
)
def ml_features(spark, d):
    rows = feature_rows(spark, d).drop("created_at")
    return rounded(rows, [*HISTORY, "pm25_recent_ratio", "pm25_30d_range", S.TARGET])


@register(
    "projection_90d",
    ["features"],
    f"""SELECT city, country, round(pm25_30d_avg + pm25_trend * 3, {D}) AS forecast_90d_pm25
        FROM features""",
)
def projection_90d(spark, d):
    return rounded(model.projection_90d(feature_rows(spark, d)), ["forecast_90d_pm25"])


# ---------------------------------------------------------------- nested sources and places


@register(
    "places_from_json",
    ["place_docs"],
    """SELECT country, city, 'PPL' AS feature, city_lat, city_lon, population, n_stations, sources
       FROM place_docs""",
)
def places_from_json(spark, d):
    return payloads.places_from_json(A.places_documents(spark, d))


@register(
    "stations_from_json",
    ["place_rows"],
    """SELECT country, city, city || ' station ' || CAST(i AS VARCHAR) AS station_name,
       city_lat + i * 0.25::DOUBLE AS station_lat, city_lon - i * 0.25::DOUBLE AS station_lon
       FROM (SELECT *, unnest(range(1, n_stations + 1)) AS i FROM place_rows)""",
)
def stations_from_json(spark, d):
    return payloads.stations_from_json(A.places_documents(spark, d))


@register(
    "sensor_days",
    ["sensor_rows"],
    f"SELECT {', '.join(DATA)}, _source_file, 'api_openaq' AS _source_format FROM sensor_rows",
)
def sensor_days(spark, d):
    rows = payloads.readings_from_sensor_days(
        A.sensor_locations(spark, d), A.sensor_day_payloads(spark, d), AS_OF
    )
    return rows.drop("_ingest_ts")


SENSOR_BEST = f"{O.BEST}, country DESC, _source_file DESC"


@register(
    "sensor_incremental",
    ["sensor_rows"],
    f"""SELECT {', '.join(DATA)} FROM sensor_rows
        WHERE CAST(day AS TIMESTAMP) >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAYS
          AND country = 'Nigeria'
        QUALIFY row_number() OVER (PARTITION BY date, city, specie ORDER BY {SENSOR_BEST}) = 1""",
)
def sensor_incremental(spark, d):
    rows = bronze.sensor_incremental(
        A.sensor_locations(spark, d), A.sensor_day_payloads(spark, d), AS_OF
    )
    return silver.drop_audit(rows)


@register(
    "city_feed",
    ["feed_rows"],
    f"SELECT {', '.join(DATA)}, _source_file, 'api_aqicn' AS _source_format FROM feed_rows",
)
def city_feed(spark, d):
    return payloads.readings_from_city_feed(A.city_feed_payloads(spark, d), AS_OF).drop("_ingest_ts")


@register(
    "city_feed_incremental",
    ["feed_rows"],
    f"""SELECT {', '.join(DATA)} FROM feed_rows
        QUALIFY row_number() OVER (PARTITION BY date, city, specie ORDER BY {SENSOR_BEST}) = 1""",
)
def city_feed_incremental(spark, d):
    return silver.drop_audit(bronze.city_feed_incremental(A.city_feed_payloads(spark, d), AS_OF))


@register(
    "station_search",
    [],
    """SELECT 'NG' AS country, c_mktsegment AS city,
       c_mktsegment || ' station of ' || c_name AS station_name,
       c_nationkey * 1.5::DOUBLE AS station_lat, c_nationkey * 3.0::DOUBLE AS station_lon
       FROM customer WHERE c_acctbal >= 0""",
)
def station_search(spark, d):
    return payloads.stations_from_search(A.station_search_payloads(spark, d))


@register(
    "locations_payload",
    [],
    """SELECT 'NG' AS country, s_name AS station_name,
       CASE WHEN s_acctbal < 9000 THEN s_nationkey * 1.5::DOUBLE END AS station_lat,
       CASE WHEN s_acctbal < 9000 THEN s_nationkey * 3.0::DOUBLE END AS station_lon FROM supplier""",
)
def locations_payload(spark, d):
    return payloads.stations_from_locations(A.sensor_locations(spark, d))


@register(
    "station_city",
    [],
    f"""SELECT city, count(*) AS n FROM (SELECT
          {O._extract("c_mktsegment || ' ' || c_name || CASE WHEN c_acctbal > 5000 THEN ' ABUJA' WHEN c_acctbal > 0 THEN ' calabar, Lagos' ELSE '' END", S.STATION_CITIES)} AS city
        FROM customer) GROUP BY ALL""",
)
def station_city(spark, d):
    suffix = (
        F.when(F.col("c_acctbal") > 5000, " ABUJA")
        .when(F.col("c_acctbal") > 0, " calabar, Lagos")
        .otherwise("")
    )
    name = F.concat("c_mktsegment", F.lit(" "), "c_name", suffix)
    city = text.extract_city(name, S.STATION_CITIES).alias("city")
    return A.table(spark, d, "customer").groupBy(city).agg(F.count("*").alias("n"))


@register(
    "stations_to_places",
    ["station_places"],
    f"SELECT country, city, {O.rounded(['city_lat', 'city_lon'])}, n_stations FROM station_places",
)
def stations_to_places(spark, d):
    return rounded(
        aggregates.stations_to_places(A.station_rows(spark, d)), ["city_lat", "city_lon"]
    )


@register(
    "gazetteer_join",
    ["station_places", "gazetteer"],
    f"""SELECT p.country, p.city, {O.rounded(['city_lat', 'city_lon'])}, n_stations,
        CAST(coalesce(g.population, 0) AS BIGINT) AS population,
        CASE WHEN g.city IS NULL THEN 'PPLA' ELSE coalesce(g.feature, 'PPL') END AS feature
        FROM station_places p LEFT JOIN (SELECT * FROM gazetteer QUALIFY row_number() OVER
          (PARTITION BY country, city ORDER BY population DESC NULLS LAST,
           feature DESC NULLS LAST) = 1) g
        ON p.country = g.country AND lower(trim(p.city)) = g.city""",
)
def gazetteer_join(spark, d):
    grouped = aggregates.stations_to_places(A.station_rows(spark, d))
    return rounded(joins.gazetteer_join(grouped, A.gazetteer(spark, d)), ["city_lat", "city_lon"])


PLACES_NEEDS = ["place_docs", "gazetteer"]
PLACES_SQL = f"""
  WITH found AS (
    SELECT 'NG' AS country, c_mktsegment AS city, c_name AS station_name,
      c_nationkey * 1.5::DOUBLE AS lat, c_nationkey * 3.0::DOUBLE AS lon
    FROM customer WHERE c_acctbal >= 0
    UNION ALL
    SELECT 'NG', {O._extract('s_name', S.STATION_CITIES)}, s_name,
      CASE WHEN s_acctbal < 9000 THEN s_nationkey * 1.5::DOUBLE END,
      CASE WHEN s_acctbal < 9000 THEN s_nationkey * 3.0::DOUBLE END FROM supplier),
  grouped AS (SELECT country, city, avg(lat) AS city_lat, avg(lon) AS city_lon,
      count(station_name) AS n_stations FROM found GROUP BY ALL)
  SELECT country, city, 'PPL' AS feature, round(city_lat, {D}) AS city_lat,
    round(city_lon, {D}) AS city_lon, population, n_stations, sources FROM place_docs
  UNION ALL
  SELECT p.country, p.city,
    CASE WHEN g.city IS NULL THEN 'PPLA' ELSE coalesce(g.feature, 'PPL') END,
    round(city_lat, {D}), round(city_lon, {D}), CAST(coalesce(g.population, 0) AS BIGINT),
    n_stations, 'OPENAQ_AQICN'
  FROM grouped p LEFT JOIN (SELECT * FROM gazetteer QUALIFY row_number() OVER
      (PARTITION BY country, city ORDER BY population DESC NULLS LAST, feature DESC NULLS LAST) = 1) g
    ON p.country = g.country AND lower(trim(p.city)) = g.city"""


@register("places", PLACES_NEEDS, PLACES_SQL)
def all_places(spark, d):
    out = places.places(
        A.places_documents(spark, d),
        A.station_search_payloads(spark, d),
        A.sensor_locations(spark, d),
        A.gazetteer(spark, d),
    )
    return rounded(out, ["city_lat", "city_lon"])


@register(
    "stations",
    ["place_rows"],
    f"""SELECT country, city, city || ' station ' || CAST(i AS VARCHAR) AS station_name,
          city_lat + i * 0.25::DOUBLE AS station_lat, city_lon - i * 0.25::DOUBLE AS station_lon
        FROM (SELECT *, unnest(range(1, n_stations + 1)) AS i FROM place_rows)
        UNION ALL
        SELECT 'NG', c_mktsegment, c_mktsegment || ' station of ' || c_name,
          c_nationkey * 1.5::DOUBLE, c_nationkey * 3.0::DOUBLE FROM customer WHERE c_acctbal >= 0
        UNION ALL
        SELECT 'NG', {O._extract('s_name', S.STATION_CITIES)}, s_name,
          CASE WHEN s_acctbal < 9000 THEN s_nationkey * 1.5::DOUBLE END,
          CASE WHEN s_acctbal < 9000 THEN s_nationkey * 3.0::DOUBLE END FROM supplier""",
)
def all_stations(spark, d):
    return places.stations(
        A.places_documents(spark, d),
        A.station_search_payloads(spark, d),
        A.sensor_locations(spark, d),
    )


@register("csv_preamble", ["raw"], f"SELECT {', '.join(DATA)} FROM raw")
def csv_preamble(spark, d):
    """Readings written as CSV files that each open with four lines of prose and a
    header, converted to Parquet and read back."""
    rows = A.readings_raw(spark, d)
    n_files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    head = ["# prose", "# licence", "", "# more, prose", ",".join(DATA)]
    opens = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0  # the first row of a task
    line = F.to_csv(F.struct(*DATA), files.CSV_SPACES)
    lines = rows.repartition(n_files, F.xxhash64(*DATA)).select(
        F.when(opens, F.concat(F.lit("\n".join([*head, ""])), line)).otherwise(line).alias("line")
    )
    landing, out = scratch_path(spark, "preamble"), scratch_path(spark, "preamble-parquet")
    lines.write.option("compression", "none").text(landing)
    files.csv_preamble_to_parquet(spark, f"{landing}/*.txt", out)
    return spark.read.parquet(out).select(*DATA)


# ---------------------------------------------------------------- incremental


@register(
    "dedup_latest",
    ["increment"],
    f"""SELECT {', '.join(DATA)} FROM increment QUALIFY row_number() OVER
        (PARTITION BY date, city, specie
         ORDER BY _ingest_ts DESC, {O.BEST}, country DESC NULLS LAST) = 1""",
)
def dedup_latest(spark, d):
    return silver.drop_audit(dedup.dedup_latest(A.readings_increment(spark, d)))


@register(
    "lookback_14d",
    ["landed"],
    f"""SELECT * FROM landed
        WHERE CAST(try_cast(date AS DATE) AS TIMESTAMP) >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAYS""",
)
def lookback_14d(spark, d):
    return incremental.lookback(landed(spark, d), AS_OF)


def _history(spark, d):
    """What an earlier load would have stored: one reading per key, before autumn."""
    raw = silver.standardised(A.readings_raw(spark, d))
    return dedup.dedup_best(raw.filter(F.col("date") < F.lit("2021-09-01").cast("date")))


HISTORY_SQL = f"""history AS (
  SELECT date, country, city, specie FROM (
    SELECT try_cast(date AS DATE) AS date, {O._fill('country', 'city')} AS country, city, specie
    FROM (SELECT date, country, specie,
            CASE WHEN country = 'NG' THEN {O._extract('city')} ELSE city END AS city
          FROM (SELECT * REPLACE ({O._alias('country')} AS country) FROM raw)))
  WHERE date < DATE '2021-09-01' AND country IS NOT NULL GROUP BY ALL),
fresh AS (
  SELECT * FROM (
    SELECT try_cast(date AS DATE) AS date, {O._fill('country', 'city')} AS country, city, specie,
      count, min, max, median, variance
    FROM (SELECT * REPLACE (CASE WHEN country = 'NG' THEN {O._extract('city')} ELSE city END AS city)
          FROM (SELECT * REPLACE ({O._alias('country')} AS country) FROM increment)))
  WHERE date IS NOT NULL AND country IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY date, country, city, specie ORDER BY {O.BEST}) = 1)"""


def _fresh(spark, d):
    return dedup.dedup_best(silver.standardised(A.readings_increment(spark, d)))


@register(
    "high_watermark",
    ["raw", "increment"],
    f"WITH {HISTORY_SQL} SELECT * FROM fresh WHERE date > (SELECT max(date) FROM history)",
)
def high_watermark(spark, d):
    return incremental.after_high_watermark(_fresh(spark, d), _history(spark, d))


@register(
    "anti_join_new",
    ["raw", "increment"],
    f"""WITH {HISTORY_SQL} SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM history h
        WHERE h.date = f.date AND h.country = f.country AND h.city = f.city
          AND h.specie = f.specie)""",
)
def anti_join_new(spark, d):
    return incremental.only_new(_fresh(spark, d), _history(spark, d))


@register(
    "stream_ingest",
    ["raw"],
    f"""SELECT {', '.join(DATA)} FROM raw WHERE country IS NOT NULL QUALIFY row_number() OVER
        (PARTITION BY date, country, city, specie ORDER BY {O.BEST}) = 1""",
)
def stream_ingest(spark, d):
    """Readings landed twice as files and loaded as they land: first what dates from
    before autumn, then everything, so that the second load meets rows it has already."""
    raw = A.readings_raw(spark, d)
    landing, out, state = (scratch_path(spark, x) for x in ("landing", "stream", "stream-state"))
    for part in (raw.filter(F.col("date") < F.lit("2021-09-01")), raw):
        part.write.mode("append").parquet(landing)
        stream = ingest.landed_stream(spark, landing, raw.schema)
        ingest.load_new(stream, out, state, reduce=dedup.dedup_best).awaitTermination()
    return incremental.read_months(spark, out, raw.schema).drop(incremental.MONTH)


def _named(source: str) -> str:
    """Rows of a source with standard names and dates, and a key."""
    return f"""SELECT * FROM (
      SELECT try_cast(date AS DATE) AS date, {O._fill('country', 'city')} AS country, city, specie,
        count, min, max, median, variance
      FROM (SELECT * REPLACE (CASE WHEN country = 'NG' THEN {O._extract('city')} ELSE city END AS city)
            FROM (SELECT * REPLACE ({O._alias('country')} AS country) FROM {source})))
    WHERE date IS NOT NULL AND country IS NOT NULL"""


def _loads_sql(*loads: str) -> str:
    """What is there after loads in turn: of each key the best row of its first load."""
    rows = " UNION ALL ".join(f"SELECT *, {k} AS load FROM ({q})" for k, q in enumerate(loads, 1))
    return f"""SELECT * FROM ({rows}) QUALIFY row_number() OVER
        (PARTITION BY date, country, city, specie ORDER BY load, {O.BEST}) = 1"""


def _numbered(*loads: DataFrame) -> list[DataFrame]:
    return [df.select(*DATA).withColumn("load", F.lit(k)) for k, df in enumerate(loads, 1)]


@register(
    "incremental_load",
    ["raw", "increment"],
    _loads_sql(_named("raw") + " AND date < DATE '2021-09-01' AND specie <> 'bc'", _named("increment")),
)
def incremental_load(spark, d):
    """Two loads into one folder. The second brings what is newer than the first, what it
    has already, and one species whose days in between arrive late."""
    first = silver.standardised(A.readings_raw(spark, d)).filter("date < DATE '2021-09-01' AND specie <> 'bc'")
    second = silver.standardised(A.readings_increment(spark, d))
    out = scratch_path(spark, "loaded")
    for batch in _numbered(first, second):
        incremental.load_batch(dedup.dedup_best(batch), out)
    return incremental.read_months(spark, out, batch.schema).drop(incremental.MONTH)


@register(
    "stream_state",
    ["raw", "increment"],
    _loads_sql(
        _named("raw") + " AND date < DATE '2021-06-01' AND specie <> 'bc'", _named("increment"), _named("raw")
    ),
)
def stream_state(spark, d):
    """Three landings, with a restart from the checkpoint between them: the past without
    one species, later readings, and at last everything, most of it known, some of it
    years late."""
    raw, increment = (silver.standardised(f(spark, d)) for f in (A.readings_raw, A.readings_increment))
    landing, out, state = (scratch_path(spark, x) for x in ("landing", "stream", "stream-state"))
    for part in _numbered(raw.filter("date < DATE '2021-06-01' AND specie <> 'bc'"), increment, raw):
        part.write.mode("append").parquet(landing)
        stream = ingest.landed_stream(spark, landing, part.schema)
        since = ingest.settled_before(spark, landing, part.schema)
        ingest.load_with_state(stream, out, state, reduce=dedup.dedup_best, since=since).awaitTermination()
    return ingest.loaded(spark, out, part.schema).select(*part.columns)


LAYOUT_FILTERS = {"day": "date = DATE '2021-03-15'", "city": "city = 'Lagos'"}


@register("clustered_layout", ["clean"], f"SELECT {', '.join(DATA)} FROM clean")
def clustered_layout(spark, d):
    """Clean readings written in the clustered layout and read back."""
    out = scratch_path(spark, "clustered")
    sinks.write_clustered(clean(spark, d).select(*DATA), out)
    return spark.read.parquet(out)


@register(
    "layout_pruning",
    ["clean"],
    " UNION ALL ".join(
        f"SELECT {', '.join(DATA)}, '{name}' AS picked_by FROM clean WHERE {condition}"
        for name, condition in LAYOUT_FILTERS.items()
    ),
)
def layout_pruning(spark, d):
    """A day and a city out of clean readings laid out along a curve through the ranges of
    country, city and date."""
    out = scratch_path(spark, "z-ordered")
    sinks.write_z_ordered(clean(spark, d).select(*DATA), out)
    rows = spark.read.parquet(out)
    return sets.union_sources(
        *[rows.filter(condition).withColumn("picked_by", F.lit(name)) for name, condition in LAYOUT_FILTERS.items()]
    )


# ---------------------------------------------------------------- tables and layers


def _profile_sql(step: str, source: str, columns: int) -> str:
    return f"""SELECT '{step}' AS step, specie, count(*) AS n_rows, {columns} AS n_columns,
      CAST(sum(count) AS BIGINT) AS samples FROM {source} GROUP BY specie"""


@register(
    "table_round_trip",
    ["raw", "increment"],
    " UNION ALL ".join(
        [
            _profile_sql("created", "raw", len(DATA)),
            _profile_sql("created again", "raw", len(DATA)),
            _profile_sql("overwritten", "increment", len(DATA) + 1),
            f"SELECT 'emptied', NULL, 0, {len(S.READING.names)}, NULL",
        ]
    ),
)
def table_round_trip(spark, d):
    """Tables in a schema of their own in the session catalog: made from one source, left
    alone by a second attempt, replaced by rows with one more column, and replaced by a
    source without rows. Each state is read by name."""
    schema = f"round_trip_{uuid.uuid4().hex}"
    table = f"{schema}.readings"

    def state(step):
        rows = files.read_table(spark, table)
        by = ["specie"] if step != "emptied" else []
        found = rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.sum("count").alias("samples"))
        specie = F.col("specie") if by else F.lit(None).cast("string")
        counted = found.select(
            F.lit(step).alias("step"), specie.alias("specie"), "n_rows",
            F.lit(len(rows.columns)).alias("n_columns"), "samples",
        )
        return sinks.staged(counted, "state")

    try:
        for _ in range(2):
            sinks.ensure_layers(spark, [schema])
        sinks.create_if_absent(A.readings_raw(spark, d), table)
        states = [state("created")]
        sinks.create_if_absent(A.readings_increment(spark, d).select(*DATA), table)
        states.append(state("created again"))
        sinks.overwrite_table(A.readings_increment(spark, d).select(*DATA, F.lit(2).alias("load")), table)
        states.append(state("overwritten"))
        sinks.overwrite_table(files.empty_readings(spark), table)
        states.append(state("emptied"))
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS `{schema}` CASCADE")
    return sets.union_sources(*states)


#: Layer, dataset, a column to add up, and the query whose statement says its rows.
LAYERS = [
    ("bronze", "readings", "count", "union_sources"),
    ("silver", "readings_clean", "count", "readings_clean"),
    ("gold", "dim_locations", "population", "dim_locations"),
    ("gold", "dim_pollutants", "pollutant_key", "dim_pollutants"),
    ("gold", "dim_dates", "date_key", "dim_dates"),
    ("gold", "fact_daily", "pm25_count", "fact_daily"),
    ("gold", "fact_aggregated", "total_days_measured", "fact_aggregated"),
    ("gold", "focus_vs_peers", "population", "focus_vs_peers"),
    ("gold", "ml_features", "year", "ml_features"),
]


@register(
    "layers_built",
    [],
    " UNION ALL ".join(
        f"""SELECT '{layer}' AS layer, '{dataset}' AS dataset, count(*) AS n_rows,
        CAST(sum({column}) AS BIGINT) AS total,
        {f"(SELECT dropped FROM ({ORACLES['gate_counts']}))" if dataset == "readings_clean" else 0} AS dropped
        FROM ({ORACLES[query]})"""
        for layer, dataset, column, query in LAYERS
    ),
)
def layers_built(spark, d):
    """All layers built as files and published, with what is then in them."""
    root = scratch_path(spark, "layers")
    sources = [A.readings_raw(spark, d), A.readings_increment(spark, d)]
    version = layers.build(spark, root, sources, A.places(spark, d))
    dropped = layers.gate_counts(spark, root).filter((F.col("version") == version) & (F.col("rule") == "dropped"))
    totals = [
        layers.read(spark, root, dataset).agg(F.sum(column).cast("long").alias("total")).withColumn("dataset", F.lit(dataset))
        for _, dataset, column, _ in LAYERS
    ]
    rows = layers.published(spark, root).filter(F.col("version") == version).join(sets.union_sources(*totals), "dataset")
    failed = dropped.select("dataset", F.col("failed").alias("dropped"))
    return rows.join(failed, "dataset", "left").select(
        "layer", "dataset", "n_rows", "total", F.coalesce("dropped", F.lit(0).cast("long")).alias("dropped")
    )


# ---------------------------------------------------------------- model

ERROR = f"{S.TARGET} - pm25_30d_avg"


@register(
    "regression_metrics",
    ["features"],
    f"""SELECT count(*) AS n, round(avg(abs(e)), {D}) AS mae, round(sqrt(avg(e * e)), {D}) AS rmse,
        round(1 - sum(e * e) / (var_pop(target) * count(*)), {D}) AS r2
        FROM (SELECT target, target - pm25_30d_avg AS e FROM features)""",
)
def regression_metrics(spark, d):
    """Persistence forecast: the 30-day mean as prediction of the next 30 days."""
    out = aggregates.regression_metrics(feature_rows(spark, d), S.TARGET, "pm25_30d_avg")
    return rounded(out, ["mae", "rmse", "r2"])


@register(
    "residual_histogram",
    ["features"],
    f"""WITH r AS (SELECT round(target - pm25_30d_avg, 6) AS v FROM features),
        b AS (SELECT min(v) AS lo, max(v) AS hi FROM r),
        c AS (SELECT CAST(least(floor((v - lo) / (hi - lo) * 40), 39) AS INTEGER) AS bin,
                count(*) AS n FROM r, b GROUP BY 1)
        SELECT CAST(i AS INTEGER) AS bin, round(lo + (hi - lo) / 40 * i, {D}) AS bin_start,
          round(lo + (hi - lo) / 40 * (i + 1), {D}) AS bin_end, coalesce(n, 0) AS n
        FROM range(40) t(i) CROSS JOIN b LEFT JOIN c ON c.bin = i WHERE lo IS NOT NULL""",
)
def residual_histogram(spark, d):
    rows = feature_rows(spark, d).select(F.round(F.expr(ERROR), 6).alias("residual"))
    return rounded(aggregates.histogram(rows, "residual"), ["bin_start", "bin_end"])


@register(
    "score_presentation",
    ["features"],
    f"""SELECT country, city, date, round(p, {D}) AS prediction,
        {O._ladder('p', '<=', R.APP_AQI_RUNGS, R.AQI_REST)} AS aqi_label,
        {O._ladder('p', '>', R.RISK_TIER_RUNGS, R.RISK_TIER_REST)} AS risk_tier,
        {O._ladder('p', '>', R.ACTION_TIER_RUNGS, R.ACTION_TIER_REST)} AS action_tier,
        round(p - pm25_30d_avg, {D}) AS delta_vs_30d, round(least(p / 300 * 100, 100), {D}) AS gauge_pct
        FROM (SELECT *, pm25_7d_avg AS p FROM features)""",
)
def score_presentation(spark, d):
    scored = feature_rows(spark, d).select(
        "country", "city", "date", F.col("pm25_7d_avg").alias("prediction"), "pm25_30d_avg"
    )
    shown = model.present(scored).drop("pm25_30d_avg")
    return rounded(shown, ["prediction", "delta_vs_30d", "gauge_pct"])


@register(
    "derived_inputs",
    ["features"],
    f"""SELECT country, city, date, year, month, day_of_week, quarter, is_weekend,
        population_per_station, round(pm25_30d_max - pm25_30d_min, {D}) AS pm25_30d_range
        FROM features""",
)
def derived_inputs(spark, d):
    """Inputs derived for scoring agree with those of training."""
    base = feature_rows(spark, d).select(
        "country", "city", "date", "population", "n_stations", "pm25_30d_min", "pm25_30d_max"
    )
    out = model.derive_inputs(base).select(
        "country", "city", "date", "year", "month", "day_of_week", "quarter", "is_weekend",
        "population_per_station", "pm25_30d_range",
    )
    return rounded(out, ["pm25_30d_range"])


def _draw_sql(seed: int, parts: int = model.DRAWS) -> str:
    key = f"concat_ws('|', '{seed}', country, city, CAST(date AS VARCHAR))"
    return f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT) % {parts}"


HELD_SQL = f"{_draw_sql(model.SEED)} >= 8000"


@register(
    "model_split",
    ["features"],
    f"""SELECT country, city, date, {HELD_SQL} AS held,
        NOT ({HELD_SQL}) AND {_draw_sql(model.SEED + 1)} < 1000 AS ends_boosting FROM features""",
)
def model_split(spark, d):
    """Each feature row with the part it is drawn into."""
    train, held = model.split(feature_rows(spark, d))
    keys = ["country", "city", "date"]
    return sets.union_sources(
        model.marked(train).select(*keys, F.lit(False).alias("held"), F.col(model.VALID).alias("ends_boosting")),
        held.select(*keys, F.lit(True).alias("held"), F.lit(False).alias("ends_boosting")),
    )


@register(
    "model_inputs",
    ["features"],
    "SELECT country, city, date, "
    + ", ".join(
        f"round(coalesce(CAST({c} AS DOUBLE), {model.MISSING}::DOUBLE), {D}) AS {c}, "
        f"CAST({c} IS NULL AS DOUBLE) AS {c}_missing"
        for c in model.MAY_LACK
    )
    + " FROM features WHERE target IS NOT NULL",
)
def model_inputs(spark, d):
    """Inputs as the trees get them: filled, with an indicator for what was missing."""
    rows = model.inputs(feature_rows(spark, d))
    both = [name for c in model.MAY_LACK for name in (c, f"{c}_missing")]
    return rounded(rows.select("country", "city", "date", *both), model.MAY_LACK)


@register(
    "search_folds",
    ["features"],
    f"""SELECT CAST({_draw_sql(model.SEED + 2, 2)} AS INTEGER) AS fold, count(*) AS n_rows,
        round(avg(target), {D}) AS mean_target FROM features WHERE NOT ({HELD_SQL}) GROUP BY 1""",
)
def search_folds(spark, d):
    """The folds that the parameter search fits and compares on."""
    train, _ = model.split(feature_rows(spark, d))
    rows = model.folded(model.require_target(train), 2)
    found = rows.groupBy(F.col(model.FOLD).alias("fold")).agg(
        F.count("*").alias("n_rows"), F.avg(S.TARGET).alias("mean_target")
    )
    return rounded(found, ["mean_target"])


_MODELS: dict[tuple[str, str], str] = {}


def _trained(spark, d) -> tuple[DataFrame, str]:
    """Hold-out rows, and where the model of the training rows is saved. The queries of
    one session share it."""
    train, held = model.split(feature_rows(spark, d).drop("created_at"))
    known = (spark.sparkContext.applicationId, d)
    if known not in _MODELS:
        path = scratch_path(spark, "model")
        model.save_model(model.fit_gbt(train), path)
        _MODELS[known] = path
    return held, _MODELS[known]


@register("gbt_train_score")
def gbt_train_score(spark, d):
    """Hold-out rows with prediction and display columns, and the rounds that were made
    before the held-back rows improved no more."""
    held, path = _trained(spark, d)
    fitted = model.load_model(path)
    shown = model.present(model.predict(fitted, held)).withColumn("rounds", F.lit(model.rounds_made(fitted)))
    return shown.select(
        "country", "city", "date", S.TARGET, "prediction", "aqi_label", "risk_tier",
        "action_tier", "delta_vs_30d", "gauge_pct", "rounds",
    )


@register("feature_importance")
def feature_importance(spark, d):
    return model.importances(model.load_model(_trained(spark, d)[1]), spark)


@register(
    "saved_model_scores",
    ["features"],
    f"""SELECT country, city, date, round(target, {D}) AS actual, true AS same, true AS scored
        FROM features WHERE {HELD_SQL}""",
)
def saved_model_scores(spark, d):
    """Hold-out rows scored by a model as it was fitted and as it is after it was saved and
    loaded, with inputs derived anew from date, place and history."""
    held, path = _trained(spark, d)
    fitted, again = model.load_model(path), scratch_path(spark, "model")
    model.save_model(fitted, again)
    before = model.score(fitted, held).withColumnRenamed("prediction", "before")
    both = model.score(model.load_model(again), before)
    shown = both.select(
        "country", "city", "date", F.col(S.TARGET).alias("actual"),
        (F.col("prediction") == F.col("before")).alias("same"), (F.col("prediction") > 0).alias("scored"),
    )
    return rounded(shown, ["actual"])


# ---------------------------------------------------------------- reports


@register(
    "trend_monthly",
    ["fact"],
    f"""SELECT CAST(date_trunc('month', date) AS DATE) AS period_start,
        round(avg(pm25_median), {D}) AS avg_pm25, round(avg(pm10_median), {D}) AS avg_pm10,
        count(pm25_median) AS n_days FROM fact GROUP BY 1""",
)
def trend_monthly(spark, d):
    return rounded(reports.trend(fact(spark, d)), ["avg_pm25", "avg_pm10"])


@register(
    "focus_trend",
    ["fact", "dim"],
    f"""SELECT f.country, f.city, CAST(date_trunc('month', date) AS DATE) AS period_start,
        round(avg(pm25_median), {D}) AS avg_pm25, round(avg(pm10_median), {D}) AS avg_pm10,
        count(pm25_median) AS n_days, n_stations, monitoring_density_score
        FROM fact f LEFT JOIN dim USING (country, city) WHERE f.country = 'NG' GROUP BY ALL""",
)
def focus_trend(spark, d):
    out = reports.focus_trend(fact(spark, d), locations(spark, d))
    return rounded(out, ["avg_pm25", "avg_pm10"])


@register(
    "exceedance_by_city_year",
    ["yearly"],
    """SELECT country, city, year, pm25_exceedance_days, total_days_measured,
       round(pct, 2) AS pm25_exceedance_pct FROM yearly""",
)
def exceedance_by_city_year(spark, d):
    return reports.exceedance_by_city_year(
        facts.fact_aggregated(metric_fact(spark, d), dims.dim_dates(spark))
    )


@register(
    "seasonality",
    ["fact"],
    f"""SELECT CAST(month(date) AS INTEGER) AS month, round(avg(pm25_median), {D}) AS avg_pm25,
        round(avg(pm10_median), {D}) AS avg_pm10, round(avg(no2_median), {D}) AS avg_no2,
        count(pm25_median) AS n_days FROM fact GROUP BY 1""",
)
def seasonality(spark, d):
    return rounded(reports.seasonality(fact(spark, d)), ["avg_pm25", "avg_pm10", "avg_no2"])


@register(
    "coverage",
    ["fact", "dim"],
    f"""SELECT f.country, f.city, count(*) AS n_days,
        {', '.join(f"round(count(*) FILTER (data_quality = '{q}') * 100.0::DOUBLE / count(*), {D}) AS {q.lower()}_pct" for q in ('High', 'Medium', 'Low'))},
        population, n_stations, population_per_station, monitoring_density_score
        FROM fact f LEFT JOIN dim USING (country, city) GROUP BY ALL""",
)
def coverage(spark, d):
    out = reports.coverage(fact(spark, d), locations(spark, d))
    return rounded(out, ["high_pct", "medium_pct", "low_pct"])


@register(
    "head_preview",
    ["landed"],
    """SELECT * FROM landed ORDER BY median DESC, date, country NULLS FIRST, city, specie, count
       LIMIT 10""",
)
def head_preview(spark, d):
    ordered = landed(spark, d).orderBy(F.desc("median"), "date", "country", "city", "specie", "count")
    return reports.head(ordered, 10)


@register("sort_desc", ["landed"], "SELECT * FROM landed ORDER BY median DESC")
def sort_desc(spark, d):
    return reports.sort_desc(landed(spark, d), "median")
