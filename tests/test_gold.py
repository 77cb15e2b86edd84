import hashlib
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.functions.text import parse_date
from hazeline.operators import pivot, quality
from hazeline.plans import compare, dims, facts, features, model, silver
from hazeline.testbed import adapter as A
from hazeline.testbed import registry as R


def plan_of(df):
    df._jdf.queryExecution().toString()
    return df._jdf.queryExecution().executedPlan().toString()


def test_early_gates_equal_late_gates(spark, sf):
    both = R.landed(spark, sf)
    late = quality.expect_or_drop(
        A.standard_names(both).withColumn("date", parse_date(F.col("date"))), quality.CLEAN_GATES
    ).select(*S.READING_DATA.names)
    early = silver.standardised(both).select(*S.READING_DATA.names)
    assert early.exceptAll(late).count() == 0 and late.exceptAll(early).count() == 0


def test_fact_forms_agree(spark, sf):
    dim = R.locations(spark, sf)
    a = facts.fact_daily(R.clean(spark, sf), dim).drop("created_at")
    b = R.fact(spark, sf).drop("created_at")
    assert a.columns == b.columns and len(b.columns) == 43
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def small_fact(spark, rows):
    wide = spark.createDataFrame(rows, "date date, country string, city string, pm25_median double")
    for name in pivot.metric_columns():
        if name != "pm25_median":
            wide = wide.withColumn(name, F.lit(20) if name.endswith("count") else F.lit(1.0))
    return wide


def test_rollup_trend_and_levels(spark):
    rows = [(date(2020, 1, 31), "NG", "a", 10.0), (date(2020, 2, 1), "NG", "a", 20.0), (date(2021, 2, 1), "NG", "a", 16.0)]
    rows += [(date(2014, 1, 1), "NG", "b", 16.0), (date(2020, 1, 1), "NG", "b", None)]
    places = spark.createDataFrame([("NG", "a", 1.0, 1.0, 100, 1)], "country string, city string, city_lat double, city_lon double, population bigint, n_stations bigint")
    dim = dims.dim_locations(places)
    fact = facts._daily(small_fact(spark, rows), dim, S.SPECIES)
    got = facts.fact_aggregated(fact, dims.dim_dates(spark)).collect()
    by = {(r.city, r.aggregation_period, r.year, r.month): r for r in got}
    assert len(got) == 7
    assert by["a", "monthly", 2020, 1].trend_indicator == "No Data"
    assert by["a", "monthly", 2020, 2].trend_indicator == "Worsening"
    assert by["a", "monthly", 2021, 2].trend_indicator == "Improving"
    year = by["a", "yearly", 2020, None]
    assert (year.total_days_measured, year.pm25_exceedance_days, year.pm25_exceedance_pct) == (2, 1, 50.0)
    assert by["a", "yearly", 2021, None].pm25_std_dev is None
    assert by["b", "monthly", None, None].location_key is None and ("b", "yearly", None, None) in by
    again = facts.fact_aggregated(fact, dims.dim_dates(spark), dim)
    assert sorted(r.location_key or "" for r in again.collect()) == sorted(r.location_key or "" for r in got)


def test_non_unique_places(spark):
    rows = [("NG", "a", 1.0, 1.0, 100, 1), ("NG", "a", 1.0, 1.0, 100, 3), (None, "a", 1.0, 1.0, 1, 1)]
    places = spark.createDataFrame(rows, "country string, city string, city_lat double, city_lon double, population bigint, n_stations bigint")
    assert [r.n_stations for r in dims.dim_locations(places).collect()] == [3]
    assert dims.dim_locations(places, unique=False).count() == 2
    assert quality.check_unique(dims.dim_locations(places, unique=False), ["location_key"]).count() == 1


def test_comparison_by_hand(spark):
    day = date(2020, 1, 1)
    rows = [(day, "NG", "a", 40.0), (day, "KE", "x", 10.0), (day, "KE", "y", 30.0), (day, "DE", "z", 10.0)]
    rows += [(day + timedelta(1), "NG", "a", None), (day, "SE", "q", 99.0)]
    place_rows = [("NG", "a", 10, 1), ("KE", "x", 30, 1), ("KE", "y", 10, 1), ("DE", "z", 5, 1), ("SE", "q", 1, 1)]
    places = spark.createDataFrame(
        [(c, t, 0.0, 0.0, p, n) for c, t, p, n in place_rows],
        "country string, city string, city_lat double, city_lon double, population bigint, n_stations bigint",
    )
    dim = dims.dim_locations(places)
    fact = facts._daily(small_fact(spark, rows), dim, S.SPECIES)
    got = {(r.country, r.city): r for r in compare.focus_vs_peers(fact, dim).collect()}
    assert set(got) == {("NG", "a"), ("KE", "National Average"), ("DE", "National Average")}
    focus, kenya = got["NG", "a"], got["KE", "National Average"]
    assert (focus.pm25_exceedance_pct, focus.benchmark_avg_pm25, focus.vs_benchmark) == (50.0, 15.0, 25.0)
    assert (focus.risk_category, focus.deviation_from_who) == ("Critical", 25.0)
    assert (kenya.avg_pm25, kenya.population, kenya.monitoring_density_score) == (15.0, 40, None)
    assert kenya.risk_category == "Low" and kenya.avg_no2 is None


def test_plans(spark, sf):
    fact = R.metric_fact(spark, sf)
    history = plan_of(features.history(fact))
    assert history.count("+- Window ") == 1
    for name in ("ml_features", "fact_aggregated", "focus_vs_peers", "anti_join_new", "fact_daily"):
        text = plan_of(R.QUERIES[name](spark, sf))
        for bad in ("BatchEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in text, (name, bad)
    rollup = plan_of(R.QUERIES["readings_clean"](spark, sf))
    assert rollup.count("Exchange hashpartitioning(date") == 1 and "partial_max" in rollup


def test_model(spark, sf, tmp_path):
    rows = R.feature_rows(spark, sf).drop("created_at").checkpoint()
    assert set(S.FEATURES) <= set(rows.columns) and len(S.FEATURES) == 32
    train, held = model.split(rows)
    assert train.count() + held.count() == rows.count() and held.count() > 0
    again = model.split(rows.repartition(7))[1]
    assert held.select("country", "city", "date").exceptAll(again.select("country", "city", "date")).count() == 0
    before, after = model.split(rows, "date", cut_date="2020-01-01")
    assert before.filter("date >= '2020-01-01'").count() == 0 and after.count() > 0
    fitted = model.fit_gbt(train, rounds=2)
    model.save_model(fitted, str(tmp_path / "m"))
    scored = model.present(model.score(model.load_model(str(tmp_path / "m")), held))
    first = scored.orderBy("country", "city", "date").first()
    assert first.delta_vs_30d == pytest.approx(first.prediction - first.pm25_30d_avg)
    metrics = model.evaluate(scored).first()
    assert metrics.n == held.count() and metrics.rmse >= metrics.mae > 0
    weights = model.importances(fitted, spark).collect()
    assert len(weights) == 32 + len(model.MAY_LACK) and sum(w.importance for w in weights) == pytest.approx(1.0)
    assert weights[0].importance >= weights[-1].importance
    assert model.projection_90d(rows).count() == rows.count()
    assert model.draw_params(3) == model.draw_params(3)
    assert set(model.to_float(rows, ["year"]).select("year").dtypes[0]) == {"year", "double"}
    assert model.rounds_made(fitted) <= 2
    drawn = {(r.country, r.city, r.date): r.n for r in rows.select("country", "city", "date", model.key_draw(42).alias("n")).collect()}
    for (country, city, day), n in drawn.items():
        assert n == int(hashlib.md5(f"42|{country}|{city}|{day}".encode()).hexdigest()[:8], 16) % 10_000


def test_boosting_ends_when_rounds_gain_too_little():
    keep = lambda errors: model.rounds_to_keep(errors, 3, 0.05)
    assert keep([9, 8, 7]) is None and keep([]) is None  # no more rounds than patience
    assert keep([100, 90, 80, 70, 60]) is None
    assert keep([100, 50, 49, 51, 50]) == 3  # the best error, not the last
    assert keep([100, 50, 49.9, 49.8, 49.7]) == 5
    assert keep([100, 50, 60, 70, 80]) == 2


def test_rounds_are_chosen_on_held_back_rows(spark, monkeypatch):
    """Noise that no input explains: boosting ends early, and keeps the best rounds."""
    rows = spark.range(600).select(
        F.lit("NG").alias("country"), F.lit("a").alias("city"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        (F.pmod(F.xxhash64("id"), F.lit(97))).cast("double").alias("x"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100))).cast("double").alias("y"),
    )
    monkeypatch.setattr(model, "FIRST_ROUNDS", 6)
    fitted = model.fit_gbt(rows, ["x"], "y", rounds=50, patience=4, maxDepth=3)
    assert 1 <= model.rounds_made(fitted) <= 6
    alone = model.fit_gbt(rows.filter(model.key_draw(model.SEED + 1) >= 1000), ["x"], "y", rounds=3, maxDepth=2)
    assert model.rounds_made(alone) == 3  # no held-back rows to watch


def test_rounds_to_keep_are_not_fitted_again(spark, monkeypatch, tmp_path):
    """The model kept is the one that its number of rounds gives, saved and loaded too."""
    draw = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(100)).cast("double")
    rows = spark.range(600).select(
        F.lit("NG").alias("country"), F.lit("a").alias("city"),
        F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
        draw(0).alias("unused"), draw(1).alias("x"), (draw(1) + draw(2)).alias("y"), F.lit(0.0).alias("last"),
    )
    real, fits = model._regressor, []
    monkeypatch.setattr(model, "_regressor", lambda target, rounds, **p: fits.append(rounds) or real(target, rounds, **p))
    monkeypatch.setattr(model, "FIRST_ROUNDS", 6)
    inputs, limits = ["unused", "x", "last"], {"stepSize": 0.9, "maxDepth": 3}
    fitted = model.fit_gbt(rows, inputs, "y", rounds=6, patience=4, **limits)
    kept = model.rounds_made(fitted)
    assert fits == [6] and kept < 6
    # One fit serves two looks: it ends where a fit of the first look's rounds would.
    assert model.rounds_made(model.fit_gbt(rows, inputs, "y", patience=4, **limits)) == kept and fits == [6, 12]
    alone = model.fit_gbt(rows, inputs, "y", rounds=kept, patience=9, least_gain=0.0, **limits)
    assert model.rounds_made(alone) == kept == fitted.stages[-1].getMaxIter()
    model.save_model(fitted, str(tmp_path / "m"))
    again = model.load_model(str(tmp_path / "m"))
    want = model.predict(alone, rows).select("date", "prediction").collect()
    assert all(sorted(model.predict(m, rows).select("date", "prediction").collect()) == sorted(want) for m in (fitted, again))
    assert fitted.stages[-1].treeWeights == alone.stages[-1].treeWeights == again.stages[-1].treeWeights
    weights = [model.importances(m, spark, inputs).collect() for m in (fitted, alone, again)]
    assert weights[0] == weights[1] == weights[2] and len(weights[0]) == 3


def test_search(spark, sf):
    rows = R.feature_rows(spark, sf)
    best = model.search(rows, n=2, folds=2, rounds=1)
    assert len(best.avgMetrics) == 2
    drawn = model.draw_params(2)
    chosen = drawn[min(range(2), key=best.avgMetrics.__getitem__)]
    assert best.bestModel.getMaxDepth() == chosen["maxDepth"] and best.bestModel.getStepSize() == chosen["stepSize"]
    assert best.getFoldCol() == model.FOLD
