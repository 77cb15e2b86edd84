"""Forecast model on ``pyspark.ml``: rows stay in DataFrames from features to scores."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.functions.ratios import gauge_pct, per_station, value_range
from hazeline.functions.rules import action_tier, aqi_label, risk_tier, season_flags
from hazeline.operators.aggregates import regression_metrics
from hazeline.plans.features import require_target
from hazeline.session import shared_dir

# A missing input gets a value no real one has, so that trees can send it either way.
MISSING = -1.0e6
PREDICTION = "prediction"

# Training parameters.
ROUNDS = 1000
MAX_DEPTH = 6
LEARNING_RATE = 0.05
ROW_SHARE = 0.8
COLUMN_SHARE = "0.8"
SEED = 42
BINS = 256
VALID_SHARE = 0.1  # of the training rows, held back to end the boosting
PATIENCE = 10  # rounds that end it when they gain too little together
LEAST_GAIN = 0.05  # share of the error on held-back rows that they must gain
FIRST_ROUNDS = 32  # tried at first; twice as many each time until patience runs out
VALID = "_validation"
FOLD = "_fold"
DRAWS = 10_000
SEARCH_SPACE = {
    "maxDepth": (3, 9),
    "stepSize": (0.01, 0.21),
    "subsamplingRate": (0.6, 1.0),
    "featureSubsetStrategy": (0.5, 1.0),
    "minInstancesPerNode": (1, 9),
    "minInfoGain": (0.0, 0.5),
}


# Inputs that a row may lack; each has an indicator beside it.
MAY_LACK = [
    "population", "n_stations", "population_per_station", "monitoring_density_score", "lat", "lon",
    "pm10_30d_avg", "no2_30d_avg", "pm25_7d_volatility", "pm25_lag_14d", "pm25_trend",
]


def key_draw(seed: int, parts: int = DRAWS) -> Column:
    """A number below ``parts`` drawn by place and date. It depends on neither the order
    nor the partitioning of the rows, and any engine that has md5 draws the same."""
    key = F.concat_ws("|", F.lit(str(seed)), "country", "city", F.col("date").cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(parts))


def to_float(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def flags(features: Sequence[str] = tuple(S.FEATURES)) -> list[str]:
    """Inputs that get an indicator of being missing."""
    return [c for c in features if c in MAY_LACK]


def assembler(features: Sequence[str] = tuple(S.FEATURES)) -> list:
    """Stages that cast, fill, flag and pack the inputs; saved along with the model."""
    filled = [f"coalesce(cast(`{c}` as double), {MISSING}D) AS `_in_{c}`" for c in features]
    lacking = [f"cast(`{c}` IS NULL as double) AS `_in_{c}_missing`" for c in flags(features)]
    names = [f"_in_{c}" for c in features] + [f"_in_{c}_missing" for c in flags(features)]
    return [
        SQLTransformer(statement=f"SELECT *, {', '.join(filled + lacking)} FROM __THIS__"),
        VectorAssembler(inputCols=names, outputCol="features"),
    ]


def inputs(df: DataFrame, features: Sequence[str] = tuple(S.FEATURES)) -> DataFrame:
    """Rows with a target, their inputs as the trees get them, and the indicators as
    ``<input>_missing``."""
    rows = assembler(features)[0].transform(to_float(require_target(df), features))
    names = {f"_in_{c}": c for c in features} | {f"_in_{c}_missing": f"{c}_missing" for c in flags(features)}
    kept = [c for c in df.columns if c not in features]
    return rows.select(*kept, *[F.col(c).alias(name) for c, name in names.items()])


def assemble(df: DataFrame, features: Sequence[str] = tuple(S.FEATURES)) -> DataFrame:
    for stage in assembler(features):
        df = stage.transform(df)
    return df.drop(*[c for c in df.columns if c.startswith("_in_")])


def split(
    df: DataFrame,
    mode: str = "hash",
    train_share: float = 0.8,
    seed: int = SEED,
    cut_date: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Training and hold-out rows. ``hash`` draws by key; ``date`` holds out everything
    from ``cut_date`` on, which keeps overlapping windows from leaking across the split."""
    if mode == "date":
        held = F.col("date") >= F.lit(cut_date).cast("date")
    else:
        held = key_draw(seed) >= int(train_share * DRAWS)
    return df.filter(~held), df.filter(held)


def marked(train: DataFrame, seed: int = SEED) -> DataFrame:
    """Training rows with a mark on those held back to end the boosting."""
    return train.withColumn(VALID, key_draw(seed + 1) < int(VALID_SHARE * DRAWS))


def folded(train: DataFrame, folds: int, seed: int = SEED) -> DataFrame:
    """Training rows with the number of their fold."""
    return train.withColumn(FOLD, key_draw(seed + 2, folds).cast("int"))


def _regressor(target: str, rounds: int, **params) -> GBTRegressor:
    settings = {
        "maxDepth": MAX_DEPTH,
        "stepSize": LEARNING_RATE,
        "subsamplingRate": ROW_SHARE,
        "featureSubsetStrategy": COLUMN_SHARE,
        "seed": SEED,
        "maxBins": BINS,
        **params,
    }
    return GBTRegressor(
        featuresCol="features",
        labelCol=target,
        predictionCol=PREDICTION,
        maxIter=rounds,
        lossType="squared",
        checkpointInterval=10,
        **settings,
    )


def first_rounds(trees: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The model that boosting ended after ``rounds`` would be, without fitting it anew: a
    round's trees depend on the rounds before it only."""
    context, fitted = SparkContext.getOrCreate(), trees._java_obj
    jvm = context._jvm.org.apache.spark.ml.regression
    kept = context._gateway.new_array(jvm.DecisionTreeRegressionModel, rounds)
    weights = context._gateway.new_array(context._jvm.double, rounds)
    for k, tree in enumerate(fitted.trees()[:rounds]):
        kept[k], weights[k] = tree, float(trees.treeWeights[k])
    cut = GBTRegressionModel(jvm.GBTRegressionModel(fitted.uid(), kept, weights, fitted.numFeatures()))
    return trees._copyValues(cut, {trees.maxIter: rounds})


def rounds_made(model: PipelineModel) -> int:
    return model.stages[-1].getNumTrees


def rounds_to_keep(errors: Sequence[float], patience: int, least_gain: float) -> int | None:
    """Number of rounds up to the best error, if the last ``patience`` rounds have gained
    too little on the best before them; None while they still gain."""
    if len(errors) <= patience:
        return None
    before, after = min(errors[:-patience]), min(errors[-patience:])
    if before - after > least_gain * before:
        return None
    return min(range(len(errors)), key=errors.__getitem__) + 1


def fit_gbt(
    train: DataFrame,
    features: Sequence[str] = tuple(S.FEATURES),
    target: str = S.TARGET,
    rounds: int = ROUNDS,
    patience: int = PATIENCE,
    least_gain: float = LEAST_GAIN,
    **params,
) -> PipelineModel:
    """Boosted trees on squared error, of ``rounds`` rounds at most. Boosting ends when the
    last ``patience`` rounds together took less than ``least_gain`` of the error on held-back
    rows, and rounds after the best are then left out. That is looked at after
    ``FIRST_ROUNDS``, twice as many, and so on. A round's trees depend on the rounds before
    it only, so a fit says how all shorter ones would have ended: the first has room for the
    first two looks, each one after for one more, and the rounds to keep are taken out of the
    last. The rows and every tenth round are checkpointed in the shared folder: features
    are computed once, and a lost executor replays neither them nor the boosting history."""
    shared_dir(train.sparkSession)
    rows = marked(require_target(train, target)).select(*features, F.col(target).cast("double"), VALID)
    packer = Pipeline(stages=assembler(features)).fit(rows)
    rows = packer.transform(rows).select("features", target, VALID).checkpoint()
    fitting, held = rows.filter(f"NOT {VALID}"), rows.filter(VALID)
    looks, watched = [min(FIRST_ROUNDS, rounds)], not held.isEmpty()
    if watched:
        looks.append(min(2 * looks[0], rounds))
    while True:
        trees = _regressor(target, looks[-1], **params).fit(fitting)
        errors = trees.evaluateEachIteration(held, "squared") if watched else []
        kept = (rounds_to_keep(errors[:n], patience, least_gain) if watched else None for n in looks)
        best = next((n for n in kept if n is not None), None)
        if best is not None or looks[-1] == rounds or not watched:
            break
        looks = [min(2 * looks[-1], rounds)]
    if best is None:
        best = min(range(len(errors)), key=errors.__getitem__) + 1 if watched else looks[-1]
    if best < looks[-1]:
        trees = first_rounds(trees, best)
    return PipelineModel([*packer.stages, trees])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    scored = model.transform(df)
    return scored.drop("features", *[c for c in scored.columns if c.startswith("_in_")])


def evaluate(predictions: DataFrame, target: str = S.TARGET) -> DataFrame:
    return regression_metrics(predictions, target, PREDICTION)


def importances(
    model: PipelineModel, spark: SparkSession, features: Sequence[str] = tuple(S.FEATURES)
) -> DataFrame:
    """One row per input and per indicator, most important first."""
    weights = model.stages[-1].featureImportances.toArray()
    names = [*features, *(f"{c}_missing" for c in flags(features))]
    rows = [(name, float(w)) for name, w in zip(names, weights)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def projection_90d(features: DataFrame) -> DataFrame:
    """Linear projection from the 30-day mean and the trend, one row per feature row."""
    return features.select(
        "city",
        "country",
        (F.col("pm25_30d_avg") + F.col("pm25_trend") * 3).alias("forecast_90d_pm25"),
    )


def derive_inputs(df: DataFrame) -> DataFrame:
    """Inputs that follow from others, by the same definitions as in training: calendar
    parts and seasons of ``date``, people per station, 30-day range."""
    d = F.col("date")
    return df.withColumns(
        {
            "year": F.year(d),
            "month": F.month(d),
            "day_of_week": F.dayofweek(d),
            "quarter": F.quarter(d),
            "is_weekend": F.dayofweek(d).isin(1, 7),
            **season_flags(F.month(d)),
            "population_per_station": per_station(F.col("population"), F.col("n_stations")),
            "pm25_30d_range": value_range(F.col("pm25_30d_min"), F.col("pm25_30d_max")),
        }
    )


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Batch scoring of rows that carry a date, place attributes and history."""
    return predict(model, derive_inputs(df))


def present(scored: DataFrame, prediction: str = PREDICTION) -> DataFrame:
    """Display columns of a score."""
    p = F.col(prediction)
    return scored.withColumns(
        {
            "aqi_label": aqi_label(p),
            "risk_tier": risk_tier(p),
            "action_tier": action_tier(p),
            "delta_vs_30d": p - F.col("pm25_30d_avg"),
            "gauge_pct": gauge_pct(p),
        }
    )


def draw_params(n: int, seed: int = SEED) -> list[dict]:
    """Seeded random parameter sets."""
    rng = random.Random(seed)
    whole = {"maxDepth", "minInstancesPerNode"}
    draws = []
    for _ in range(n):
        draw = {
            name: rng.randint(lo, hi) if name in whole else round(rng.uniform(lo, hi), 4)
            for name, (lo, hi) in SEARCH_SPACE.items()
        }
        draw["featureSubsetStrategy"] = str(draw["featureSubsetStrategy"])
        draws.append(draw)
    return draws


def search(
    train: DataFrame,
    n: int = 5,
    folds: int = 2,
    rounds: int = FIRST_ROUNDS,
    features: Sequence[str] = tuple(S.FEATURES),
    target: str = S.TARGET,
    seed: int = SEED,
    parallel: int = 2,
) -> CrossValidatorModel:
    """Random search by cross-validated mean absolute error over folds drawn by key, some
    fits at a time. ``rounds`` is the same for all draws."""
    shared_dir(train.sparkSession)
    gbt = _regressor(target, rounds)
    grid = [
        {gbt.getParam(name): value for name, value in draw.items()} for draw in draw_params(n, seed)
    ]
    validator = CrossValidator(
        estimator=gbt,
        estimatorParamMaps=grid,
        evaluator=RegressionEvaluator(
            labelCol=target, predictionCol=PREDICTION, metricName="mae"
        ),
        numFolds=folds,
        seed=seed,
        foldCol=FOLD,
        parallelism=parallel,
    )
    rows = folded(require_target(train, target), folds, seed).withColumn(target, F.col(target).cast("double"))
    return validator.fit(assemble(rows, features).select("features", target, FOLD).checkpoint())
