"""All datasets as files: each is written once and read by those that follow from it.

A build gets a version of its own, and nothing of it is visible before its last write,
which adds the version to the list of published ones. A build that fails leaves the
version before it in place; the next one starts anew. Gate counts and row counts are taken
while the rows are written. One build at a time; readers may run beside it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from hazeline import schemas as S
from hazeline.operators.sets import concat_by_name
from hazeline.plans import compare, dims, facts, features, silver

PUBLISHED = "version long, layer string, dataset string, path string, n_rows long"
GATES = "version long, dataset string, rule string, failed long"


def _list(spark: SparkSession, path: str, schema: str) -> DataFrame:
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def published(spark: SparkSession, root: str) -> DataFrame:
    """The datasets of all published versions."""
    return _list(spark, f"{root}/published", PUBLISHED)


def gate_counts(spark: SparkSession, root: str) -> DataFrame:
    """What the gates of each dataset have failed, by version; ``dropped`` counts rows."""
    return _list(spark, f"{root}/gates", GATES)


def newest(spark: SparkSession, root: str) -> int:
    """Number of the version in use; 0 before the first."""
    return published(spark, root).agg(F.max("version")).head()[0] or 0


def read(spark: SparkSession, root: str, dataset: str, version: int | None = None) -> DataFrame:
    """A dataset of the version in use, or of an older one."""
    version = newest(spark, root) if version is None else version
    row = published(spark, root).filter((F.col("version") == version) & (F.col("dataset") == dataset)).head()
    if row is None:
        raise LookupError(f"no dataset {dataset} in version {version}")
    return spark.read.parquet(row["path"])


class _Build:
    """The writes of one version."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.version = spark, root, newest(spark, root) + 1
        self.rows: list[tuple] = []
        self.gates: dict[str, Observation] = {}

    def gated(self, dataset: str) -> Observation:
        self.gates[dataset] = Observation()
        return self.gates[dataset]

    def write(self, layer: str, dataset: str, df: DataFrame) -> DataFrame:
        """Write a dataset and go on from its files."""
        path = f"{self.root}/versions/{self.version}/{layer}/{dataset}"
        seen = Observation()
        df.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(path)
        self.rows.append((self.version, layer, dataset, path, seen.get["n"]))
        return self.spark.read.parquet(path)

    def publish(self) -> int:
        failed = [
            (self.version, dataset, rule, count)
            for dataset, seen in self.gates.items()
            for rule, count in seen.get.items()
        ]
        # A build that failed between the two writes leaves counts of an unpublished
        # version, which the next build of that number replaces.
        old = gate_counts(self.spark, self.root).filter(F.col("version") < self.version).collect()
        counts = self.spark.createDataFrame([*map(tuple, old), *failed], GATES)
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/gates")
        rows = self.spark.createDataFrame(self.rows, PUBLISHED)
        rows.coalesce(1).write.mode("append").parquet(f"{self.root}/published")
        return self.version


def build(
    spark: SparkSession,
    root: str,
    sources: Sequence[DataFrame],
    places: DataFrame,
    focus: str = S.FOCUS_COUNTRY,
    peers: Sequence[str] = tuple(S.PEER_COUNTRIES),
) -> int:
    """Build and publish all layers from landed readings and places; returns the version.
    The readings are read once, into the first layer, whatever depends on them."""
    run = _Build(spark, root)
    landed = run.write("bronze", "readings", concat_by_name(*map(silver.drop_audit, sources)))
    listed = run.write("silver", "places", places)
    clean = run.write(
        "silver", "readings_clean", silver.readings_clean(landed, observed=run.gated("readings_clean"))
    )
    where = run.write("gold", "dim_locations", dims.dim_locations(listed, observed=run.gated("dim_locations")))
    run.write("gold", "dim_pollutants", dims.dim_pollutants(spark, run.gated("dim_pollutants")))
    when = run.write("gold", "dim_dates", dims.dim_dates(spark, observed=run.gated("dim_dates")))
    fact = run.write("gold", "fact_daily", facts.fact_daily(clean, where, observed=run.gated("fact_daily")))
    run.write("gold", "fact_aggregated", facts.fact_aggregated(fact, when))
    view = compare.focus_vs_peers(fact, where, focus, peers, run.gated("focus_vs_peers"))
    run.write("gold", "focus_vs_peers", view)
    run.write("gold", "ml_features", features.ml_features(fact, where, when))
    return run.publish()
