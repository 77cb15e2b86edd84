import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as contract
from check import compare, duck
from hazeline.testbed.registry import QUERIES

# One of each kind at the smallest size; ``check.py`` runs them all.
NAMES = [
    "readings_clean", "fact_daily", "fact_aggregated", "dim_locations", "dim_pollutants", "dim_dates",
    "quality_report", "focus_vs_peers", "ml_features", "sensor_days", "city_feed", "places",
    "csv_preamble", "anti_join_new", "stream_ingest", "residual_histogram", "coverage",
    "gate_counts", "incremental_load", "stream_state", "layout_pruning", "table_round_trip",
    "layers_built", "model_split", "model_inputs", "search_folds",
]


def test_every_statement_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    ours = set(QUERIES)
    assert ours - set(contract.oracle_sql()) == {"gbt_train_score", "feature_importance"}


@pytest.mark.parametrize("name", NAMES)
def test_equals_duckdb(spark, sf, name):
    ok, note = compare(spark, duck(sf), name, sf)
    assert ok, note


def test_entry(spark, sf):
    df = contract.entry(spark)
    assert df.count() > 0 and "trend_indicator" in df.columns


def test_sort_desc_orders(spark, sf):
    found = [r["median"] for r in QUERIES["sort_desc"](spark, sf).select("median").collect()]
    known = [m for m in found if m is not None]
    assert known == sorted(known, reverse=True) and found[len(known) :] == [None] * (len(found) - len(known))


@pytest.mark.parametrize("left", [["corpus_pipeline.py"], []])
def test_entry_without_the_text_operators(tmp_path, left):
    """With the folder of the text operators gone, and with or without the pipeline, the
    entry imports and has all other queries."""
    root = Path(contract.__file__).parent
    shutil.copytree(root / "hazeline", tmp_path / "hazeline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *left]:
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    known = [q for q in contract.queries() if q in QUERIES]
    assert out.stdout.split()[:1] == [str(len(known))], out.stderr
