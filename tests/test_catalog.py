"""Queries against a second engine, and the shape of their plans."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from rhoscope.plans import catalog, heldout, inputs, joined, reports  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
CHECKED = [
    "pseudobulk_centroids", "split_half_reliability", "triage_labels", "triage_summary", "score_fallback_join", "rank_all_vs_specific", "bootstrap_ranks",
    "stratified_split", "welch_topk", "cohen_kappa", "json_upsert", "label_keys", "report_rank_comparison", "threshold_grid",
    "wilcoxon", "saturation_fit_numeric", "edge_bins", "control_label_choice", "context_reliability_wide", "holdout_skips", "pool_scaling", "bootstrap_ranks_by_dataset", "energy_validation", "energy_context_curve", "energy_matched_controls", "reliability_status", "describe_documents", "csv_round_trip", "json_documents", "combined_inputs", "expression_metrics",
    "panel_join", "panel_retention", "fit_labels", "subset_stability", "split_stability", "density_of_lines", "glob_of_stems", "specific_terms", "qualifying_contexts",
]
#: Grouped Python: dense algebra.
PYTHON = {"ridge_predictor", "fast_enrichment", "holdout_models", "model_arm_scores", "model_grid", "model_pool_scaling", "model_strategies"}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.6f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_the_other_engine(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(DATA))
    cols = sorted(got.columns)
    ours = sorted(tuple(cell(r[c]) for c in cols) for r in got.collect())
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({catalog.SQL[name]})").fetchall()
    assert ours == sorted(tuple(map(cell, r)) for r in want) and ours


#: Held-out queries run jobs while they are built: some stand for all.
WHILE_BUILT = {n for n, q in catalog.QUERIES.items() if q.__module__ == heldout.__name__} | {"subset_stability", "split_stability"}
PLANNED = [n for n in catalog.QUERIES if n not in WHILE_BUILT or n in ("holdout_skips", "pool_scaling", "holdout_scores")]


@pytest.mark.parametrize("name", sorted(PLANNED))
def test_plan(spark, name):
    plan = catalog.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    if name not in PYTHON:  # matrix products over blocks (MapInArrow) are the only Python
        assert not any(node in plan for node in ("EvalPython", "FlatMapGroups", "InPandas"))
    assert "CartesianProduct" not in plan


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.SQL) | PYTHON == set(catalog.QUERIES)
