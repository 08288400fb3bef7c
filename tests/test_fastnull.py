"""The parametric null against closed forms, against permutations, and on planted terms."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pytest

from rhoscope.functions import stats as S
from rhoscope.operators import enrichment as G
from rhoscope.operators import fastnull as N


def test_gamma_tail():
    for x in (0.01, 0.5, 1.0, 3.0, 20.0):
        assert math.isclose(N.gamma_tail(1.0, x), math.exp(-x), rel_tol=1e-9)
        assert math.isclose(N.gamma_tail(3.0, x), math.exp(-x) * (1 + x + x * x / 2), rel_tol=1e-9)
        assert math.isclose(N.gamma_tail(0.5, x), math.erfc(math.sqrt(x)), rel_tol=1e-9)
    assert N.gamma_tail(2.0, 0.0) == 1.0 and abs(N.gamma_tail(1e5, 1e5) - 0.5) < 1e-2


def test_null_scores_equal_running_sums():
    rng = np.random.default_rng(1)
    v = np.sort(rng.normal(size=40))[::-1]
    got = N.null_scores(v, 6, 80, np.random.default_rng(5))
    draw = np.random.default_rng(5)
    want = []
    for at in (64, 16):
        for row in np.argpartition(draw.random((at, 40)), 5, axis=1)[:, :6]:
            hit = np.isin(np.arange(40), row)
            run = np.cumsum(np.where(hit, np.abs(v) / np.abs(v[hit]).sum(), -1 / 34))
            want.append(run.max() if round(run.max(), 9) >= round(-run.min(), 9) else run.min())
    assert np.allclose(got, want, atol=1e-12)


def test_planted_terms_and_agreement_with_permutations(spark):
    """p within a third in logarithm, or within 0.05, of 1000 permutations; the planted term is found alone."""
    rng = np.random.default_rng(3)
    v = np.sort(rng.normal(size=300))[::-1]
    sets = {f"T{k}": rng.choice(300, 8 + 3 * k, replace=False).tolist() for k in range(12)} | {"top": list(range(0, 30, 2)), "low": list(range(280, 300, 2)), "tiny": [1, 2]}
    ranked = spark.createDataFrame([(1, "x", g, float(x)) for g, x in enumerate(v)] + [(2, "flat", g, 1.0) for g in range(300)], "unit int, side string, g int, v double")
    terms = spark.createDataFrame([(t, int(g)) for t, gs in sets.items() for g in gs], "term string, g int")
    fast = {r["term"]: r for r in N.fast_enrich(ranked, terms, ["unit", "side"], "v").collect()}
    slow = {r["term"]: r for r in G.enrich(ranked, terms, ["unit", "side"], "v", 1000).collect()}
    assert set(fast) == set(slow) == set(sets) - {"tiny"} and {r["unit"] for r in fast.values()} == {1}
    for t, r in fast.items():
        assert math.isclose(r["es"], slow[t]["es"], abs_tol=1e-9) and r["nes"] * r["es"] >= 0
        assert abs(r["p"] - slow[t]["p"]) < 0.05 or abs(math.log(r["p"] / slow[t]["p"])) < math.log(10) / 3
    assert {t for t, r in fast.items() if r["fdr"] < 0.05} == {"top", "low"} and fast["top"]["nes"] > 2 > -2 > fast["low"]["nes"]
    again = {r["term"]: r["p"] for r in N.fast_enrich(ranked.repartition(5), terms, ["unit", "side"], "v").collect()}
    assert set(again) == set(fast) and all(math.isclose(again[t], r["p"], rel_tol=1e-9) for t, r in fast.items())  # scores are sums, in any order


@pytest.mark.parametrize("edges", [[0.0, 1.0], [0.0, 0.5, 2.0, 7.0], [float(k * k) for k in range(61)], [float(k) for k in range(66)]])
def test_edge_bins(spark, edges):
    rng = np.random.default_rng(2)
    xs = [*edges, -1.0, edges[-1] + 1, *rng.uniform(-1, edges[-1] + 1, 200).tolist()]
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in xs], "x double").coalesce(1).select(S.edge_bin("x", edges)).collect()]
    assert got == [None if not edges[0] <= x <= edges[-1] else min(bisect.bisect_right(edges, x) - 1, len(edges) - 2) for x in xs]
