"""The constants of the queries are the reference's, on units large enough to tell."""

from __future__ import annotations

import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rhoscope.plans import catalog, reports  # noqa: F401
from rhoscope.sources import fixtures as X

DATA = Path("/root/testdata/sf0.1")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


def brute_median_r(cells, n: int, unit: int) -> float:
    """Median over the repeats of the correlation of two halves of n cells, drawn in MD5 order."""

    def drawn(rep: int, side: str, ids: list[int]) -> list[np.ndarray]:
        order = sorted(ids, key=lambda c: (hashlib.md5(f"{rep}:fixed:{n}:{side}:{c}".encode()).hexdigest(), c))
        return [np.mean([x[c] for c in order[k : k + n]], axis=0) for k in (0, n)]

    x = {c: v for c, (_, v) in cells.items()}
    of = lambda u: [c for c, (v, _) in cells.items() if v == u]
    rs = []
    for rep in range(1, catalog.REPS + 1):
        t, c = drawn(rep, "t", of(unit)), drawn(rep, "c", of(0))
        rs.append(np.corrcoef(t[0] - c[0], t[1] - c[1])[0, 1])
    return float(np.median(rs))


def test_n_star_beyond_sixteen(spark):
    """Units whose correlation reaches a half at 32 or 64 only have an n*, the one brute force finds."""
    rows = X.cells_planted(spark, str(DATA)).groupBy("cell", "unit").agg(F.collect_list(F.struct("g", "x"))).collect()
    cells = {r[0]: (r[1], np.array([v["x"] for v in sorted(r[2])])) for r in rows}
    got = {r["unit"]: r["n_star"] for r in catalog.n_star(spark, str(DATA)).collect()}
    for unit in (1, 4, 6):
        want = next((n for n in catalog.GRID if 2 * n <= 180 and brute_median_r(cells, n, unit) >= 0.5), None)
        assert want is not None and want > 16 and got[unit] == want


def test_every_feasible_size_and_pilot(spark):
    curve = catalog.reliability_curve(spark, str(DATA)).where("mode = 'fixed'").select("unit", "n").distinct().collect()
    assert {r["n"] for r in curve} == {8, 16, 32, 64} and len(curve) == 9 * 4
    pilots = {r["pilot_n"] for r in catalog.pilot_simulation(spark, str(DATA)).collect()}
    assert pilots == set(range(32, 99, 2))  # two sizes (16 and 32 cells) are in from 32 on


def test_whole_sweeps(spark):
    small = "/root/testdata/sf0.001"
    assert catalog.QUERIES["threshold_sensitivity"](spark, small).count() == 25
    assert catalog.QUERIES["quantity_sweep"](spark, small).count() == 8
    assert catalog.QUERIES["bootstrap_ranks"](spark, small).agg(F.max("iter")).first()[0] == 1000
