"""Density on the grid: what moves between tasks, blocks, joins that are too large to broadcast, exact medians."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rhoscope.operators import density as D


def _shuffled(spark, run) -> int:
    """Rows that the stages of ``run`` write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    before = {s.stageId() for s in map(stages().apply, range(stages().size()))}
    run()
    found = stages()
    return sum(s.shuffleWriteRecords() for s in map(found.apply, range(found.size())) if s.stageId() not in before)


def test_points_stay_where_they_are(spark):
    """Occupied cells are shuffled, once a task and block, and a few values in a median's bracket; no points."""
    n = 120_000
    at = spark.range(n).select((F.col("id") % 2).alias("g"), (F.col("id") % 20).cast("double").alias("x"), (F.floor(F.col("id") / 20) % 30).cast("double").alias("y"))
    out = {}

    def run():
        d = D.density_2d(at, "x", "y", ["g"])
        d.write.format("noop").mode("overwrite").save()
        assert "Exchange hashpartitioning" not in d._jdf.queryExecution().executedPlan().toString()
        out["rows"] = D.summary(d, ["g"], "density").collect()

    assert _shuffled(spark, run) < n / 4
    assert sum(r.n for r in out["rows"]) == n and all(0 < r.low <= r.median <= r.high for r in out["rows"])


def _brute(x, y):
    """The grid's density from all pairs of occupied corners."""
    n, c, reach = len(x), D.CELLS, D.REACH * D.CELLS
    sx, b = x.std(ddof=1), np.cov(x, y)[0, 1] / x.std(ddof=1)
    s, d = math.sqrt(y.var(ddof=1) - b * b), n ** (-1 / 6) / c
    p, q = (x - x.mean()) / sx / d, ((y - y.mean()) - b * (x - x.mean()) / sx) / s / d
    corners = [(a, e, (p % 1 if a else 1 - p % 1) * (q % 1 if e else 1 - q % 1)) for a in (0, 1) for e in (0, 1)]
    i, j, w = (np.concatenate(v) for v in zip(*[(np.floor(p) + a, np.floor(q) + e, v) for a, e, v in corners], strict=True))
    k = lambda o: np.where(abs(o) <= reach, np.exp(-o * o / (2.0 * c * c)) / (math.sqrt(2 * math.pi) * c), 0.0)
    f = (k(i[:, None] - i) * k(j[:, None] - j)) @ w
    return (w * f).reshape(4, -1).sum(0) / (n * d * d * sx * s)


@pytest.mark.parametrize(("side", "most"), [(256, 1 << 16), (16, 1 << 16), (8, 0)])
def test_density_over_blocks(spark, monkeypatch, side, most):
    """Many blocks, points far out, groups by two columns with nulls; also where nothing is broadcast."""
    monkeypatch.setattr(D, "SIDE", side)
    monkeypatch.setattr(D, "GROUPS", most)
    monkeypatch.setattr(D, "PATCHES", most)
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for g, h, n in (("a", 1, 300), (None, 1, 120), ("a", None, 40)):
        x, y = rng.standard_t(2, n), rng.standard_t(2, n)
        want |= {(g, h, k): v for k, v in enumerate(_brute(x, y))}
        rows += [(g, h, k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    rows += [("a", 1, -1, None, 1.0), ("none", 1, -2, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, h int, k int, x double, y double").repartition(5)
    out = D.density_2d(df, "x", "y", ["g", "h"])
    got = {(r.g, r.h, r.k): r.density for r in out.collect()}
    assert out.columns == [*df.columns, "density"] and len(got) == len(rows)
    assert got.pop(("a", 1, -1)) is None and got.pop(("none", 1, -2)) is None
    assert max(abs(got[k] - v) / v for k, v in want.items()) < 1e-9


@pytest.mark.parametrize("steps", [D.STEPS, -1])
def test_exact_medians(spark, monkeypatch, steps):
    """Odd and even groups, ties, nulls, values in a bracket; with a bracket that misses all are counted."""
    monkeypatch.setattr(D, "STEPS", steps)
    t = spark.range(450_001).select(
        F.when(F.col("id") < 150_000, "many").when(F.col("id") < 300_001, "ties").when(F.col("id") < 449_990, None).otherwise("few").alias("g"),
        F.when(F.col("id") < 150_000, F.xxhash64("id") / 1e18).when(F.col("id") < 300_001, (F.col("id") % 3).cast("double")).when(F.col("id") % 5 != 0, F.sqrt("id")).alias("v"),
    )
    t = t.union(spark.createDataFrame([("null", None), ("one", 2.0), ("two", 1.0), ("two", 4.0)], "g string, v double"))
    want = {r.g: tuple(r)[1:] for r in t.groupBy("g").agg(F.count("*"), F.min("v"), F.percentile("v", F.lit(0.5)), F.max("v")).collect()}
    got = {r.g: (r.n, r.low, r.median, r.high) for r in D.summary(t, ["g"], "v").collect()}
    assert got == {g: pytest.approx(w, rel=1e-15) if w[1] is not None else w for g, w in want.items()}
    assert D.summary(t.where("false"), ["g"], "v").count() == 0
