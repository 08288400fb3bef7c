"""Resampling, predictors and tests against numpy or closed forms."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rhoscope.operators import benchmark as B
from rhoscope.operators import bootstrap as BS
from rhoscope.operators import draws as D
from rhoscope.operators import energy as E
from rhoscope.operators import enrichment as G
from rhoscope.operators import experiments as P
from rhoscope.operators import inference as I
from rhoscope.operators import reliability as R
from rhoscope.operators import retrain as T
from rhoscope.operators import sampling as W
from rhoscope.operators import saturation as N


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(0)
    rows = [(c, c % 3, g, float(rng.normal() + (c % 3) * (g % 2))) for c in range(60) for g in range(6)]
    return spark.createDataFrame(rows, "cell long, unit int, g int, x double").cache()


def matrix(cells):
    x = {(r.cell, r.g): r.x for r in cells.collect()}
    return np.array([[x[c, g] for g in range(6)] for c in range(60)])


def test_halves_are_disjoint_and_equal(spark):
    df = spark.range(40).select(F.col("id").alias("cell"), (F.col("id") % 2).alias("u"), F.lit(7).alias("n"))
    out = W.halves(W.repeats(df, 5), ["u", "rep"], ["rep", "cell"], "cell", "n").collect()
    for key in itertools.product(range(2), range(1, 6)):
        a, b = ({r.cell for r in out if (r.u, r.rep, r.half) == (*key, h)} for h in (1, 2))
        assert len(a) == len(b) == 7 and not a & b


def test_resampling_ignores_partitioning(spark):
    df = spark.range(100).select(F.col("id").alias("c"), (F.col("id") % 3).alias("s"))
    once = sorted(map(tuple, W.split_test(df, ["s"], ["c"], "c").collect()))
    again = sorted(map(tuple, W.split_test(df.orderBy(F.desc("c")).repartition(7), ["s"], ["c"], "c").collect()))
    assert once == again


@pytest.mark.parametrize(("n", "test"), [(1, 0), (2, 1), (6, 2), (10, 2), (14, 4), (18, 4)])
def test_split_sizes_round_half_to_even(spark, n, test):
    df = spark.range(n).select(F.col("id").alias("c"), F.lit("s").alias("s"))
    assert W.split_test(df, ["s"], ["c"], "c").where("split = 'test'").count() == test


def test_bootstrap_draws_stay_in_their_stratum(spark):
    df = spark.createDataFrame([("a", k) for k in range(5)] + [("b", 9)], "s string, u int")
    out = W.bootstrap_draws(df, ["s"], ["u"], 20, "x").collect()
    assert len(out) == 20 * 6 and all((r.s == "b") == (r.u == 9) for r in out) and len({r.u for r in out}) == 6


def test_centroids_axis_and_residuals(spark, cells):
    x = matrix(cells)
    unit = np.arange(60) % 3
    d = {(r.unit, r.g): r.delta for r in R.deltas(cells).collect()}
    mean = [x[unit == u].mean(axis=0) for u in range(3)]
    assert all(math.isclose(d[u, g], mean[u][g] - mean[0][g]) for u in (1, 2) for g in range(6))
    good = spark.createDataFrame([(1,), (2,)], "unit int")
    axis = R.shared_axis(cells, good)
    a = np.array([r.avg_delta for r in axis.orderBy("g").collect()])
    assert np.allclose(a, x[unit > 0].mean(axis=0) - mean[0])
    res = R.residuals(R.deltas(cells), axis).groupBy("unit").agg(F.sum(F.col("residual") * F.col("avg_delta")).alias("dot"))
    assert all(abs(r.dot) < 1e-9 for r in res.collect())
    m = {r.unit: r for r in R.axis_metrics(cells, good.where("unit = 1")).collect()}
    assert m[2].cos_sim is None and 0 <= m[1].frac_systematic_var <= 1 + 1e-9


def test_split_half_bounds(cells):
    units = cells.select("cell", "unit").distinct()
    long = R.reliability_long(R.split_half_r(cells, units, 5, [4, 8], 3)).collect()
    assert len(long) == 2 * 3 * 2
    assert all(0 <= r.sb_from_median <= 1 and r.min_r <= r.median_r <= r.max_r for r in long)


def test_half_sums_by_blocks_and_pieces(spark):
    """More cells than a block has and genes in pieces give the correlations of plain loops."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2600, 5)) + np.arange(2600)[:, None] % 2 * np.arange(5)
    rows = [(k, k % 2, g, float(x[k, g])) for k in range(2600) for g in range(5)]
    df = spark.createDataFrame(rows, "cell long, unit int, g int, x double")
    units = df.select("cell", "unit").distinct()
    show = lambda r: sorted((t.mode, t.n, t.gene_mode, t.rep, round(t.r, 9)) for t in r.collect())
    one = show(R.split_half_r(df, units, 2, [4], 3))
    assert len(one) == 2 * 2 * 2 and one == show(R.split_half_r(df, units, 2, [4], 3, pieces=7))
    md5 = lambda *k: hashlib.md5(":".join(map(str, k)).encode()).hexdigest()
    for mode, n, genes, rep, r in one:
        top = slice(None) if genes == "all_genes" else np.argsort(-x[::2].mean(axis=0))[:3]
        half = {}
        for unit, salt in ((1, "t"), (0, "c")):
            ids = sorted(range(unit, 2600, 2), key=lambda k: md5(rep, mode, n, salt, k))
            half[unit] = [x[ids[:n]].mean(axis=0), x[ids[n : 2 * n]].mean(axis=0)]
        a, b = (half[1][k] - half[0][k] for k in (0, 1))
        assert math.isclose(r, np.corrcoef(a[top], b[top])[0, 1], abs_tol=1e-8)


def test_energy_distance(cells):
    x, unit = matrix(cells), np.arange(60) % 3
    vec = E.vectors(cells)
    dist = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2)).mean()
    for r in E.between(vec).collect():
        p, c = x[unit == r.unit], x[unit == 0]
        assert math.isclose(r.e_between, 2 * dist(p, c) - dist(p, p) - dist(c, c)) and r.e_between >= 0


def test_energy_without_effect_counts_as_reliable(spark):
    rows = [(c, c % 2, 0, 1.0) for c in range(32)]
    same = spark.createDataFrame(rows, "cell long, unit int, g int, x double")
    out = E.reliability_curve(E.vectors(same), 3, [4]).collect()
    assert [(r.n_half, r.rho_e) for r in sorted(out, key=lambda r: r.n_half)] == [(-1, 0.0), (4, 0.0)]


def test_energy_blocks_and_pools(spark):
    """Several blocks a unit, a context that falls back to all controls, one that has its own."""
    rng = np.random.default_rng(5)
    rows = [(k, 0 if k % 3 else 1, 0 if k < 160 else 1, rng.normal(size=3) + (k % 3 == 0)) for k in range(700)]
    rows = [(k, unit, c if unit or k % 20 else 1 - c, x) for k, unit, c, x in rows if unit or c == 0 or k % 70 == 1]
    df = spark.createDataFrame([(k, unit, c, x.tolist()) for k, unit, c, x in rows], "cell long, unit int, ctx int, v array<double>")
    sums, e = E.half_sums_and_effect(df, ["ctx"], 2, [8], least_pool=30)
    got = {(r.ctx, r.size, r.rep): (r.s12, r.s11, r.s22) for r in sums.collect()}
    dist = lambda a, b: np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    of = lambda unit, ctx: np.array([x for _, u, c, x in rows if u == unit and c in ctx])
    for r in e.collect():
        p = of(1, [r.ctx])
        own = of(0, [r.ctx])
        c = own if len(own) >= 30 else of(0, [0, 1])
        assert (r.n, r.n_ctrl) == (len(p), len(c))
        assert math.isclose(r.e_between, 2 * dist(p, c).mean() - dist(p, p).mean() - dist(c, c).mean(), rel_tol=1e-9)
        assert math.isclose(got[r.ctx, 0, 0][1], dist(p, p).sum())
    assert {r.n_ctrl for r in e.collect()} == {len(of(0, [0])), len(of(0, [0, 1]))}
    drawn = E.drawn_halves(df.where("unit = 1").select("cell", "unit", "ctx"), ["ctx", "unit"], 2, [8], 4).select("ctx", F.explode("drawn").alias("d")).select("ctx", "d.*").collect()
    where = {k: x for k, _, _, x in rows}
    for ctx, size, rep in {(r.ctx, r.size, r.rep) for r in drawn}:
        a, b = (np.array([where[r.cell] for r in drawn if (r.ctx, r.size, r.rep, r.half) == (ctx, size, rep, h)]) for h in (1, 2))
        assert len(a) == len(b) == size
        assert np.allclose(got[ctx, size, rep], [dist(a, b).sum(), dist(a, a).sum(), dist(b, b).sum()])
    assert E.reliability_curve(df.limit(0), 2, [8], ["ctx"]).count() == 0 == E.between(df.limit(0)).count()


def test_welch(cells):
    x, unit = matrix(cells), np.arange(60) % 3
    for r in R.welch_t(cells).collect():
        p, c = x[unit == r.unit, r.g], x[unit == 0, r.g]
        assert math.isclose(r.t, (p.mean() - c.mean()) / math.sqrt(p.var(ddof=1) / len(p) + c.var(ddof=1) / len(c)))


def test_excess_drops_units_without_baseline(spark):
    rows = [("base", "d1", "u_0", 1.0), ("m", "d1", "u_0", 3.0), ("m", "d1", "v_0", 9.0), ("m", "d2", "w_0", 4.0), ("base", "d2", "w_0", 4.0), ("n", "d1", "v_0", 1.0)]
    s = spark.createDataFrame(rows, "method string, dataset string, op string, score double")
    assert {r.method: r.excess for r in B.excess_by_method(s, "base").collect()} == {"m": 1.0}
    assert {r.method: r.excess for r in B.excess_by_method(s, "base", absent_as_zero=True).collect()} == {"m": 1.0, "n": 0.0}
    assert {r.method: r.excess for r in B.excess_by_method(s, "base", skip=["m"], absent_as_zero=True).collect()} == {"n": 0.0}


def test_fallback_join(spark):
    s = spark.createDataFrame([("d", "Pat-1.x"), ("d", "1 X"), ("d", "zz"), (None, "1 x")], "dataset string, op string")
    t = spark.createDataFrame([("d", "1_x")], "dataset string, condition string")
    assert sorted(r.op for r in B.join_with_fallback(s, t, "op", "condition").collect()) == ["1 X", "Pat-1.x"]


def test_saturation_recovers_tau(spark):
    rows = [(u, n, n * t / (n * t + 1)) for u, t in (("a", 0.02), ("b", 0.3)) for n in (8, 16, 32, 64)] + [("c", 8, 0.5), ("d", 8, None), ("d", 16, -2.0)]
    p = spark.createDataFrame(rows, "u string, n_total int, rho double")
    fit = {r.u: r for r in N.fit(p, ["u"]).collect()}
    assert set(fit) == {"a", "b"} and abs(fit["a"].tau_sq - 0.02) < 1e-6 and abs(fit["b"].tau_sq - 0.3) < 1e-5
    grid = {r.u: r.tau_sq for r in N.fit_on_grid(p, ["u"]).collect()}
    assert all(abs(math.log(grid[u] / fit[u].tau_sq)) < 0.06 for u in grid)
    curve = spark.createDataFrame([(10, 0.0), (20, 0.9), (30, 1.0)], "x int, y double")
    assert tuple(N.elbow(curve, "x", "y").first()) == (20, 0.9)


def test_kappa_and_icc(spark):
    df = spark.createDataFrame([("x", "x")] * 4 + [("x", "y")] + [("y", "y")] * 5 + [(None, "x")], "a string, b string")
    r = I.kappa(df, "a", "b").first()
    assert math.isclose(r.agreement, 0.9) and math.isclose(r.kappa, 0.8) and r.n == 10
    v = spark.createDataFrame([("u", 1.0), ("u", 3.0), ("v", 5.0), ("v", 7.0), ("w", 1.0)], "u string, v double")
    r = I.icc(v, "u", "v").first()
    assert (r.var_between, r.var_within, r.n_units) == (4.0, 1.0, 2)


def signed_rank(values):
    """w and p: signs enumerated, or the normal law where there are ties or zeros."""
    v = np.array([x for x in values if x], float)
    rank = np.array([(sum(abs(y) < abs(x) for y in v) + (sum(abs(y) <= abs(x) for y in v) + 1)) / 2 for x in v])
    w = min(rank[v > 0].sum(), rank[v < 0].sum())
    if len(v) == len(values) and len(set(abs(v))) == len(v) and len(v) <= 12:
        sums = [sum(r for r, s in zip(rank, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(v))]
        return w, min(1.0, 2 * sum(s <= w for s in sums) / len(sums))
    n, ties = len(v), sum(c**3 - c for c in Counter(abs(v)).values())
    z = (w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return w, math.erfc(abs(z) / math.sqrt(2))


def test_wilcoxon(spark):
    """Exact without ties, normal with ties, zeros or more than 50 values; too few have none."""
    rng = np.random.default_rng(9)
    groups = {f"exact{k}": (rng.permutation(20)[: 5 + k] + 1) * rng.choice([-1, 1], 5 + k) for k in range(8)}
    groups |= {"ties": np.array([1, 1, -1, 2, 3, -3, 4]), "zeros": np.array([0, 1, 2, -3, 4, 5]), "many": (np.arange(60) + 1) * np.where(np.arange(60) % 3, 1, -1), "far": np.arange(1, 91)}
    rows = [(g, float(x)) for g, xs in [*groups.items(), ("few", [1, 2, 3, 4]), ("none", [0, 0, 0, 0, 0])] for x in xs]
    got = {r.g: r for r in I.wilcoxon(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", 0.0).collect()}
    assert all((got[g].w, got[g].p_wilcoxon) == (None, None) for g in ("few", "none")) and got["few"].n == 4
    for g, xs in groups.items():
        w, p = signed_rank(xs)
        assert got[g].n == len(xs) and got[g].w == w and math.isclose(got[g].p_wilcoxon, p, rel_tol=1e-9)


def test_erfc(spark):
    xs = [0.0, 1e-9, 0.3, 1.0, 2.4999, 2.5, 3.3, 5.0, 9.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(I.erfc(F.col("x"))).collect()
    assert all(math.isclose(r[0], math.erfc(x), rel_tol=1e-9) for r, x in zip(got, xs, strict=True))


def test_sign_test(spark):
    df = spark.createDataFrame([("g", x) for x in (1.0, 2.0, 3.0, 4.0, -1.0, 0.0)], "g string, v double")
    r = I.sign_test(df, ["g"], "v").first()
    assert (r.n, r.n_pos) == (5, 4) and math.isclose(r.p_sign, 0.375)


def test_bilinear_model_matches_closed_form():
    rng = np.random.default_rng(1)
    expr, delta, target = rng.normal(size=(14, 20)), rng.normal(size=(14, 20)), list(range(14))
    model = T.fit_bilinear(expr, delta, target)
    x = expr.T - expr.T.mean(axis=0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    g = u[:, :10] * s[:10]
    p, b = g[target], delta.mean(axis=0)
    w = np.linalg.inv(g.T @ g + 0.1 * np.eye(10)) @ g.T @ (delta - b).T @ p @ np.linalg.inv(p.T @ p + 0.1 * np.eye(10))
    assert np.allclose(model(3), g @ w @ g[3] + b)
    assert np.allclose(model([3]), model(3)) and model([3, 5]) is None and model([3, 99]) is None
    assert model(99) is None and T.fit_bilinear(expr[:1], delta[:1], [0]) is None
    assert np.allclose(T.fit_bilinear(expr, delta, target, np.ones(14))(3), model(3))


def test_models_of_every_arm(spark):
    """Scores of both models against direct fits; a null target, a small arm and an arm of zero weights."""
    rng = np.random.default_rng(2)
    expr, delta = rng.normal(size=(6, 8)), rng.normal(size=(6, 8))
    target = [0, 1, 2, 3, 4, None]
    vectors = spark.createDataFrame([(u, target[u], expr[u].tolist(), delta[u].tolist()) for u in range(6)], "unit int, target int, expr array<double>, delta array<double>")
    sets = {"five": [0, 1, 2, 3, 4], "three": [1, 2, 4], "one": [3]}
    arms = spark.createDataFrame([(a, u) for a, us in sets.items() for u in us], "arm string, unit int")
    got = {(r.model, r.arm, r.unit): (r.l2, r.pcc) for r in P.model_scores(arms, vectors, ["arm"]).collect()}
    assert {k for k in got if k[0] == "bilinear"} == {("bilinear", a, u) for a in ("five", "three") for u in range(5)}
    for (model, arm, unit), (l2, pcc) in got.items():
        us = sets[arm]
        pred = delta[us].mean(axis=0) if model == "mean" else T.fit_bilinear(expr[us], delta[us], us)(unit)
        assert math.isclose(l2, np.linalg.norm(pred - delta[unit]), rel_tol=1e-6) and math.isclose(pcc, np.corrcoef(pred, delta[unit])[0, 1], rel_tol=1e-6)
    weights = {"w": [3.0, 1.0, 0.0, 0.5, 2.0], "none": [0.0] * 5}
    arms = spark.createDataFrame([(a, u, w) for a, ws in weights.items() for u, w in enumerate(ws)], "arm string, unit int, weight double")
    got = {(r.model, r.arm, r.unit): r.l2 for r in P.model_scores(arms, vectors, ["arm"]).collect()}
    assert {a for _, a, _ in got} == {"w"}
    model = T.fit_bilinear(expr[:5], delta[:5], list(range(5)), np.array(weights["w"]))
    assert all(math.isclose(got["bilinear", "w", u], np.linalg.norm(model(u) - delta[u]), rel_tol=1e-6) for u in range(5))


def test_ranks_of_each_dataset(spark):
    rows = [(m, d, f"{d}{u}", "Specific" if u < n else "Shared", v + 0.01 * u) for d, n in (("a", 5), ("b", 4)) for u in range(7) for m, v in (("m", 1.0), ("n", 2.0), ("o", 0.0))]
    got = BS.bootstrap_ranks_by_dataset(spark.createDataFrame(rows, "method string, dataset string, unit string, cls string, excess double"), 20).collect()
    assert len(got) == 20 * 2 * 3 and {r.dataset for r in got} == {"a"}
    assert all(r["rank"] == {"n": 1, "m": 2, "o": 3}[r.method] for r in got)


def test_compared_scorings(spark):
    rows = [("g", 0.1, 0.2, "x", "x"), ("g", 0.2, 0.1, "x", "y"), ("g", 0.9, 0.8, "y", "y"), ("g", None, 0.5, "x", "x"), ("h", 0.5, 0.5, "x", "x")]
    df = spark.createDataFrame(rows, "k string, u double, v double, a string, b string")
    got = {r.k: r for r in I.compare_scorings(df, "u", "v", "a", "b", ["x", "y"], ["k"]).collect()}
    assert math.isclose(got["g"].spearman, 0.5) and math.isclose(got["g"].agreement, 2 / 3) and math.isclose(got["g"].kappa, 0.4) and got["g"].n == 3
    assert (got["h"].agreement, got["h"].kappa, got["h"].spearman) == (1.0, None, None)


def test_metrics_on_expressed_genes(spark):
    pred, true, m = [0.1, 0.4, 9.0, -0.3], [0.2, 0.1, -9.0, 0.0], [5.0, 4.0, 0.0, 3.0]
    long = lambda v, c: spark.createDataFrame([("u", g, x) for g, x in enumerate(v)], f"unit string, g int, {c} double")
    r = T.expression_metrics(long(pred, "pred"), long(true, "delta"), long(m, "m").drop("unit"), ["unit"], 3).first()
    at = [0, 1, 3]
    p, t, c = (np.array(v)[at] for v in (pred, true, m))
    assert r.n_genes == 3 and math.isclose(r.l2, np.linalg.norm(p - t))
    assert math.isclose(r.pcc_delta, np.corrcoef(p, t)[0, 1]) and math.isclose(r.r_raw, np.corrcoef(c + p, c + t)[0, 1])


def test_additive_needs_all_components(spark):
    singles = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0)], "name string, g int, delta double")
    combos = spark.createDataFrame([("a+b",), ("a+c",), ("b + a",)], "combo string")
    assert {r.combo: r.pred for r in T.additive_predictor(singles, combos).collect()} == {"a+b": 3.0, "b + a": 3.0}


def test_arms_of_equal_size(spark):
    units = spark.createDataFrame([(k, "Specific" if k < 6 else "Shared") for k in range(20)], "unit int, label string")
    n = {(r.arm, r.subset): r["count"] for r in T.arms(units, 2).groupBy("arm", "subset").count().collect()}
    assert n == {("all", 0): 20, ("genuine", 0): 6, ("random_matched", 1): 6, ("random_matched", 2): 6, ("random_rest", 1): 6, ("random_rest", 2): 6}


def test_strategies(spark):
    df = spark.createDataFrame([(0.8, 0.25, "Specific"), (None, None, "Unreliable")], "rho double, phi double, label string")
    got = {s: [r[0] for r in df.select(T.strategy_weight(s, F.col("rho"), F.col("phi"), F.col("label"))).collect()] for s in ("all", "specific", "weight_rho", "weight_specificity", "reliable_then_specificity")}
    assert got["all"] == [1.0, 1.0] and got["specific"] == [1.0, 0.0] and got["weight_rho"] == [0.8, 0.0]
    assert got["weight_specificity"] == [0.75, 0.0] and got["reliable_then_specificity"] == [0.75, 0.0]


def test_running_score(spark):
    ranked = spark.createDataFrame([("u", g, float(10 - g)) for g in range(10)], "unit string, g int, v double")
    sets = spark.createDataFrame([("top", 0), ("top", 1), ("low", 8), ("low", 9)], "term string, g int")
    es = {r.term: r.es for r in G.running_score(ranked, sets, ["unit"], "v", [F.desc("v"), F.col("g")]).collect()}
    assert math.isclose(es["top"], 1.0) and math.isclose(es["low"], -1.0)
    assert G.rankable(ranked, ["unit"], "v", genes=11).count() == 0 and G.rankable(ranked, ["unit"], "v", genes=10).count() == 10


def test_symbols_keep_the_first(spark):
    genes = spark.createDataFrame([(0, "e1"), (1, "e2"), (2, "e3")], "g int, gene_id string")
    names = spark.createDataFrame([("e1", "S"), ("e2", "S")], "gene_id string, symbol string")
    assert [(r.g, r.symbol) for r in G.symbols(genes, names).collect()] == [(0, "S")]


@pytest.mark.parametrize("most", [32, 2048])
def test_energy_of_units_in_many_blocks(spark, monkeypatch, most):
    """Curves do not depend on how cells are dealt to blocks; draws of few cells are summed from their pairs."""
    rng = np.random.default_rng(8)
    monkeypatch.setattr(E.B, "CELLS", most)
    x = rng.normal(size=(900, 4)) + (np.arange(900) % 3 == 1)[:, None]
    x[1::90] = x[1]  # equal cells
    df = spark.createDataFrame([(k, k % 3, x[k].tolist()) for k in range(900)], "cell long, unit int, v array<double>")
    dist = lambda a, b: np.sqrt(((x[a][:, None] - x[b][None]) ** 2).sum(axis=2))
    md5 = lambda *k: hashlib.md5(":".join(map(str, k)).encode()).hexdigest()
    got = {(r.unit, r.n_half): r for r in E.reliability_curve(df, 3, [4, 64]).collect()}
    assert set(got) == {(u, n) for u in (1, 2) for n in (4, 64, -1)}
    for (unit, n), r in got.items():
        ids, ctrl, size = np.arange(unit, 900, 3), np.arange(0, 900, 3), 150 if n < 0 else n
        e = 2 * dist(ids, ctrl).mean() - dist(ids, ids).mean() - dist(ctrl, ctrl).mean()
        within = []
        for rep in (1, 2, 3):
            order = sorted(ids, key=lambda k: md5(rep, size, "e", k))
            a, b = order[:size], order[size : 2 * size]
            within.append(2 * dist(a, b).mean() - dist(a, a).mean() - dist(b, b).mean())
        assert math.isclose(r.e_between, e, rel_tol=1e-9) and math.isclose(r.e_within_med, np.median(within), rel_tol=1e-9)


def test_distances_of_near_cells():
    """A product of matrices loses what differences keep: equal cells are 0 apart, near ones right."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 8)) + 1000
    y = np.concatenate([x[:20], x[20:40] + 1e-7 * rng.normal(size=(20, 8)), rng.normal(size=(30, 8))])
    d, want = E.B.distances(x, y), np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    assert np.allclose(d, want, rtol=1e-9, atol=0) and (d[range(20), range(20)] == 0).all()


def test_draws_are_ranked_in_many_tasks(spark):
    """Cells become rows of draws in a fixed number of tasks, not in one for each unit."""
    rows = [(k, k % 2, g, float(k * g % 7)) for k in range(64) for g in range(3)]
    df = spark.createDataFrame(rows, "cell long, unit int, g int, x double")
    units = df.select("cell", "unit").distinct()
    for drawn in (R.split_half_r(df, units, 3, [4], 2), E.drawn_halves(units.where("unit = 1"), ["unit"], 3, [4], 4)):
        plan = drawn._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan
        # every ranking is dealt by draw (rep), not by the unit alone
        dealt = [plan[m.end() :].split("Exchange hashpartitioning(", 1)[1].split(")")[0] for m in re.finditer(r"Window \[row_number\(\)[^\n]*rep", plan)]
        assert dealt and all("rep#" in d for d in dealt)


def test_digests_and_cuts(spark):
    """Digests are MD5's; a draw's two ends name the halves that a ranking of all cells gives, though
    its cells lie in several rows of ids and no row stands for a cell and a draw."""
    cells = D.names(np.array([0, 7, 12, 99, 12345, 10**15, -5]))
    starts = ["1:max:5:t:", "100:fixed:512:c:", "7:" + "x" * 50 + ":"]
    made = D.digests(starts, cells)
    hexes = [[hashlib.md5(s.encode() + c).hexdigest() for c in cells.tolist()] for s in starts]
    assert [["".join(f"{v:016x}" for v in made[:, i, j].tolist()) for j in range(len(cells))] for i in range(3)] == hexes
    units = spark.range(3000).select(F.col("id").alias("cell"), (F.col("id") % 7 > 0).cast("int").alias("unit"))
    asked = spark.createDataFrame([(1, 8, 8, "s:8"), (1, -9, 1285, "s:-9"), (0, 214, 214, "s:214")], "unit int, size int, n int, salt string")
    rank = spark.createDataFrame([(u, s, n, k, r) for u, s, n, k in asked.collect() for r in (1, 2)], "unit int, size int, n long, salt string, rep int").join(units, "unit")
    want = W.halves(rank, ["unit", "size", "rep"], ["rep", "salt", "cell"], "cell", "n").withColumn("d", F.md5(F.concat_ws(":", "rep", "salt", "cell")))
    want = {(r.unit, r["size"], r.rep): (r.a, r.b) for r in want.groupBy("unit", "size", "rep").agg(F.max(F.when(F.col("half") == 1, F.col("d"))).alias("a"), F.max(F.when(F.col("half") == 2, F.col("d"))).alias("b")).collect()}
    some, D.IDS = D.IDS, 700
    try:
        cut = D.cuts(units, asked, ["unit"], 2)
        got = {(r.unit, r["size"], r.rep): (bytes(r.half).hex(), bytes(r.whole).hex()) for r in cut.collect()}
    finally:
        D.IDS = some
    assert got == want and len(got) == 6


def test_draws_are_not_rows(spark):
    """Only the digests near the two ends of a draw are ranked: no plan hashes a row for each cell,
    repeat and size."""
    rows = [(k, k % 2, g, float(k * g % 7)) for k in range(64) for g in range(3)]
    df = spark.createDataFrame(rows, "cell long, unit int, g int, x double")
    plan = R.split_half_r(df, df.select("cell", "unit").distinct(), 3, [4], 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number()" in plan and "md5(" not in plan
