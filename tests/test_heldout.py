"""Held-out experiments: splits, arms and their log, models on a shared Gram matrix."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rhoscope.operators import gram as M
from rhoscope.operators import holdout as H
from rhoscope.operators import retrain as T

BY, BASE = ["dataset"], ["dataset", "split_seed"]


@pytest.fixture(scope="module")
def units(spark):
    rows = [(d, 100 * d + u, "Specific" if u % 3 else "Shared", "double" if u % 5 == 0 else "single", 0.9 - 0.01 * u, 0.5) for d, n in ((1, 40), (2, 12)) for u in range(n)]
    rows += [(3, 300 + u, "Specific", "single", 0.9, 0.1) for u in range(30)] + [(4, 400 + u, "Specific" if u < 20 else None, "single" if u < 23 else "double", 0.9, 0.1) for u in range(30)]
    return spark.createDataFrame(rows, "dataset int, unit int, label string, kind string, rho double, cos_sim double")


def test_splits_and_arms_keep_test_units_out(units):
    members = H.splits(units, BY, 5)
    rows = members.collect()
    assert len(rows) == 5 * units.count()
    strata = {}
    for r in rows:
        strata.setdefault((r.dataset, r.split_seed, r.label, r.kind), []).append(r.split == "test")
    assert all(sum(s) == (max(1, round(0.25 * len(s))) if len(s) > 1 else 0) for s in strata.values())
    arms = H.training_arms(members, H.jobs(members, BASE, least_test=2), BASE, 7)
    got = arms.collect()
    split = {(r.dataset, r.split_seed, r.unit): r for r in rows}
    assert got and all(split[a.dataset, a.split_seed, a.unit].split == "train" for a in got)
    sets = {}
    for a in got:
        sets.setdefault((a.dataset, a.split_seed, a.arm, a.subset), []).append(a.unit)
    assert {k[2] for k in sets if k[0] == 1} == {"all", "genuine", "random_matched"}  # 26 of 40 are genuine: too few others of a kind
    for (d, s, arm, n), us in sets.items():
        assert len(set(us)) == len(us) and (n > 0) == arm.startswith("random")
        if arm == "random_matched":  # as many of each kind as the genuine arm
            kinds = lambda xs: sorted(split[d, s, u].kind for u in xs)  # noqa: B023, E731
            assert kinds(us) == kinds(sets[d, s, "genuine", 0])
    assert len({tuple(sorted(v)) for k, v in sets.items() if k[:3] == (1, 1, "random_matched")}) > 1


def test_log_says_why(units):
    members = H.splits(units, BY, 2)
    log = {(r.dataset, r.arm, r.reason) for r in H.skipped(H.jobs(members, BASE), BASE).collect()}
    assert log == {(1, "random_rest", "rest_kinds_too_few"), (2, None, "genuine_test_below_5"), (3, "random_rest", "rest_train_below_5"), (4, "random_rest", "rest_kinds_too_few")}
    few = members.where("unit % 2 = 0 or dataset = 3").where("dataset in (2, 3)")
    assert ("genuine_train_below_5", 2) in {(r.reason, r.dataset) for r in H.skipped(H.jobs(few, BASE), BASE).collect()}
    assert H.skipped(H.jobs(members.limit(0), BASE), BASE).count() == 0


def test_lattice_keeps_splits_and_shares_arms(units):
    members = H.splits(units.where("dataset = 1"), BY, 2)
    cells = H.lattice(members, [0.0, 0.1, 0.7], [0.6])
    keys = [*BASE, "rho_min", "cos_min"]
    assert cells.groupBy(*BASE, "unit").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    arms = H.training_arms(cells, H.jobs(cells, keys, least_test=2), keys, 4)
    sets, arm_of = H.distinct_arms(arms, BASE, keys)
    # Thresholds 0.0 and 0.1 label alike, so their arms are the same sets.
    of = {}
    for r in arm_of.collect():
        of.setdefault((r.split_seed, r.arm, r.subset), {})[r.rho_min] = r.set
    assert all(s[0.0] == s[0.1] for s in of.values())
    assert sets.select(*BASE, "set").distinct().count() == arm_of.select(*BASE, "set").distinct().count()


def data(seed, sizes=(14, 17), genes=20):
    """Units with vectors and targets: known, unknown, half known and known pairs."""
    rng = np.random.default_rng(seed)
    out = {}
    for d, n in enumerate(sizes):
        for u in range(n):
            target = [u % genes] if u % 7 else [[genes + 5], [3, 4], [2, genes + 1]][u // 7 % 3]
            out[d, u] = rng.normal(size=genes), rng.normal(size=genes), target
    return out


def frames(spark, vectors):
    values = [(d, u, g, float(e[g]), float(y[g]), g % 3 == 0) for (d, u), (e, y, _) in vectors.items() for g in range(len(e))]
    targets = [(d, u, g, len(t)) for (d, u), (_, _, t) in vectors.items() for g in t]
    return spark.createDataFrame(values, "dataset int, unit int, g int, m double, delta double, top_e boolean"), spark.createDataFrame(targets, "dataset int, unit int, g int, parts int")


def test_models_on_the_gram_matrix_equal_direct_fits(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 7)
    vectors = data(3)
    values, targets = frames(spark, vectors)
    rng = np.random.default_rng(4)
    arms = {(d, s, f"a{k}"): sorted(rng.choice(n, size, replace=False).tolist()) for d, n in ((0, 14), (1, 17)) for s in (1, 2) for k, size in enumerate((2, 12, 13, 14))}
    weights = {k: np.round(rng.uniform(-0.3, 2, len(us)), 3) for k, us in arms.items()}
    weights[0, 1, "a1"][:] = 0.0
    sets = spark.createDataFrame([(*k, u, float(w)) for k, us in arms.items() for u, w in zip(us, weights[k], strict=True)], "dataset int, split_seed int, set string, unit int, weight double")
    tests = spark.createDataFrame([(d, s, u) for d, n in ((0, 14), (1, 17)) for s in (1, 2) for u in range(n)], "dataset int, split_seed int, unit int")
    grams = M.gram(values, targets, BY)
    for weighted in (True, False):
        got = {}
        for r in M.gram_scores(grams, sets if weighted else sets.drop("weight"), tests, BY, BASE, batches=3).collect():
            got.setdefault((r.dataset, r.split_seed, r.set, r.model), {})[r.unit] = r
        want = 0
        for (d, s, name), us in arms.items():
            w = np.clip(weights[d, s, name], 0, None) if weighted else np.ones(len(us))
            expr, delta = (np.stack([vectors[d, u][k] for u in us]) for k in (0, 1))
            model = T.fit_bilinear(expr, delta, [vectors[d, u][2] for u in us], w)
            preds = {"mean": dict.fromkeys([u for e, u in vectors if e == d], w @ delta / w.sum()) if w.sum() else {}}
            preds["bilinear"] = {u: p for (e, u), (_, _, t) in vectors.items() if e == d and model and (p := model(t)) is not None}
            for kind, ps in preds.items():
                rows = got.get((d, s, name, kind), {})
                assert set(rows) == set(ps)
                want += len(ps)
                for u, p in ps.items():
                    y, mask = vectors[d, u][1], np.arange(20) % 3 == 0
                    near = {v: np.linalg.norm(p - vectors[d, v][1]) for v in ps}
                    r = rows[u]
                    pairs = [(r.l2, np.linalg.norm(p - y)), (r.pcc, np.corrcoef(p, y)[0, 1]), (r.l2_expr, np.linalg.norm((p - y)[mask])), (r.pcc_expr, np.corrcoef(p[mask], y[mask])[0, 1])]
                    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in pairs)
                    assert math.isclose(r.centroid, sum(v > near[u] + 1e-9 for v in near.values()) / (len(near) - 1), abs_tol=1e-12)
        assert want > 100 and any(k[3] == "bilinear" for k in got)


def test_mean_of_the_gram_matrix_equals_the_plan(spark):
    """The mean model by joins and aggregates, and by quadratic forms."""
    vectors = data(5, (9,))
    values, targets = frames(spark, vectors)
    sets = spark.createDataFrame([(0, 1, s, u) for s, us in (("x", [0, 1, 2, 3]), ("y", [2, 5, 6])) for u in us], "dataset int, split_seed int, set string, unit int")
    tests = spark.createDataFrame([(0, 1, u) for u in (7, 8)], "dataset int, split_seed int, unit int")
    facts = values.select("dataset", "unit", "g", "delta", (F.col("g") < 5).alias("top_t"), "top_e", F.col("g").cast("double").alias("m0"))
    key = lambda r: (r.set, r.unit)
    a = {key(r): r for r in H.mean_scores(sets, tests, facts, BY, BASE, 5).collect()}
    b = {key(r): r for r in M.gram_scores(M.gram(values, targets, BY), sets, tests, BY, BASE).where("model = 'mean'").collect()}
    assert set(a) == set(b) and len(a) == 4
    assert all(math.isclose(a[k][m], b[k][m], rel_tol=1e-9, abs_tol=1e-12) for k in a for m in M.METRICS)


def test_weighted_bilinear_model():
    """Weights of 1 are no weights, with unknown targets too; no weight where it counts is no model."""
    rng = np.random.default_rng(6)
    expr, delta = rng.normal(size=(20, 30)), rng.normal(size=(20, 30))
    target = [None, 99, *range(18)]
    plain, ones = T.fit_bilinear(expr, delta, target), T.fit_bilinear(expr, delta, target, np.ones(20))
    assert np.allclose(plain.bias, delta.mean(axis=0), atol=1e-12) and np.allclose(plain.bias, ones.bias, atol=1e-12) and np.allclose(plain(4), ones(4), atol=1e-12)
    only_unknown = np.array([1.0, 2.0] + [0.0] * 18)
    assert T.fit_bilinear(expr, delta, target, only_unknown) is None and T.fit_bilinear(expr, delta, target, np.zeros(20)) is None
    half = T.fit_bilinear(expr, delta, [[0, 99], *target[1:]])  # a half known combination counts with the gene that is known
    assert not np.allclose(half(4), plain(4)) and half([0, 99]) is None


def test_additive_model_needs_every_component_in_the_arm(spark):
    names = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "a+b"), (0, 4, "a+c"), (0, 5, "b + a"), (0, 6, "c")], "dataset int, unit int, name string")
    rng = np.random.default_rng(7)
    delta = {u: rng.normal(size=6) for u in range(1, 7)}
    facts = spark.createDataFrame([(0, u, g, float(v[g]), g < 3, g > 1, float(g)) for u, v in delta.items() for g in range(6)], "dataset int, unit int, g int, delta double, top_t boolean, top_e boolean, m0 double")
    sets = spark.createDataFrame([(0, 1, "x", 1), (0, 1, "x", 2), (0, 1, "y", 1)], "dataset int, split_seed int, set string, unit int")
    tests = spark.createDataFrame([(0, 1, u) for u in (3, 4, 5)], "dataset int, split_seed int, unit int")
    got = {(r.set, r.unit): r for r in H.additive_scores(sets, tests, facts, names, BY, BASE, 3).collect()}
    assert set(got) == {("x", 3), ("x", 5)}
    pred = delta[1] + delta[2]
    for (_, u), r in got.items():
        other = 8 - u
        assert math.isclose(r.l2, np.linalg.norm(pred - delta[u])) and math.isclose(r.pcc, np.corrcoef(pred, delta[u])[0, 1])
        assert math.isclose(r.mse_top, np.mean((pred - delta[u])[:3] ** 2)) and math.isclose(r.l2_expr, np.linalg.norm((pred - delta[u])[2:]))
        assert math.isclose(r.r_raw, np.corrcoef((pred + range(6))[2:], (delta[u] + range(6))[2:])[0, 1])
        assert r.centroid == float(np.linalg.norm(pred - delta[other]) > np.linalg.norm(pred - delta[u]))
        assert math.isclose(r.overlap_top, len(set(np.argsort(-abs(pred))[:3]) & {0, 1, 2}) / 3)
