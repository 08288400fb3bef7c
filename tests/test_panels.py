"""Panels and fits with labels, stability, densities, terms and named files, on small cases."""

import math

import numpy as np
import pytest

from rhoscope.operators import density as D
from rhoscope.operators import panels as J
from rhoscope.sources import readers as IO


def test_panel_rows_and_what_is_left_out(spark):
    panel = spark.createDataFrame(
        [("one", "A+ctrl", 0.5), ("one", "A", 0.7), ("one", "B", 0.1), ("other", "A", 0.2), ("one", None, 0.3), ("one", "Z", None), (None, "A", 1.0)],
        "dataset_name string, perturbation string, r2_delta double",
    )
    triage = spark.createDataFrame([("One", "A", 0.64, "x"), ("One", "A", 0.25, "y"), ("One", "Z", 0.0, "z"), ("One", None, 0.9, "n")], "dataset string, perturbation string, rho double, label string")
    got = sorted((r.perturbation, r.label, r.ce if r.ce is None else round(r.ce, 9)) for r in J.join_panel(panel, triage, {"one": "One"}, ["label"]).collect())
    assert got == [("A", "x", 0.625), ("A", "x", 0.875), ("Z", "z", None)]
    kept = {r.dataset_name: (r.n_rows, r.n_kept, r.mapped) for r in J.panel_retention(panel, triage, {"one": "One"}).collect()}
    assert kept == {"one": (5, 3, True), "other": (1, 0, False), None: (1, 0, False)}
    assert J.join_panel(panel.limit(0), triage, {"one": "One"}, ["label"]).count() == 0


def test_fits_without_label_are_unknown(spark):
    fits = spark.createDataFrame([("d", 1, 0.1), ("d", 2, 0.2), ("d", 3, 0.3)], "dataset string, unit int, tau_sq double")
    labels = spark.createDataFrame([("d", 1, "Shared", 0.8), ("d", 1, "Shared", 0.9), ("d", 2, None, 0.1)], "dataset string, unit int, label string, cos_sim double")
    got = {r.unit: (r.label, r.cos_sim, r.frac_systematic_var) for r in J.join_fits(fits, labels, ["dataset", "unit"], ["cos_sim"]).collect()}
    assert got == {1: ("Shared", 0.8, None), 2: ("unknown", 0.1, None), 3: ("unknown", None, None)}
    none = J.join_fits(fits, None, ["dataset", "unit"], [])
    assert {(r.label, r.cos_sim) for r in none.collect()} == {("unknown", None)} and none.count() == 3


def _scores(rng, datasets, splits, units, subsets):
    rows = []
    for d in range(datasets):
        for s in range(splits):
            for u in range(units):
                rows.append((d, s, "genuine", 0, u, float(rng.normal(0.3, 0.2)), float(rng.normal(1, 0.2))))
                rows += [(d, s, "random_matched", k, u, float(rng.normal(0.1, 0.2)), float(rng.normal(1.1, 0.2))) for k in range(1, subsets + 1) if (u + k) % 5]
    return rows


def test_stability_against_loops(spark):
    rows = _scores(np.random.default_rng(3), 6, 2, 4, 7)
    df = spark.createDataFrame(rows, "dataset int, split_seed int, arm string, subset int, unit int, pcc double, l2 double")
    got = {(r.dataset, r.split_seed, r.metric): r for r in J.subset_stability(df, "genuine", "random_matched", ["dataset", "split_seed"], "unit", {"pcc": True, "l2": False}).collect()}
    splits = {(r.split_seed, r.metric): r for r in J.split_stability(df, "genuine", "random_matched", "split_seed", "dataset", "unit", {"pcc": True, "l2": False}).collect()}
    own = {(d, s, u): (p, e) for d, s, a, _, u, p, e in rows if a == "genuine"}
    for at, (metric, sign) in enumerate([("pcc", 1), ("l2", -1)]):
        for s in range(2):
            means = []
            for d in range(6):
                diff = {(k, u): sign * (own[d, s, u][at] - v[at]) for dd, ss, a, k, u, *v in rows if (dd, ss, a) == (d, s, "random_matched")}
                subs = [np.mean([v for (k, _), v in diff.items() if k == j]) for j in range(1, 8)]
                r = got[d, s, metric]
                assert r.n_subsets == 7 and r.pct_winning == pytest.approx(100 * np.mean(np.array(subs) > 0))
                assert [r.mean_effect, r.std_effect, r.min_effect, r.max_effect] == pytest.approx([np.mean(subs), np.std(subs), min(subs), max(subs)])
                means.append(np.mean([np.mean([v for (_, w), v in diff.items() if w == u]) for u in range(4)]))
            r = splits[s, metric]
            assert (r.n_datasets, r.n_pos) == (6, sum(m > 0 for m in means))
            assert [r.median_effect, r.mean_effect] == pytest.approx([np.median(means), np.mean(means)])
            ranks = np.argsort(np.argsort(np.abs(means))) + 1
            w = min(ranks[np.array(means) > 0].sum(), ranks[np.array(means) < 0].sum())
            ways = sum(sum(k for k in range(1, 7) if m >> (k - 1) & 1) <= w for m in range(64))
            assert r.p_wilcoxon == pytest.approx(min(1, 2 * ways / 64))


def test_specific_terms_take_the_commonest_then_drop_shared(spark):
    rows = [(u, "specific", f"t{k}", 0.01) for k in range(6) for u in range(6 - k)] + [(0, "shared", "t1", 0.01), (0, "shared", "t9", 0.01), (9, "specific", "t5", 0.2)]
    df = spark.createDataFrame(rows, "unit int, side string, term string, fdr double")
    top = [(r.term, r.n_units, r.place) for r in J.specific_terms(df, "side", most=4, shown=2).orderBy("place").collect()]
    assert top == [("t0", 6, 1), ("t2", 4, 2)]
    assert [r.term for r in J.specific_terms(df, "side", most=4).orderBy("place").collect()] == ["t0", "t2", "t3"]  # t1 counts among the four
    assert J.specific_terms(df.limit(0), "side").count() == 0


def _direct(x, y):
    """The sum over all pairs with the covariance times n^(-1/3)."""
    p = np.vstack([x, y])
    h = np.cov(p) * len(x) ** (-1 / 3)
    diff = p[:, :, None] - p[:, None, :]
    e = np.einsum("iab,ij,jab->ab", diff, np.linalg.inv(h), diff)
    return np.exp(-e / 2).sum(1) / (len(x) * 2 * math.pi * math.sqrt(np.linalg.det(h)))


def test_density_near_the_direct_sum(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for g, n in (("a", 400), (None, 150)):
        x = np.concatenate([rng.normal(0, 1, n // 2), rng.normal(6, 0.3, n - n // 2)])
        y = 0.8 * x + rng.normal(0, 0.5, n)
        x[:20], y[:20] = x[0], y[0]  # ties
        want[g] = _direct(x, y)
        rows += [(g, k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "g string, k int, x double, y double")
    got = {(r.g, r.k): r.density for r in D.density_2d(df, "x", "y", ["g"]).collect()}
    assert len(got) == len(rows)
    for g, w in want.items():
        assert max(abs(got[g, k] - v) for k, v in enumerate(w)) < 0.02 * w.max()


def test_density_of_points_without_one(spark):
    nan = float("nan")
    rows = [("few", 1.0, 2.0), ("few", 2.0, 1.0), *[("line", float(k), 2.0 * k) for k in range(5)], *[("ok", float(k % 3), float(k // 3)) for k in range(9)], ("ok", None, 1.0), ("ok", nan, 1.0), ("ok", 1.0, float("inf"))]
    got = [(r.g, r.x, r.density) for r in D.density_2d(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()]
    assert len(got) == len(rows)
    assert sum(d is not None for g, _, d in got if g == "ok") == 9 and all(d is None for g, _, d in got if g != "ok")
    assert D.density_2d(spark.createDataFrame([], "x double, y double"), "x", "y", []).count() == 0


def test_stems_of_files_that_are_folders(spark, tmp_path):
    IO.write_csv(spark.range(6).repartition(3), f"{tmp_path}/one.csv")
    IO.write_csv(spark.range(1), f"{tmp_path}/one_summary.csv")
    (tmp_path / "two.csv").write_text("id\n7\n")
    got = sorted((r.dataset, r.id) for r in IO.read_stems(spark, f"{tmp_path}/*.csv", "id long").collect())
    assert got == [*[("one", k) for k in range(6)], ("two", 7)]
