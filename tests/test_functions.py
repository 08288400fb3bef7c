"""Keys, statistics and labels on hand-computed frames: nulls, ties, empty groups."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from rhoscope.functions import keys as K
from rhoscope.functions import stats as S
from rhoscope.operators import triage as C


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_keys(spark):
    df = spark.createDataFrame([("A+B",), ("B+A",), (" A + control",), ("control",), (None,), ("x_12",)], "l string")
    assert values(df, K.pair_key("l"))[:2] == [("A+B",), ("A+B",)]
    assert [v[0] for v in values(df, K.label_type("l"))][:4] == ["double", "double", "single", "control"]
    assert values(df, K.strip_fold("l"))[5] == ("x",)
    assert values(df.limit(1), K.normalise(F.lit("Pat-1 a.B"))) == [("pat1_a_b",)]
    assert values(df.limit(1), K.strip_control(F.lit("G+ctrl")), K.clean(F.lit("  q "))) == [("G", "q")]
    assert K.first_present(df, ["z", "l"]) == "l"
    with pytest.raises(KeyError):
        K.first_present(df, ["z"])


def test_vocabulary_and_scope(spark):
    df = spark.createDataFrame([("genuine", "SciPlex3"), ("trivial", "x"), ("other", None)], "c string, d string")
    assert values(df, K.vocabulary("c", K.CLASS_NAMES)) == [("Specific",), ("Shared",), (None,)]
    assert values(df, K.vocabulary("c", K.CLASS_NAMES, "same"))[2] == ("other",)
    assert values(df, K.scope("d", F.lit("genetic"))) == [("chemical",), ("genetic",), ("genetic",)]
    assert values(spark.createDataFrame([("NegCtrl1",), ("a_posA",), ("GENE",)], "g string"), K.is_guide_label("g")) == [(True,), (True,), (False,)]


def test_ratios(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 0.0005), (3.0, 2.0), (None, 1.0)], "a double, b double")
    a, b = F.col("a"), F.col("b")
    assert values(df, S.ratio(a, b)) == [(None,), (2000.0,), (1.5,), (None,)]
    assert values(df, S.guarded_ratio(a, b)) == [(None,), (None,), (1.5,), (None,)]
    assert values(df, S.directed(a, b, F.lit(False))) == [(-1.0,), (-0.9995,), (-1.0,), (None,)]
    assert values(df, S.clip("a", 0.0, 2.0)) == [(1.0,), (1.0,), (2.0,), (None,)]


def test_model(spark):
    df = spark.createDataFrame([(0.5,), (-1.0,), (1.0,), (-0.3,)], "r double")
    assert [round(v[0], 6) for v in values(df, S.spearman_brown("r"))] == [0.666667, 0.0, 1.0, 0.0]
    t = spark.createDataFrame([(0.25, 4), (0.0, 4)], "t double, n int")
    assert values(t, S.rho_at("t", "n"), S.n_for("t", 0.5)) == [(0.5, 4.0), (0.0, math.inf)]
    assert values(t, S.n_for("t", 1.0))[0] == (math.inf,)


def test_constant_vectors_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(S.pearson("x", "y")).first()[0] == 0.0
    assert df.agg(S.pearson_or_null("x", "y")).first()[0] is None
    assert df.agg(S.cosine("x", F.lit(0.0))).first()[0] == 0.0
    assert df.agg(S.population_skew("x")).first()[0] == 0.0


def test_ranks(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 2.0), ("d", 1.0), ("e", None)], "k string, v double")
    order = F.desc_nulls_last("v")
    out = df.select("k", S.rank_average(order, "v", []).alias("a"), S.rank_truncated(order, "v", []).alias("t"), S.rank_min(order, "v", []).alias("m"))
    assert {r.k: (r.a, r.t, r.m) for r in out.collect()} == {"a": (1.0, 1, 1), "b": (2.5, 2, 2), "c": (2.5, 2, 2), "d": (4.0, 4, 4), "e": (None, None, None)}


def test_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (1.0,), (1.1,), (None,)], "x double")
    assert values(df, S.hist_bin("x", 0.0, 1.0, 20)) == [(0,), (1,), (19,), (None,), (None,)]
    n = spark.createDataFrame([(0,), (50,), (51,), (501,)], "n int")
    assert values(n, S.labelled_bin("n", [0, 50, 500])) == [("0-50",), ("0-50",), ("50-500",), (">500",)]


def test_three_rules_for_missing_values(spark):
    df = spark.createDataFrame([(None, None), (0.9, None), (0.9, 0.9), (0.9, 0.1), (0.1, 0.9)], "rho double, cos double")
    rho, cos = F.col("rho"), F.col("cos")
    assert [v[0] for v in values(df, C.label(rho, cos))] == ["Unreliable", "Specific", "Shared", "Specific", "Unreliable"]
    assert [v[0] for v in values(df, C.label_alternative(rho, cos, 0.5, 0.7))] == ["Specific", "Specific", "Shared", "Specific", "Unreliable"]
    assert [v[0] for v in values(df, C.label_scalar(rho, cos))] == ["Unreliable", "Shared", "Shared", "Specific", "Unreliable"]
    assert [v[0] for v in values(df, C.energy_label(rho, cos))] == ["Unreliable", "Specific", "Shared", "Specific", "Shared"]


def test_absent_classes_are_zero(spark):
    df = spark.createDataFrame([("d", "Shared"), ("d", "Shared")], "d string, label string")
    assert values(C.class_crosstab(df, "d"), "frac_unreliable", "frac_shared", "frac_specific") == [(0.0, 1.0, 0.0)]
    shares = {r.d: (r.n_total, r.n_shared, r.frac_specific) for r in C.class_shares(df, "d").collect()}
    assert shares == {"all": (2, 2, 0.0), "d": (2, 2, 0.0)}
