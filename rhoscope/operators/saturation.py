"""Sample-size model rho(N) = N tau^2 / (N tau^2 + 1)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S

LOW, HIGH, GRID = 1e-8, 10.0, 200


def usable(points: DataFrame, by: list[str]) -> DataFrame:
    """Finite rho > -1 clipped to [0, 0.999]; groups with two distinct sizes at least.

    A group is one unit's points, a few dozen rows: windows over it, no self-join.
    """
    p = points.where(F.col("rho").isNotNull() & (F.col("rho") > -1)).withColumn("rho", S.clip("rho", 0.0, 0.999))
    return p.withColumn("kd", _distinct_sizes(by)).where("kd >= 2").drop("kd")


def _distinct_sizes(by: list[str]):
    return F.size(F.collect_set("n_total").over(Window.partitionBy(*by)))


def fit_on_grid(points: DataFrame, by: list[str], steps: int = GRID) -> DataFrame:
    """Least squares over a logarithmic grid of tau^2 (about 11 % apart for 200 steps),
    wholly in SQL."""
    w = Window.partitionBy(*by)
    whole = ["sst", "n_points", "max_n", "min_n"]
    p = usable(points, by).withColumn("sst", F.var_pop("rho").over(w) * F.count("*").over(w)).withColumn("n_points", F.count("*").over(w))
    p = p.withColumn("max_n", F.max("n_total").over(w)).withColumn("min_n", F.min("n_total").over(w))
    tau = F.exp(F.log(F.lit(LOW)) + F.col("k") * ((np.log(HIGH) - np.log(LOW)) / steps))
    sse = p.select(*by, "n_total", "rho", *whole, F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k")).withColumn("tau_sq", tau)
    sse = sse.withColumn("e", F.col("rho") - S.rho_at("tau_sq", "n_total"))
    sse = sse.groupBy(*by, "k").agg(F.max("tau_sq").alias("tau_sq"), F.sum(F.col("e") * F.col("e")).alias("sse"), *[F.max(c).alias(c) for c in whole])
    out = sse.groupBy(*by).agg(F.min_by(F.struct("tau_sq", "sse", *whole), F.struct(F.round("sse", 12), "k")).alias("b")).select(*by, "b.*")
    return out.withColumn("fit_r2", F.when(F.col("sst") > 1e-12, 1 - F.col("sse") / F.col("sst")).otherwise(0.0)).drop("sse", "sst")


#: Points of the grid that brackets the least squares, and halvings of the bracket.
BRACKET, HALVINGS = 400, 60


def _sum(points: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda s, p: s + f(p))


def _tau(points: Column) -> Column:
    """tau^2 of the bounded one-parameter least squares over an array of (n, y).

    The best point of a grid over log tau^2 brackets the minimum; the sign of the
    derivative then halves the bracket a fixed number of times.
    """
    low, step = float(np.log(LOW)), float((np.log(HIGH) - np.log(LOW)) / (BRACKET - 1))
    rho = lambda p, t: p["n"] * F.exp(t) / (p["n"] * F.exp(t) + 1)
    sse = lambda t: _sum(points, lambda p: (p["y"] - rho(p, t)) * (p["y"] - rho(p, t)))
    rises = lambda t: _sum(points, lambda p: (p["y"] - rho(p, t)) * rho(p, t) * (1 - rho(p, t))) > 0
    at = lambda k: F.lit(low) + k * F.lit(step)
    best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(BRACKET - 1)), lambda k: F.struct(sse(at(k)).alias("e"), k.alias("k"))))["k"]
    first = F.struct(at(F.greatest(best - 1, F.lit(0))).alias("a"), at(F.least(best + 1, F.lit(BRACKET - 1))).alias("b"))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["a"] + acc["b"]) / 2
        up = rises(mid)
        return F.struct(F.when(up, mid).otherwise(acc["a"]).alias("a"), F.when(up, acc["b"]).otherwise(mid).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), first, halve, lambda acc: F.exp((acc["a"] + acc["b"]) / 2))


def fit(points: DataFrame, by: list[str]) -> DataFrame:
    """tau^2, R^2, N-weighted R^2 and N* of every group; a group is one unit's points,
    a few dozen, in one array."""
    point = F.struct(F.col("n_total").cast("double").alias("n"), F.col("rho").alias("y"))
    g = usable(points, by).groupBy(*by).agg(F.array_sort(F.collect_list(point)).alias("p"), F.count("*").alias("n_points"), F.max("n_total").cast("double").alias("max_n"), F.min("n_total").cast("double").alias("min_n"))
    g = g.withColumn("tau_sq", _tau(F.col("p"))).withColumn("all", _sum(F.col("p"), lambda p: p["n"]))
    mean, wmean = _sum(F.col("p"), lambda p: p["y"]) / F.col("n_points"), _sum(F.col("p"), lambda p: p["n"] * p["y"]) / F.col("all")
    g = g.withColumn("mean", mean).withColumn("wmean", wmean)
    e = lambda p: (p["y"] - S.rho_at("tau_sq", p["n"])) * (p["y"] - S.rho_at("tau_sq", p["n"]))
    off = lambda p, c: (p["y"] - F.col(c)) * (p["y"] - F.col(c))
    share = lambda err, tot: F.when(tot > 0, 1 - err / tot).otherwise(0.0)
    plain = share(_sum(F.col("p"), e), _sum(F.col("p"), lambda p: off(p, "mean")))
    weighted = share(_sum(F.col("p"), lambda p: p["n"] * e(p)), _sum(F.col("p"), lambda p: p["n"] * off(p, "wmean")))
    out = g.select(*by, "tau_sq", plain.alias("fit_r2"), weighted.alias("fit_r2_weighted"), "n_points", "max_n", "min_n")
    for q in (0.5, 0.7, 0.9):
        out = out.withColumn(f"n_star_{int(q * 100)}", S.n_for("tau_sq", q))
    return out


def pilot_points(points: DataFrame, by: list[str], pilots: list[int]) -> DataFrame:
    """Leave-future-out: the points up to each pilot size, where two distinct
    sizes are in and some are left out."""
    p = usable(points, by).withColumn("n_all", F.count("*").over(Window.partitionBy(*by)))
    grown = p.withColumn("pilot_n", F.explode(F.array(*map(F.lit, pilots)))).where(F.col("n_total") <= F.col("pilot_n"))
    keys = [*by, "pilot_n"]
    grown = grown.withColumn("k", F.count("*").over(Window.partitionBy(*keys))).withColumn("kd", _distinct_sizes(keys))
    return grown.where("kd >= 2 and k < n_all").drop("n_all", "k", "kd")


def accuracy(pairs: DataFrame, full: str, pilot: str, by: list[str]) -> DataFrame:
    """Correlation of logs and share within a factor of two."""
    ok = pairs.where((F.col(full) > 0) & (F.col(pilot) > 0)).withColumn("lf", F.log10(full)).withColumn("lp", F.log10(pilot))
    return ok.groupBy(*by).agg(S.pearson_or_null("lf", "lp").alias("log_r"), F.avg(((F.col(pilot) / F.col(full)).between(0.5, 2.0)).cast("int")).alias("within_2x"), F.count("*").alias("n"))


def elbow(curve: DataFrame, x: str, y: str) -> DataFrame:
    """Point where the normalised y is farthest above the normalised x."""
    lim = curve.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    gap = F.try_divide(F.col(y) - F.col("y0"), F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0))) - F.try_divide(F.col(x) - F.col("x0"), F.nullif((F.col("x1") - F.col("x0")).cast("double"), F.lit(0.0)))
    return curve.crossJoin(F.broadcast(lim)).withColumn("gap", F.round(gap, 9)).orderBy(F.desc_nulls_last("gap"), x).limit(1).select(x, y)


def power_flags(fits: DataFrame, n: str) -> DataFrame:
    out = fits.withColumn("rho_pred", S.rho_at("tau_sq", n))
    for q in (0.5, 0.7, 0.9):
        out = out.withColumn(f"powered_{int(q * 100)}", F.col(n) >= S.n_for("tau_sq", q))
    return out
