"""Agreement, rank correlation and paired tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa (unweighted), agreement and n; missing labels drop."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    n = cells.agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    pa, pb = cells.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("na")), cells.groupBy(F.col("b").alias("k")).agg(F.sum("n").alias("nb"))
    chance = pa.join(pb, "k").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("cross"))
    po, pe = F.col("same") / F.col("total"), F.col("cross") / (F.col("total") * F.col("total"))
    out = n.crossJoin(chance)  # one row each
    return out.select(po.alias("agreement"), F.try_divide(po - pe, F.nullif(1 - pe, F.lit(0.0))).alias("kappa"), F.col("total").alias("n"))


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson of average ranks; rows with a missing side drop."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.withColumn("rx", S.rank_average(F.asc(x), x, by)).withColumn("ry", S.rank_average(F.asc(y), y, by))
    return d.groupBy(*by).agg(S.pearson_or_null("rx", "ry").alias("spearman"), F.count("*").alias("n"))


def compare_scorings(df: DataFrame, x: str, y: str, a: str, b: str, classes: Sequence[str], by: list[str]) -> DataFrame:
    """Two scorings ``x`` and ``y`` with their labels ``a`` and ``b``: Spearman,
    agreement, kappa and n of each group.  Rows with a missing score drop; the
    classes are known, so all comes from one aggregation."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.withColumn("rx", S.rank_average(F.asc(x), x, by)).withColumn("ry", S.rank_average(F.asc(y), y, by))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    cross = sum((count(F.col(a) == k) * count(F.col(b) == k) for k in classes), F.lit(0))
    out = d.groupBy(*by).agg(S.pearson_or_null("rx", "ry").alias("spearman"), count(F.col(a) == F.col(b)).alias("same"), cross.alias("cross"), F.count("*").alias("n"))
    po, pe = F.col("same") / F.col("n"), F.col("cross") / (F.col("n") * F.col("n"))
    return out.select(*by, "spearman", po.alias("agreement"), F.try_divide(po - pe, F.nullif(1 - pe, F.lit(0.0))).alias("kappa"), "n")


def sign_test(df: DataFrame, by: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Two-sided binomial p of the signs of values beyond the tolerance, in SQL.

    The binomial tail is summed from logarithms of factorials over 0..k.
    """
    d = df.where(F.abs(value) >= tolerance).groupBy(*by).agg(F.count("*").alias("n"), F.sum((F.col(value) > 0).cast("int")).alias("n_pos"))
    k = F.least(F.col("n_pos"), F.col("n") - F.col("n_pos"))
    log_fact = lambda m: F.aggregate(F.sequence(F.lit(0), m), F.lit(0.0), lambda s, i: s + F.log(F.greatest(i, F.lit(1)).cast("double")))
    term = lambda i: F.exp(log_fact(F.col("n")) - log_fact(i) - log_fact(F.col("n") - i) - F.col("n") * math.log(2))
    tail = F.aggregate(F.transform(F.sequence(F.lit(0).cast("long"), k), term), F.lit(0.0), lambda s, p: s + p)
    return d.withColumn("p_sign", F.least(F.lit(1.0), 2 * tail))


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0: a series of positive terms below 2.5,
    beyond it a continued fraction from the inside out."""
    sq = x * x
    term = lambda acc, i: F.struct((acc["t"] * 2 * sq / (2 * i + 1)).alias("t"), (acc["s"] + acc["t"] * 2 * sq / (2 * i + 1)).alias("s"))
    one = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), one, term, lambda acc: acc["s"])
    inner = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda acc, i: (i / 2.0) / (x + acc))
    root = math.sqrt(math.pi)
    return F.when(x < 2.5, 1 - 2 / root * F.exp(-sq) * x * series).otherwise(F.exp(-sq) / (root * (x + inner)))


def signed_rank_p(n: Column, w: Column) -> Column:
    """Exact two-sided p of a smaller rank sum ``w`` among ``n`` ranks without ties: the
    sets of ranks for each sum are counted by a fold over the ranks."""
    none = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(n * (n + 1) / 2)), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    more = lambda ways, k: F.transform(ways, lambda c, i: c + F.when(i >= k, F.get(ways, i - k.cast("int"))).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1).cast("long"), n), none, more)
    upto = F.aggregate(F.slice(ways, F.lit(1), F.floor(w).cast("int") + 1), F.lit(0.0), lambda s, c: s + c)
    return F.least(F.lit(1.0), 2 * upto / F.pow(F.lit(2.0), n))


def wilcoxon(df: DataFrame, by: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Signed-rank test of each group: ``n``, ``w`` and two-sided ``p_wilcoxon``.

    Exact for up to 50 values without ties or zeros, else the normal law with tie
    correction; zeros are not ranked; missing for fewer than five values, or if all are 0.
    """
    d = df.where(F.abs(value) >= tolerance).withColumn("a", F.abs(value))
    real, w = F.col("a") > 0, Window.partitionBy(*by, "a")
    d = d.withColumn("r", F.when(real, S.rank_average(F.asc("a"), "a", [*by, real]))).withColumn("t", F.count(F.lit(1)).over(w))
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("r"))), F.lit(0.0))
    each = F.sum(F.when(real, F.col("t") * F.col("t") - 1)).cast("double")  # t of them have t^2 - 1: t^3 - t
    g = d.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(real).alias("m"), F.least(side(F.col(value) > 0), side(F.col(value) < 0)).alias("w"), each.alias("ties"))
    m, ties = F.col("m"), F.col("ties")
    mean, var = m * (m + 1) / 4, m * (m + 1) * (2 * m + 1) / 24 - ties / 48
    z = F.when(var > 0, F.abs(F.col("w") - mean) / F.sqrt(var)).otherwise(0.0)
    exact = (m <= 50) & (ties == 0) & (m == F.col("n"))
    p = F.when(exact, signed_rank_p(F.when(exact, m).otherwise(F.lit(1).cast("long")), F.col("w"))).otherwise(F.least(F.lit(1.0), erfc(z / math.sqrt(2))))
    told = (F.col("n") >= 5) & (m > 0)
    return g.select(*by, "n", F.when(told, F.col("w")).alias("w"), F.when(told, p).alias("p_wilcoxon"))


def wilcoxon_statistic(df: DataFrame, by: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """The statistic alone, in SQL: the smaller sum of signed ranks."""
    d = df.where(F.abs(value) >= tolerance).withColumn("a", F.abs(value))
    d = d.withColumn("r", S.rank_average(F.asc("a"), "a", by))
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("r"))), F.lit(0.0))
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.least(side(F.col(value) > 0), side(F.col(value) < 0)).alias("w"))


def icc(df: DataFrame, unit: str, value: str) -> DataFrame:
    """Between = variance of unit means, within = mean of unit variances (population)."""
    per = df.groupBy(unit).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.count("*").alias("k")).where("k > 1")
    b, w = F.var_pop("m"), F.avg("v")
    return per.agg(b.alias("var_between"), w.alias("var_within"), F.try_divide(b, F.nullif(b + w, F.lit(0.0))).alias("icc"), F.count("*").alias("n_units"))


def within_two_fold(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0.0))).between(0.5, 2.0)
