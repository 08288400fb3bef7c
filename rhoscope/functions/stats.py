"""Statistical expressions and window ranks.  Missing values are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c: str | Column) -> Column:
    return F.when(~F.isnan(_col(c)), _col(c))


def clip(c: str | Column, low: float, high: float) -> Column:
    return F.when(_col(c).isNotNull(), F.least(F.greatest(_col(c), F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, missing where b is 0."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def guarded_ratio(a: Column, b: Column, tolerance: float = 1e-3) -> Column:
    return F.when(F.abs(b) > tolerance, a / b)


def directed(a: Column, b: Column, higher_is_better: Column) -> Column:
    return F.when(higher_is_better, a - b).otherwise(b - a)


def pearson(x: str | Column, y: str | Column) -> Column:
    """Aggregate; 0 where a side is constant, within [-1, 1]."""
    x, y = _col(x), _col(y)
    r = F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))
    return F.least(F.greatest(F.coalesce(r, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))


def pearson_or_null(x: str | Column, y: str | Column) -> Column:
    x, y = _col(x), _col(y)
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def cosine(x: str | Column, y: str | Column) -> Column:
    """Aggregate; 0 where a norm vanishes."""
    x, y = _col(x), _col(y)
    nx, ny = F.sqrt(F.sum(x * x)), F.sqrt(F.sum(y * y))
    return F.when((nx < 1e-12) | (ny < 1e-12), F.lit(0.0)).otherwise(F.try_divide(F.sum(x * y), nx * ny))


def spearman_brown(r: str | Column) -> Column:
    """Reliability of the doubled sample, not below 0."""
    r = _col(r)
    return F.when(F.abs(1 + r) > 1e-10, F.greatest(F.try_divide(2 * r, 1 + r), F.lit(0.0))).otherwise(F.lit(0.0))


def ceiling(rho: str | Column) -> Column:
    return F.sqrt(F.greatest(_col(rho), F.lit(0.0)))


def rho_at(tau_sq: str | Column, n: str | Column) -> Column:
    t = _col(n) * _col(tau_sq)
    return t / (t + 1)


def n_for(tau_sq: str | Column, q: float) -> Column:
    """Sample size that reaches reliability q; infinite for tau^2 <= 0 or q >= 1."""
    if q >= 1:
        return F.lit(float("inf"))
    return F.when(_col(tau_sq) <= 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(q), _col(tau_sq) * (1 - q)))


def population_skew(x: str | Column) -> Column:
    x = _col(x)
    return F.when(F.stddev_pop(x) > 1e-10, F.skewness(x)).otherwise(F.lit(0.0))


def sem(x: str | Column) -> Column:
    return F.try_divide(F.stddev_samp(x), F.sqrt(F.count(x)))


def rank_average(order: Column, value: str | Column, by: list[str]) -> Column:
    """Ranks with ties averaged; null values get none."""
    w = Window.partitionBy(*by).orderBy(order)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, _col(value)))
    return F.when(_col(value).isNotNull(), F.rank().over(w) + (ties - 1) / 2)


def rank_truncated(order: Column, value: str | Column, by: list[str]) -> Column:
    return F.floor(rank_average(order, value, by)).cast("long")


def rank_min(order: Column, value: str | Column, by: list[str]) -> Column:
    return F.when(_col(value).isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(order)).cast("long"))


def over(by: list[str], *order: Column) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def hist_bin(x: str | Column, low: float, high: float, bins: int) -> Column:
    """Index of a fixed-width bin, the last one closed on the right; null outside."""
    x = _col(x)
    k = F.floor((x - low) * bins / (high - low))
    return F.when((x >= low) & (x <= high), F.least(k, F.lit(bins - 1))).cast("long")


def edge_bin(x: str | Column, edges: list[float]) -> Column:
    """Index of the bin [edge, next edge) of sorted edges, found by halving the array of
    edges; the last bin is closed on the right; null outside."""
    x, last = _col(x), len(edges) - 1
    e = F.array(*map(F.lit, edges))
    whole = F.struct(F.lit(0).alias("a"), F.lit(last).alias("b"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["a"] + acc["b"]) / 2).cast("int")
        right = F.get(e, mid) <= x
        return F.struct(F.when(right, mid).otherwise(acc["a"]).alias("a"), F.when(right, acc["b"]).otherwise(mid).alias("b"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, last.bit_length()))), whole, halve, lambda acc: acc["a"])
    return F.when((x >= edges[0]) & (x <= edges[-1]), F.least(found, F.lit(last - 1))).cast("long")


def labelled_bin(x: str | Column, edges: list[float]) -> Column:
    """Right-closed bins (a, b]; the first includes its lower edge, the last is open-ended."""
    x = _col(x)
    out = F.when((x >= edges[0]) & (x <= edges[1]), f"{edges[0]:g}-{edges[1]:g}")
    for a, b in zip(edges[1:], edges[2:], strict=False):
        out = out.when((x > a) & (x <= b), f"{a:g}-{b:g}")
    return out.when(x > edges[-1], f">{edges[-1]:g}")
