"""Enrichment of large term libraries with a parametric null.

The permutation null of :mod:`enrichment` costs terms x permutations x genes.
Here the null depends on a ranking and a set size only: random sets of a few
anchor sizes are scored once, a gamma law is fitted by moments to the positive
and to the negative scores of each, and its parameters are interpolated over the
logarithm of the size.  A term then costs one score; its p is the tail of the
law of its size, its NES the normal quantile of that p.  More terms add no draws.

The draws of one ranking are arithmetic on arrays of its genes in one grouped
task (genes x 8 bytes x a batch of draws); rankings are dealt over the cluster.
"""

from __future__ import annotations

import math
import zlib
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .enrichment import rankable, running_score

#: Set sizes whose null is drawn; those beyond half of the genes are left out.
ANCHORS = (5, 8, 12, 20, 32, 50, 80, 130, 200, 320, 500)


def null_scores(values: np.ndarray, size: int, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Scores of random sets of ``size`` positions in a ranking (values in rank order)."""
    n, weight = len(values), np.abs(values)
    out = np.empty(draws)
    for at in range(0, draws, 64):
        k = min(64, draws - at)
        pos = np.sort(np.argpartition(rng.random((k, n)), size - 1, axis=1)[:, :size], axis=1)
        w = weight[pos]
        total = w.sum(axis=1, keepdims=True)
        hit = np.cumsum(np.divide(w, total, out=np.zeros_like(w), where=total > 0), axis=1)
        missed = (pos - np.arange(size)) / max(n - size, 1)
        top, low = (hit - missed).max(axis=1), (hit - np.where(total > 0, w / np.where(total > 0, total, 1), 0) - missed).min(axis=1)
        top = np.maximum(top, 0.0)
        low = np.minimum(low, 0.0)
        out[at : at + k] = np.where(np.round(top, 9) >= np.round(-low, 9), top, low)
    return out


def gamma_law(x: np.ndarray) -> tuple[float, float]:
    """Shape and scale by moments; a law of one point where there is too little to fit."""
    if len(x) < 3 or x.std() < 1e-9:
        return 1e6, (x.mean() if len(x) else 0.1) / 1e6
    m, v = x.mean(), x.var()
    return m * m / v, v / m


def gamma_tail(shape: float, x: float) -> float:
    """P(X >= x) of a gamma law with scale 1: a series below shape + 1, a continued
    fraction (Lentz) above; for very large shapes the cube-root normal law."""
    if x <= 0:
        return 1.0
    if shape > 1e4:
        return NormalDist().cdf(-((x / shape) ** (1 / 3) - 1 + 1 / (9 * shape)) * 3 * math.sqrt(shape))
    log = -x + shape * math.log(x) - math.lgamma(shape)
    if x < shape + 1:
        term = total = 1 / shape
        k = shape
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * math.exp(log))
    b = x + 1 - shape
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        a = -i * (i - shape)
        b += 2
        d = 1 / (a * d + b or 1e-300)
        c = b + a / c or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, math.exp(log) * h)


def laws(values: np.ndarray, draws: int, seed: int) -> list[tuple[int, float, float, float, float, float]]:
    """(size, share of positive scores, shape and scale of the positive, of the negative ones) for each anchor."""
    out = []
    for size in (a for a in ANCHORS if a <= max(ANCHORS[0], len(values) // 2)):
        s = null_scores(values, size, draws, np.random.default_rng((seed, size)))
        up = s >= 0
        out.append((size, (up.sum() + 1) / (draws + 2), *gamma_law(s[up]), *gamma_law(-s[~up])))
    return out


def tail(table: list[tuple], size: int, es: float) -> tuple[float, float]:
    """p among null scores of the sign of ``es``, and signed NES."""
    at = np.log([t[0] for t in table])
    take = lambda k, log: float((lambda y: math.exp(y) if log else y)(np.interp(math.log(size), at, [math.log(t[k]) if log else t[k] for t in table])))
    k = 2 if es >= 0 else 4
    p = max(gamma_tail(take(k, True), abs(es) / take(k + 1, True)), 1e-300)
    return p, math.copysign(-NormalDist().inv_cdf(p / 2) if p < 1 else 0.0, es)


def fast_enrich(ranked: DataFrame, sets: DataFrame, by: list[str], value: str, draws: int = 300, smallest: int = 5, largest: int = 500, genes: int = 200) -> DataFrame:
    """``by``, term, es, nes, p, fdr (Benjamini-Hochberg within the ranking), set_size.

    Rankings that mean nothing (:func:`enrichment.rankable`) have no rows, nor do
    terms without a gene in the ranking.  Draws follow from the ranking's key, so
    reruns agree.
    """
    size = sets.groupBy("term").agg(F.countDistinct("g").alias("k")).where(F.col("k").between(smallest, largest))
    ranked = rankable(ranked, by, value, genes)
    real = running_score(ranked, sets.join(size.select("term"), "term", "left_semi"), by, value, [F.desc(value), F.col("g")])
    real = real.toDF(*real.columns)  # new columns, as both sides come from one ranking
    kinds = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in by)

    def one(key: tuple, rows: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
        columns = [*by, "term", "es", "nes", "p", "set_size"]
        if not len(terms) or not len(rows):
            return pd.DataFrame(columns=columns)
        order = rows.sort_values([value, "g"], ascending=[False, True])
        table = laws(order[value].to_numpy(float), draws, zlib.crc32(repr(key).encode()))
        got = [tail(table, int(s), float(e)) for s, e in zip(terms["set_size"], terms["es"], strict=True)]
        out = terms.assign(p=[p for p, _ in got], nes=[z for _, z in got])
        return out[columns]

    scored = ranked.select(*by, "g", value).groupBy(*by).cogroup(real.groupBy(*by)).applyInPandas(one, f"{kinds}, term string, es double, nes double, p double, set_size long")
    w = Window.partitionBy(*by)
    down = w.orderBy(F.desc("p"), F.desc("term"))
    n = F.count(F.lit(1)).over(w)
    step = F.col("p") * n / (n - F.row_number().over(down) + 1)
    return scored.withColumn("fdr", F.least(F.lit(1.0), F.min(step).over(down.rowsBetween(Window.unboundedPreceding, 0)))).select(*by, "term", "es", "nes", "p", "fdr", "set_size")
