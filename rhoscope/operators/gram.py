"""Models fitted on one shared Gram matrix of units.

Expression is centred per unit over its genes, so dot products of two units do
not depend on who else is in an arm.  They are summed once, by blocks of genes;
an arm then takes the rows and columns of its units, and no arm carries vectors
of genes.  Every prediction is a combination of training units, ``sum a_i x_i +
sum b_i y_i`` (x centred expression, y delta), so that norms, distances and
correlations with a truth are quadratic forms in the same matrices.

With n units of a dataset, the matrices have 8 n^2 numbers; they are handed to
``batches`` tasks, each of which scores its share of the arms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .retrain import RANK, RIDGE

#: Genes of a block: a task holds units x BLOCK numbers.
BLOCK = 256
_SUMS = ["k", "c", "d", "ke", "ce", "de"]
_ONES = ["sy", "sxe", "sye", "genes", "genes_e"]


def _kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


def gram(values: DataFrame, targets: DataFrame, by: list[str]) -> DataFrame:
    """One row per (by, unit), in order ``i`` of the unit within ``by``: dot products
    with all units over all genes (``k`` x.x, ``c`` x.y, ``d`` y.y) and over the
    marked genes (``ke``, ``ce``, ``de``), sums, and ``r``, the mean centred
    expression of every unit at this unit's target genes (null without known ones).

    ``values``: by, unit, g, m, delta, top_e.  ``targets``: by, unit, g (one row per
    component; a gene that is not in ``values`` is not known), parts.
    """
    mean = values.groupBy(*by, "unit").agg(F.avg("m").alias("mean"))
    place = mean.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("unit")) - 1)
    x = values.join(place, [*by, "unit"]).select(*by, "unit", "i", "g", (F.col("m") - F.col("mean")).alias("x"), F.col("delta").alias("y"), "top_e")
    arrays = ", ".join(f"{c} array<double>" for c in _SUMS)
    numbers = ", ".join(f"{c} double" for c in _ONES)

    def block(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        units = np.sort(df["i"].unique())
        wide = lambda c: df.pivot(index="i", columns="g", values=c).reindex(units).fillna(0.0).to_numpy(float)
        vx, vy, top = wide("x"), wide("y"), wide("top_e").max(axis=0) > 0
        ex, ey = vx[:, top], vy[:, top]
        size = units.max() + 1 if len(units) else 0
        full = np.zeros((6, len(units), size))
        for at, m in enumerate((vx @ vx.T, vx @ vy.T, vy @ vy.T, ex @ ex.T, ex @ ey.T, ey @ ey.T)):
            full[at][:, units] = m
        out = {c: key[k] for k, c in enumerate(by)} | {"i": units} | {c: list(full[at]) for at, c in enumerate(_SUMS)}
        ones = {"sy": vy.sum(axis=1), "sxe": ex.sum(axis=1), "sye": ey.sum(axis=1), "genes": float(vx.shape[1]), "genes_e": float(top.sum())}
        return pd.DataFrame(out | ones)

    parts = x.withColumn("block", F.floor(F.col("g") / BLOCK)).groupBy(*by, "block").applyInPandas(block, f"{_kinds(values, by)}, i int, {arrays}, {numbers}")

    def total(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        size = max(map(len, df["k"]))
        row = {c: key[k] for k, c in enumerate([*by, "i"])}
        row |= {c: [np.sum([np.pad(v, (0, size - len(v))) for v in df[c]], axis=0)] for c in _SUMS} | {c: df[c].sum() for c in _ONES}
        return pd.DataFrame(row)

    sums = parts.groupBy(*by, "i").applyInPandas(total, f"{_kinds(values, by)}, i int, {arrays}, {numbers}")
    at = targets.join(x.select(*by, "i", "g", "x"), [*by, "g"]).groupBy(*by, "unit", "i").agg(F.avg("x").alias("r"))
    reach = at.groupBy(*by, "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "r"))), lambda s: s["r"]).alias("r"))
    single = targets.groupBy(*by, "unit").agg((F.max("parts") == 1).alias("single"))
    return sums.join(place.drop("mean"), [*by, "i"]).join(reach, [*by, "unit"], "left").join(single, [*by, "unit"], "left")


@dataclass
class Matrices:
    """The matrices of one dataset."""

    at: dict  # unit -> place
    m: dict[str, np.ndarray]
    reach: np.ndarray  # nan without a known target
    single: np.ndarray

    @classmethod
    def of(cls, df: pd.DataFrame) -> Matrices:
        df = df.sort_values("i")
        n = len(df)
        square = lambda c: np.stack([np.pad(np.asarray(v, float), (0, n - len(v))) for v in df[c]])
        reach = np.stack([np.full(n, np.nan) if v is None else np.asarray(v, float) for v in df["r"]])
        m = {c: square(c) for c in _SUMS} | {c: df[c].to_numpy(float) for c in _ONES}
        return cls({u: k for k, u in enumerate(df["unit"])}, m, reach, df["single"].fillna(False).to_numpy(bool))


def mean_weights(w: np.ndarray) -> np.ndarray | None:
    return w / w.sum() if w.sum() > 0 else None


def bilinear_weights(g: Matrices, units: np.ndarray, w: np.ndarray, tests: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Weights (tests x units) of centred expressions and the units' weights of deltas
    in the predictions of the reduced-rank ridge model, or None without a model."""
    n, genes = len(units), g.m["genes"][0]
    rank = int(min(RANK, n - 1, genes - 1))
    used = ~np.isnan(g.reach[units, 0])
    if rank < 1 or used.sum() <= rank or w[used].sum() <= 0:
        return None
    size, axes = np.linalg.eigh(g.m["k"][np.ix_(units, units)])
    size, axes = size[::-1][:rank], axes[:, ::-1][:, :rank]
    places = g.reach[np.ix_(units[used], units)] @ axes
    bias, scaled = w / w.sum(), w[used] / w[used].mean()
    weighted = places * scaled[:, None]
    cross = g.m["c"][np.ix_(units, units)]
    moved = (axes.T @ (cross[:, used] - (cross @ bias)[:, None]) @ weighted) / (size + RIDGE)[:, None]
    link = np.linalg.solve(places.T @ weighted + RIDGE * np.eye(rank), moved.T).T
    return (g.reach[np.ix_(tests, units)] @ axes) @ link.T @ axes.T, bias


def _fit(pp: np.ndarray, py: np.ndarray, yy: np.ndarray, sp: np.ndarray, sy: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    """Distance and correlation from squares, products and sums over n genes."""
    cov, vp, vy = py / n - sp * sy / n**2, pp / n - (sp / n) ** 2, yy / n - (sy / n) ** 2
    flat = (vp < 1e-24) | (vy < 1e-24)
    return np.sqrt(np.maximum(pp - 2 * py + yy, 0)), np.where(flat, np.nan, cov / np.sqrt(np.where(flat, 1, vp * vy)))


def score(g: Matrices, units: np.ndarray, a: np.ndarray, b: np.ndarray, tests: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of predictions ``a`` (tests x units), ``b`` (units) for each test unit."""
    out, here = {}, np.ix_(units, units)
    for tail, names in (("", ("k", "c", "d", "genes")), ("_expr", ("ke", "ce", "de", "genes_e"))):
        k, c, d = (g.m[x] for x in names[:3])
        n = g.m[names[3]][0]
        pp = np.einsum("ti,ij,tj->t", a, k[here], a) + 2 * a @ (c[here] @ b) + b @ d[here] @ b
        every = a @ c[np.ix_(units, tests)] + b @ d[np.ix_(units, tests)]  # tests x tests
        yy = np.diag(d)[tests]
        sx = np.zeros(len(g.reach)) if tail == "" else g.m["sxe"]
        sy = g.m["sy"] if tail == "" else g.m["sye"]
        sp = a @ sx[units] + b @ sy[units]
        out["l2" + tail], out["pcc" + tail] = _fit(pp, np.diag(every), yy, sp, sy[tests], n)
        if not tail:
            far = pp[:, None] - 2 * every + yy[None, :]
            own, blur = np.diag(far), 1e-12 * (pp[:, None] + yy[None, :])  # equal but for rounding is not farther
            out["centroid"] = (far - own[:, None] > blur).sum(axis=1) / (len(tests) - 1) if len(tests) > 1 else np.full(len(tests), np.nan)
    return out


METRICS = ["l2", "pcc", "l2_expr", "pcc_expr", "centroid"]


def gram_scores(grams: DataFrame, sets: DataFrame, tests: DataFrame, by: list[str], base: list[str], batches: int = 8) -> DataFrame:
    """(model, base, set, unit, METRICS) of the mean and the bilinear model.

    ``sets``: base, set, unit, optional weight (below 0 or missing count as 0).
    ``tests``: base, unit.  The bilinear model predicts single units with a known
    gene; an arm without weight, or too small for a model, has no rows of it.
    """
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)) if "weight" in sets.columns else F.lit(1.0)
    pairs = sets.select(*base, "set", F.struct(F.col("unit").alias("u"), weight.alias("w")).alias("p")).groupBy(*base, "set").agg(F.array_sort(F.collect_list("p")).alias("p"))
    pairs = pairs.select(*base, "set", F.transform("p", lambda p: p["u"]).alias("units"), F.transform("p", lambda p: p["w"]).alias("weights"))
    whom = tests.select(*base, "unit").distinct().groupBy(*base).agg(F.array_sort(F.collect_list("unit")).alias("tests"))
    right = pairs.join(whom, base).withColumn("batch", F.pmod(F.xxhash64(*base, "set"), F.lit(batches)).cast("int"))
    left = grams.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    columns = ["model", *base, "set", "unit", *METRICS]

    def one(key: tuple, mats: pd.DataFrame, arms: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(mats) and len(arms):
            g = Matrices.of(mats)
            for arm in arms.itertuples(index=False):
                units, tests = (np.array([g.at[u] for u in xs if u in g.at], int) for xs in (arm.units, arm.tests))
                w = np.array([v for u, v in zip(arm.units, arm.weights, strict=True) if u in g.at])
                names = np.array([u for u in arm.tests if u in g.at])
                if len(units) < 1 or w.sum() <= 0 or not len(tests):
                    continue
                fits = [("mean", np.ones(len(tests), bool), np.zeros((len(tests), len(units))), mean_weights(w))]
                able = g.single[tests] & ~np.isnan(g.reach[tests, 0])
                if able.any() and (fit := bilinear_weights(g, units, w, tests[able])) is not None:
                    fits.append(("bilinear", able, *fit))
                for model, who, a, b in fits:
                    fixed = {"model": model} | {c: key[by.index(c)] if c in by else getattr(arm, c) for c in base} | {"set": arm.set, "unit": names[who]}
                    parts.append(pd.DataFrame(fixed | score(g, units, a, b, tests[who])))
        return pd.concat(parts)[columns] if parts else pd.DataFrame(columns=columns)

    schema = f"model string, {_kinds(sets, base)}, {_kinds(pairs, ['set'])}, {_kinds(sets, ['unit'])}, " + ", ".join(f"{c} double" for c in METRICS)
    out = left.groupBy(*by, "batch").cogroup(right.groupBy(*by, "batch")).applyInPandas(one, schema)
    gone = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("model", *base, "set", "unit", *map(gone, METRICS))
