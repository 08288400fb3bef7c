"""Centroids, split-half reliability and the systematic axis.

All on long cells (cell, unit, g, x).  Halves are drawn on cell ids (:mod:`.draws`);
their means are matrix products over blocks of cells (:mod:`.blocks`), those of the
controls once per sample size, not per unit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats as S
from . import blocks as B
from . import draws as D


def beside(df: DataFrame, one: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the row that ``one`` has for each ``by``, or its only row."""
    return df.join(one, by) if by else df.crossJoin(F.broadcast(one))  # one row


def centroids(cells: DataFrame, by: list[str] = []) -> DataFrame:
    """Pseudobulk: mean of each gene over the unit's cells, within ``by`` (dataset,
    condition, context: any columns of ``cells``)."""
    return cells.groupBy(*by, "unit", "g").agg(F.avg("x").alias("m"), F.count("*").alias("n"))


def deltas(cells: DataFrame, control: int = 0, by: list[str] = []) -> DataFrame:
    """Centroid minus the control's of the same ``by``: ``by``, ``unit``, ``g``, ``delta``, ``n``."""
    c = centroids(cells, by)
    ctrl = c.where(F.col("unit") == control).select(*by, "g", F.col("m").alias("m0"))
    return c.where(F.col("unit") != control).join(ctrl, [*by, "g"]).select(*by, "unit", "g", (F.col("m") - F.col("m0")).alias("delta"), "n")


def top_expressed(cells: DataFrame, k: int, control: int = 0, by: list[str] = []) -> DataFrame:
    """The k genes with the largest mean control expression."""
    m = cells.where(F.col("unit") == control).groupBy(*by, "g").agg(F.avg("x").alias("m"))
    w = Window.partitionBy(*by).orderBy(F.desc("m"), "g")  # genes of one matrix
    return m.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select(*by, "g")


def configurations(units: DataFrame, control: int, grid: list[int], least: int = 4, by: list[str] = []) -> DataFrame:
    """(by, unit, mode, n): the largest split and every feasible fixed one, also when equal."""
    sizes = units.groupBy(*by, "unit").agg(F.count("*").alias("cells"))
    ctrl = sizes.where(F.col("unit") == control).select(*by, F.col("cells").alias("ctrl_cells"))
    n = beside(sizes.where(F.col("unit") != control), ctrl, by)
    n = n.withColumn("most", F.least(F.floor(F.col("cells") / 2), F.floor(F.col("ctrl_cells") / 2)).cast("int")).where(F.col("most") >= least)
    split = lambda mode, v: F.struct(F.lit(mode).alias("mode"), v.alias("n"))
    every = F.array(split("max", F.col("most")))
    if grid:
        every = F.concat(every, F.transform(F.filter(F.array(*map(F.lit, grid)), lambda v: v <= F.col("most")), lambda v: split("fixed", v)))
    return n.select(*by, "unit", F.explode(every).alias("c")).select(*by, "unit", "c.mode", "c.n")


#: Cells of a block of half sums: 4 MB at 512 genes.
HALF_CELLS = 1024
_SUMS = ("k", "a", "b", "aa", "bb", "ab")


def _half_sums(batch: pa.RecordBatch, row: int) -> list[list]:
    """Sums over each half of every draw: indicators of halves times cells x genes."""
    cells, x = B.matrix(batch.column("body"), row)
    h = D.places(batch.column("drawn"), row, cells)
    s = (B.indicators(h.values(), len(cells)) @ x).reshape(len(h), 2, x.shape[1])
    return [[k[0] for k in h], [k[1] for k in h], list(s[:, 0]), list(s[:, 1])]


def half_sums(vec: DataFrame, cut: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """``keys``, ``piece``, ``size``, ``rep`` and the sums of both halves' cells, ``a`` and ``b`` (arrays of genes).
    ``cut``: draws as of :func:`.draws.cuts`; ``sizes``: ``count`` of blocks."""
    body = vec.join(sizes, keys).withColumn("block", B.block_number("count")).groupBy(*keys, "piece", "block").agg(F.array_sort(F.collect_list(F.struct("cell", "v"))).alias("body"))
    met = B.spread(body.join(D.by_block(cut, keys, sizes), [*keys, "block"]), [*keys, "piece", "block"])
    sums = B.by_row(met, [*keys, "piece"], "size int, rep int, a array<double>, b array<double>", _half_sums)
    return sums.groupBy(*keys, "piece", "size", "rep").agg(B.added("a").alias("a"), B.added("b").alias("b"))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the deltas of both halves, over all genes of a piece and over the masked ones:
    count, sums, squares and product."""
    for batch in batches:
        got = []
        for row in range(batch.num_rows):
            a, b, ca, cb, top = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("a", "b", "ca", "cb", "top"))
            n = abs(batch.column("size")[row].as_py())
            u, v = (a - ca) / n, (b - cb) / n
            got.append([m for x, y in ((u, v), (u[top], v[top])) for m in (float(len(x)), x.sum(), y.sum(), x @ x, y @ y, x @ y)])
        kept = [c for c in batch.schema.names if c not in ("a", "b", "ca", "cb", "top")]
        new = np.array(got, dtype=float).reshape(-1, 2 * len(_SUMS)).T
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, new)], names=[*kept, *(f"{c}_{m}" for m in ("all", "top") for c in _SUMS)])


def _pearson_of(mode: str):
    """Correlation from summed moments; 0 where a side does not vary."""
    k, a, b, aa, bb, ab = (F.sum(f"{c}_{mode}") for c in _SUMS)
    va, vb, cov = aa * k - a * a, bb * k - b * b, ab * k - a * b
    flat = (va <= 1e-14 * aa * k) | (vb <= 1e-14 * bb * k)
    return F.when(flat | (k < 2), 0.0).otherwise(F.least(F.greatest(cov / F.sqrt(va) / F.sqrt(vb), F.lit(-1.0)), F.lit(1.0)))


def split_half_r(cells: DataFrame, units: DataFrame, reps: int, grid: list[int] | None = None, topk: int | None = None, control: int = 0, by: list[str] = [], pieces: int = 1) -> DataFrame:
    """Correlation of two independent half-sample deltas for every
    (by, unit, mode, n, gene_mode, rep); units and controls meet within ``by``.

    Half means are products of an indicator matrix (draws x cells) with the cells, by
    block of cells and ``pieces`` of the genes (some 512 genes in each are enough), so
    a repeat is a row of a product, not a row for each cell and gene.  Matrices are
    dense within ``by``, ``units`` are their cells; keys are not null.
    """
    conf = configurations(units, control, grid or [], by=by)
    keys = [*by, "unit"]
    sizes = units.groupBy(*keys).agg(F.ceil(F.count("*") / HALF_CELLS).alias("count"))
    size = F.when(F.col("mode") == "max", -F.col("n")).otherwise(F.col("n")).cast("int").alias("size")
    salt = lambda side: F.concat_ws(":", "mode", "n", F.lit(side)).alias("salt")
    none = F.lit(control).cast(units.schema["unit"].dataType).alias("unit")
    treated, pool = F.col("unit") != control, F.col("unit") == control
    drawn = D.cuts(units.where(treated), conf.select(*keys, size, "n", salt("t")), keys, reps)
    asked = conf.select(*by, "mode", "n").distinct().select(*by, none, size, "n", salt("c"))
    drawn_pool = D.cuts(units.where(pool), asked, keys, reps)
    piece = F.pmod(F.xxhash64("g"), F.lit(pieces)).cast("int").alias("piece")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("g", "x"))), lambda s: s["x"])
    vec = cells.groupBy("cell", *keys, piece).agg(ordered.alias("v"))
    c = half_sums(vec.where(pool), drawn_pool, keys, sizes).select(*by, "piece", "size", "rep", F.col("a").alias("ca"), F.col("b").alias("cb"))
    both = half_sums(vec.where(treated), drawn, keys, sizes).join(c, [*by, "piece", "size", "rep"])
    genes = cells.where(F.col("unit") == control).select(*by, "g").distinct()
    top = genes.join(top_expressed(cells, topk or 0, control, by).withColumn("top", F.lit(True)), [*by, "g"], "left")
    mask = top.groupBy(*by, piece).agg(F.transform(F.array_sort(F.collect_list(F.struct("g", F.coalesce("top", F.lit(False)).alias("top")))), lambda s: s["top"]).alias("top"))
    both = both.join(mask, [*by, "piece"])
    kept = [*keys, "piece", "size", "rep"]
    both = both.select(*kept, "a", "b", "ca", "cb", "top")
    schema = T.StructType([*(both.schema[c] for c in kept), *(T.StructField(f"{s}_{m}", T.DoubleType()) for m in ("all", "top") for s in _SUMS)])
    wide = both.mapInArrow(_moments, schema).groupBy(*keys, "size", "rep").agg(_pearson_of("all").alias("all_genes"), _pearson_of("top").alias("top_expressed"))
    modes = ["all_genes", "top_expressed"] if topk else ["all_genes"]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("gene_mode"), F.col(m).alias("r")) for m in modes])).alias("e")
    mode = F.when(F.col("size") < 0, "max").otherwise("fixed").alias("mode")
    return wide.select(*keys, mode, F.abs("size").alias("n"), "rep", each).select(*keys, "mode", "n", "rep", "e.r", "e.gene_mode")


def reliability_long(r: DataFrame, by: list[str] = []) -> DataFrame:
    """Summary statistics of the repeats of each (by, unit, mode, n, gene_mode)."""
    p = F.percentile("r", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    sb = S.spearman_brown("r")
    out = r.withColumn("sb", sb).groupBy(*by, "unit", "mode", "n", "gene_mode").agg(
        F.count("*").alias("n_repeats"), F.avg("r").alias("mean_r"), F.stddev_pop("r").alias("std_r"), p.alias("q"), F.min("r").alias("min_r"), F.max("r").alias("max_r"),
        S.population_skew("r").alias("skewness_r"), F.avg("sb").alias("sb_mean_per_repeat"), F.percentile("sb", F.lit(0.5)).alias("sb_median_per_repeat"),
    )
    out = out.withColumn("q25_r", F.col("q")[0]).withColumn("median_r", F.col("q")[1]).withColumn("q75_r", F.col("q")[2]).drop("q")
    out = out.withColumn("sb_from_mean", S.spearman_brown("mean_r")).withColumn("sb_from_median", S.spearman_brown("median_r"))
    return out.withColumn("ceiling_from_mean", S.ceiling("sb_from_mean")).withColumn("ceiling_from_median", S.ceiling("sb_from_median"))


def reliability_wide(long: DataFrame, modes: tuple[str, ...] = ("all_genes", "top_expressed"), by: list[str] = []) -> DataFrame:
    """One row per (by, unit): the largest split's values by gene mode, and n* (least
    fixed n whose median correlation reaches 0.5)."""
    parts = []
    for m in modes:
        at = (F.col("mode") == "max") & (F.col("gene_mode") == m)
        parts += [F.max(F.when(at, F.col(c))).alias(f"{c}_{m}") for c in ("n", "median_r", "mean_r", "sb_from_median", "ceiling_from_median")]
        parts.append(n_star(m).alias(f"n_star_{m}"))
    return long.groupBy(*by, "unit").agg(*parts)


def with_failures(wide: DataFrame, units: DataFrame, control: int = 0, least: int = 4, by: list[str] = []) -> DataFrame:
    """``wide`` with a row for every (by, unit): ``cells``, ``ctrl_cells`` and ``status``, which
    is OK or says why a unit has no reliability (its other columns are null)."""
    sizes = units.groupBy(*by, "unit").agg(F.count("*").alias("cells"))
    ctrl = sizes.where(F.col("unit") == control).select(*by, F.col("cells").alias("ctrl_cells"))
    treated = sizes.where(F.col("unit") != control)
    every = treated.join(ctrl, by, "left") if by else treated.crossJoin(F.broadcast(ctrl.agg(F.max("ctrl_cells").alias("ctrl_cells"))))  # one row
    short = lambda what: F.lit(f"ERROR: fewer than {2 * least} {what}")
    status = F.when(F.col("done"), "OK").when(F.col("cells") < 2 * least, short("cells")).otherwise(short("control cells"))
    out = every.join(wide.withColumn("done", F.lit(True)), [*by, "unit"], "left")
    return out.withColumn("ctrl_cells", F.coalesce("ctrl_cells", F.lit(0))).withColumn("status", status).drop("done")


def n_star(gene_mode: str):
    return F.min(F.when((F.col("mode") == "fixed") & (F.col("gene_mode") == gene_mode) & (F.col("median_r") >= 0.5), F.col("n"))).cast("double")


def shared_axis(cells: DataFrame, reliable: DataFrame, control: int = 0, by: list[str] = []) -> DataFrame:
    """Mean of all cells of reliable units (weighted by cells) minus the control's: ``by``, ``g``, ``avg_delta``."""
    rel = cells.join(reliable.select(*by, "unit"), [*by, "unit"], "left_semi").groupBy(*by, "g").agg(F.avg("x").alias("m"))
    ctrl = cells.where(F.col("unit") == control).groupBy(*by, "g").agg(F.avg("x").alias("m0"))
    return rel.join(ctrl, [*by, "g"]).select(*by, "g", (F.col("m") - F.col("m0")).alias("avg_delta"))


def axis_metrics(cells: DataFrame, reliable: DataFrame, control: int = 0, by: list[str] = []) -> DataFrame:
    """cos, norms, residual norm and phi of each unit against the shared axis of its
    ``by``; missing for units that are not reliable."""
    d = deltas(cells, control, by).join(shared_axis(cells, reliable, control, by), [*by, "g"])
    dd, aa, da = F.sum(F.col("delta") * F.col("delta")), F.sum(F.col("avg_delta") * F.col("avg_delta")), F.sum(F.col("delta") * F.col("avg_delta"))
    out = d.groupBy(*by, "unit").agg(F.max("n").alias("n_cells"), S.cosine("delta", "avg_delta").alias("c"), F.sqrt(dd).alias("np"), F.sqrt(aa).alias("na"), F.sqrt(F.greatest(dd - F.try_divide(da * da, F.nullif(aa, F.lit(0.0))), F.lit(0.0))).alias("ns"))
    out = out.join(reliable.select(*by, "unit", F.lit(True).alias("reliable")), [*by, "unit"], "left").withColumn("reliable", F.coalesce("reliable", F.lit(False)))
    val = lambda c: F.when(F.col("reliable"), F.col(c))
    return out.select(*by, "unit", "n_cells", "reliable", val("c").alias("cos_sim"), val("np").alias("norm_delta_p"), val("na").alias("norm_delta_avg"), val("ns").alias("norm_delta_specific"), (val("c") * val("c")).alias("frac_systematic_var"))


def cohort(units: DataFrame, control: int = 0, cells: int = 100, controls: int = 16, by: list[str] = []) -> DataFrame:
    """Units with enough cells where there are enough controls: ``by``, ``unit``, ``cells``, ``ctrl_cells``."""
    sizes = units.groupBy(*by, "unit").agg(F.count("*").alias("cells"))
    ctrl = sizes.where((F.col("unit") == control) & (F.col("cells") >= controls)).select(*by, F.col("cells").alias("ctrl_cells"))
    return beside(sizes.where((F.col("unit") != control) & (F.col("cells") >= cells)), ctrl, by)


def residuals(d: DataFrame, axis: DataFrame) -> DataFrame:
    """Deltas without their projection on the axis: ``unit``, ``g``, ``residual``."""
    j = d.join(axis, "g")
    w = Window.partitionBy("unit")
    k = F.try_divide(F.sum(F.col("delta") * F.col("avg_delta")).over(w), F.nullif(F.sum(F.col("avg_delta") * F.col("avg_delta")).over(w), F.lit(0.0)))
    return j.select("unit", "g", "delta", "avg_delta", (F.col("delta") - F.coalesce(k, F.lit(0.0)) * F.col("avg_delta")).alias("residual"))


def welch_t(cells: DataFrame, control: int = 0, by: list[str] = []) -> DataFrame:
    """Welch t of every gene of a unit against the control of its ``by``: ``by``, ``unit``, ``g``, ``t``."""
    m = cells.groupBy(*by, "unit", "g").agg(F.avg("x").alias("m"), F.var_samp("x").alias("v"), F.count("*").alias("n"))
    c = m.where(F.col("unit") == control).select(*by, "g", F.col("m").alias("m0"), F.col("v").alias("v0"), F.col("n").alias("n0"))
    t = F.try_divide(F.col("m") - F.col("m0"), F.nullif(F.sqrt(F.col("v") / F.col("n") + F.col("v0") / F.col("n0")), F.lit(0.0)))
    return m.where(F.col("unit") != control).join(c, [*by, "g"]).select(*by, "unit", "g", F.coalesce(t, F.lit(0.0)).alias("t"))


def top_by(df: DataFrame, by: list[str], value: str, k: int) -> DataFrame:
    """The k rows of each group with the largest absolute value (gene breaks ties)."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs(F.col(value))), "g")
    return df.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
