"""Energy distance and the reliability curve built on it.

Halves are drawn on cell ids (:mod:`.draws`).  Distances of a unit's cells are a matrix
in blocks (:mod:`.blocks`), each a product of matrices; the sums that all repeats and
sample sizes need are products of it with indicators of the halves, or, for draws that
are few among the pairs, sums of a part of it, so neither pairs of cells nor pairs and
repeats are rows.  A unit meets the controls of its own context where there are enough,
else all controls; the distances within a pool of controls are computed once, however
many contexts use it.

Vectors of one table have equal lengths.  A unit without a pool of controls has no
row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import draws as D
from .sampling import halves, repeats


def vectors(cells: DataFrame, by: list[str] = []) -> DataFrame:
    """Long cells as arrays ordered by gene: ``cell``, ``by``, ``unit``, ``v``."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("g", "x"))), lambda s: s["x"])
    return cells.groupBy("cell", *by, "unit").agg(ordered.alias("v"))


def sizes_of(n: Column, grid: list[int], least: int) -> Column:
    """Half sizes of a unit of ``n`` cells: those of the grid below the full split, and it."""
    full = F.floor(n / 2).cast("int")
    fixed = F.filter(F.array(*map(F.lit, grid)).cast("array<int>"), lambda v: (v >= least) & (v < full))
    return F.when(full >= least, F.concat(fixed, F.array(full)))


def drawn_halves(units: DataFrame, keys: list[str], reps: int, grid: list[int], least: int) -> DataFrame:
    """Halves of every unit as rows: ``keys``, ``drawn`` (size, rep, cell, half), a row for each of
    them and, where ``units`` has it, ``block``."""
    at = [c for c in units.columns if c == "block"]
    n = units.groupBy(*keys).agg(F.count("*").alias("cells"))
    sizes = n.select(*keys, F.explode(sizes_of(F.col("cells"), grid, least)).alias("size"))
    drawn = repeats(B.spread(units.join(sizes, keys), ["cell", "size"]), reps)
    rows = halves(drawn, [*keys, "size", "rep"], ["rep", "size", F.lit("e"), "cell"], "cell", "size")
    return rows.groupBy(*keys, "size", "rep", *at).agg(F.collect_list(F.struct("size", "rep", "cell", "half")).alias("drawn")).drop("size", "rep")


#: Draws with fewer than this share of two blocks' pairs are summed from their pairs alone.
SPARSE = 1 / 64
#: Draws whose indicators are multiplied at once.
AT_ONCE = 128


#: A block as it meets others: bytes, as an array costs its elements in every copy.
_PACKED = {"cells": "int", "x": "binary", "names": "binary", "ends": "binary", "at": "binary"}


def _pack(batch, row: int) -> list[list]:
    """A block's matrix, and the places of its cells in the halves of all draws."""
    cells, x = B.matrix(batch.column("body"), row)
    h = D.places(batch.column("drawn"), row, cells)
    sides = [at for pair in h.values() for at in pair]
    draws = (list(h), np.cumsum([len(at) for at in sides]), np.concatenate(sides) if sides else [])
    return [[len(cells)], [x.astype(float).tobytes()], *([np.asarray(v, dtype=np.int32).tobytes()] for v in draws)]


def _packed(body: DataFrame, drawn: DataFrame | None, keys: list[str]) -> DataFrame:
    """``keys``, ``block``, ``count`` and the columns of ``_PACKED``."""
    if drawn is None:
        own = body.select("*", F.lit(None).cast(D.DRAWN).alias("drawn"))
    else:
        own = B.spread(body.join(drawn, [*keys, "block"], "left"), [*keys, "block"])
    return B.by_row(own, [*keys, "block", "count"], ", ".join(f"{c} {t}" for c, t in _PACKED.items()), _pack)


def _other(packed: DataFrame, keys: list[str], columns: Iterable[str]) -> DataFrame:
    """The block that is met: its columns as ``other_``."""
    return packed.select(*keys, "block", *[F.col(c).alias(f"other_{c}") for c in columns])


def _matrix(batch, row: int, of: str = "") -> np.ndarray:
    return np.frombuffer(batch.column(f"{of}x")[row].as_buffer()).reshape(batch.column(f"{of}cells")[row].as_py(), -1)


def _draws(batch, row: int, of: str = "") -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """(size, rep) -> places of the first and of the second half."""
    names, ends, at = (np.frombuffer(batch.column(of + c)[row].as_buffer(), dtype=np.int32) for c in ("names", "ends", "at"))
    sides = np.split(at, ends[:-1])
    return {(s, r): (sides[2 * k], sides[2 * k + 1]) for k, (s, r) in enumerate(names.reshape(-1, 2).tolist())}


def _half_sums(batch, row: int) -> list[list]:
    """Sums over ordered pairs of two blocks of a unit: for each (size, rep) between and
    within the halves, and, as size 0, over all pairs."""
    d = B.distances(_matrix(batch, row), _matrix(batch, row, "other_"))
    same = batch.column("block")[row] == batch.column("meets")[row]
    ha, hb = _draws(batch, row), _draws(batch, row, "other_")
    cells = lambda h: len(h[0]) + len(h[1])
    both = [k for k in ha if k in hb]
    few = [k for k in both if cells(ha[k]) * cells(hb[k]) < SPARSE * d.size]
    many = [k for k in both if cells(ha[k]) * cells(hb[k]) >= SPARSE * d.size]
    out = [[0], [0], [0.0], [float(d.sum()) * (1 if same else 2)], [0.0]]

    def add(keys: list[tuple[int, int]], s: np.ndarray) -> None:
        """``s``: halves of one block x halves of the other, for each key."""
        s12, s11, s22 = (s[:, 0, 1], s[:, 0, 0], s[:, 1, 1]) if same else (s[:, 0, 1] + s[:, 1, 0], 2 * s[:, 0, 0], 2 * s[:, 1, 1])
        for o, new in zip(out, ([k[0] for k in keys], [k[1] for k in keys], s12.tolist(), s11.tolist(), s22.tolist()), strict=True):
            o.extend(new)

    for at in range(0, len(many), AT_ONCE):
        keys = many[at : at + AT_ONCE]
        p, q = B.indicators([ha[k] for k in keys], d.shape[0]), B.indicators([hb[k] for k in keys], d.shape[1])
        add(keys, np.einsum("khj,klj->khl", (p @ d).reshape(len(keys), 2, -1), q.reshape(len(keys), 2, -1)))
    if few:
        add(few, np.array([[[d[np.ix_(i, j)].sum() for j in hb[k]] for i in ha[k]] for k in few]))
    return out


def _all_pairs(batch, row: int) -> list[list]:
    return [[float(B.distances(_matrix(batch, row), _matrix(batch, row, "other_")).sum())]]


def _halves_of_pairs(own: DataFrame, keys: list[str]) -> DataFrame:
    pairs = B.beside_each(own, _other(own, keys, _PACKED), keys, "block", F.col("count"))
    columns = [c for of in ("", "other_") for c in (of + p for p in _PACKED)]
    sums = B.by_row(pairs.select(*keys, "block", "meets", *columns), keys, "size int, rep int, s12 double, s11 double, s22 double", _half_sums)
    return sums.groupBy(*keys, "size", "rep").agg(*[F.sum(c).alias(c) for c in ("s12", "s11", "s22")])


def pool_of(units: DataFrame, by: list[str], control: int, least: int) -> DataFrame:
    """``by``, ``pool``: a context's own controls (named by its key) or all (named '')."""
    k = units.groupBy(*by).agg(F.count(F.when(F.col("unit") == control, 1)).alias("k"))
    return k.select(*by, F.when(F.col("k") >= least, F.to_json(F.struct(*by))).otherwise("").alias("pool"))


def pooled_controls(vec: DataFrame, pools: DataFrame | None, by: list[str], control: int) -> DataFrame:
    """``pool``, ``cell``, ``v`` of the pools that contexts use."""
    ctrl = vec.where(F.col("unit") == control)
    everyone = ctrl.select(F.lit("").alias("pool"), "cell", "v")
    if pools is None:
        return everyone
    asked = pools.where("pool = ''").select("pool").distinct()  # a row at most
    own = ctrl.join(pools.where("pool != ''"), by).select("pool", "cell", "v")
    return own.unionByName(everyone.join(F.broadcast(asked), "pool", "left_semi"))


def half_sums_and_effect(vec: DataFrame, by: list[str] = [], reps: int = 0, grid: list[int] = [], control: int = 0, least: int = 4, least_pool: int = 8) -> tuple[DataFrame, DataFrame]:
    """(sums of the halves, E): ``by``, ``unit``, ``size``, ``rep``, ``s12``, ``s11``, ``s22``, where
    size 0 is the whole unit; and ``by``, ``unit``, ``n``, ``n_ctrl``, ``e_between`` (V-statistic,
    diagonal included).  ``vec``: ``cell``, ``by``, ``unit``, ``v``; keys are not null."""
    keys = [*by, "unit"]
    treated = vec.where(F.col("unit") != control)
    sizes = B.counted(treated, keys)
    drawn = None
    if reps:
        asked = sizes.select(*keys, F.explode(sizes_of(F.col("n"), grid, least)).alias("size"))
        asked = asked.select(*keys, "size", F.col("size").alias("n"), F.concat_ws(":", "size", F.lit("e")).alias("salt"))
        drawn = D.by_block(D.cuts(treated.select("cell", *keys), asked, keys, reps), keys, sizes)
    body = B.blocks(treated, keys, sizes)
    sums = _halves_of_pairs(_packed(body, drawn, keys), keys)
    pools = pool_of(vec.select(*keys), by, control, least_pool) if by else None
    controls = pooled_controls(vec, pools, by, control)
    n0 = B.counted(controls, ["pool"])
    pool = _packed(B.blocks(controls, ["pool"], n0), None, ["pool"])
    n0 = n0.select("pool", F.col("n").alias("n_ctrl"), F.col("count").alias("blocks_ctrl"))
    other = _other(pool, ["pool"], ["cells", "x"])

    def at_pool(df: DataFrame, one: DataFrame) -> DataFrame:
        """``df`` with the row of its pool; without contexts there is one pool, hence one row."""
        return df.join(one, "pool") if by else df.crossJoin(F.broadcast(one.drop("pool")))

    def sum_of(left: DataFrame, group: list[str], begin: str | Column, name: str) -> DataFrame:
        met = B.beside_each(at_pool(left, n0), other, ["pool"], begin, F.col("blocks_ctrl"))
        twice = F.when(F.col("twice"), 2.0).otherwise(1.0)
        once = met.select(*group, (F.col("block") != F.col("meets")).alias("twice"), "cells", "x", "other_cells", "other_x")
        return B.by_row(once, [*group, "twice"], "s double", _all_pairs).groupBy(*group).agg(F.sum(F.col("s") * (twice if name == "s_yy" else F.lit(1.0))).alias(name))

    s_yy = sum_of(pool.select("pool", "block", "cells", "x"), ["pool"], "block", "s_yy")
    plain = _packed(body, None, keys)
    placed = plain.join(pools, by) if by else plain.withColumn("pool", F.lit(""))
    s_xy = sum_of(placed.select(*keys, "pool", "block", "cells", "x"), [*keys, "pool"], F.lit(0), "s_xy")
    whole = sums.where("size = 0").select(*keys, F.col("s11").alias("s_xx")).join(sizes.select(*keys, "n"), keys)
    e = at_pool(at_pool(whole.join(s_xy, keys), s_yy), n0)
    n, m = F.col("n"), F.col("n_ctrl")
    value = 2 * F.col("s_xy") / (n * m) - F.col("s_xx") / (n * n) - F.col("s_yy") / (m * m)
    return sums, e.select(*keys, "n", "n_ctrl", value.alias("e_between"))


def between(vec: DataFrame, by: list[str] = [], control: int = 0, least_pool: int = 8) -> DataFrame:
    """E of each (by, unit) against its pool of controls: ``by``, ``unit``, ``n``, ``n_ctrl``, ``e_between``."""
    return half_sums_and_effect(vec, by, control=control, least_pool=least_pool)[1]


def reliability_curve(vec: DataFrame, reps: int, grid: list[int], by: list[str] = [], control: int = 0, least: int = 4, least_pool: int = 8) -> DataFrame:
    """rho_E of each (by, unit, n_half); the full split has n_half -1.

    rho_E = 1 - median over repeats of E_within / E_between, within [-1, 1]; a
    unit without an effect (E_between <= 0) gets 0.
    """
    keys = [*by, "unit"]
    sums, e = half_sums_and_effect(vec, by, reps, grid, control, least, least_pool)
    within = ((2 * F.col("s12") - F.col("s11") - F.col("s22")) / (F.col("size") * F.col("size"))).alias("e_within")
    ratio = sums.where("size > 0").select(*keys, "size", within).join(e, keys)
    ratio = ratio.withColumn("q", F.when(F.col("e_between") > 0, F.col("e_within") / F.col("e_between")))
    out = ratio.groupBy(*keys, "size", F.col("n").alias("n_cells"), "e_between").agg(F.percentile("q", F.lit(0.5)).alias("med"))
    rho = F.when(F.col("e_between") <= 0, 0.0).otherwise(F.least(F.greatest(1 - F.col("med"), F.lit(-1.0)), F.lit(1.0)))
    n_half = F.when(F.col("size") == F.floor(F.col("n_cells") / 2), -1).otherwise(F.col("size")).alias("n_half")
    return out.select(*keys, n_half, (F.col("med") * F.col("e_between")).alias("e_within_med"), "e_between", rho.alias("rho_e"), "n_cells")
