"""Two-dimensional kernel density at the points themselves, linear in the points.

The points stay where they are read: each task adds them up by grid cell, the grid is
smoothed in blocks, and comes back to the points by a broadcast.  A group's occupied
cells grow with n^(1/3) where they are dense and never faster than n^(2/3).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import settle
from . import blocks as B

#: Grid cells a bandwidth, and bandwidths after which the kernel is cut.
CELLS, REACH = 8, 4
#: Grid cells along the side of a block (with its surroundings some 1 MB) and of a patch, what the points read; divides it.
SIDE, PATCH = 256, 8
#: Groups, and patches of all groups, that are broadcast: some 20 and 50 MB.  With more, points are shuffled.
GROUPS, PATCHES = 1 << 17, 1 << 16
#: Accuracy of the sketch that brackets a median, and half the bracket's width in steps of it.
ACCURACY, STEPS = 10_000, 10

_BLOCK, _PATCH = ["kd_k", "kd_bi", "kd_bj"], ["kd_k", "kd_u", "kd_v"]
_CORNERS = [(a, b) for a in (0, 1) for b in (0, 1)]


def _beside(points: DataFrame, table: DataFrame, on: Column | list[str], most: int) -> DataFrame:
    """``points`` with their row of ``table`` (settled), or with nulls."""
    return points.join(F.broadcast(table) if table.count() <= most else table, on, "left")


def _bilinear(a: int, b: int) -> Column:
    """Weight of a corner for a point at (kd_a, kd_b) in its grid cell."""
    return (F.col("kd_a") if a else 1 - F.col("kd_a")) * (F.col("kd_b") if b else 1 - F.col("kd_b"))


def _groups(used: DataFrame, by: list[str], cells: int) -> DataFrame:
    """A row for each group that has a density: its number ``kd_k``, axes and grid step."""
    s = used.groupBy(*[F.col(c).alias(f"kd_by{k}") for k, c in enumerate(by)]).agg(
        F.count("*").alias("kd_n"), F.avg("kd_x").alias("kd_mx"), F.avg("kd_y").alias("kd_my"), F.stddev_samp("kd_x").alias("kd_sx"),
        F.covar_samp("kd_x", "kd_y").alias("kd_c"), F.var_samp("kd_y").alias("kd_vy"),
    )
    left = F.col("kd_vy") - F.try_divide(F.col("kd_c") * F.col("kd_c"), F.nullif(F.col("kd_sx") * F.col("kd_sx"), F.lit(0.0)))
    s = s.withColumn("kd_l", left).where("kd_n >= 3 and kd_sx > 0 and kd_l > 1e-12 * kd_vy")
    h = F.pow(F.col("kd_n").cast("double"), F.lit(-1 / 6))
    of = [f"kd_by{k}" for k in range(len(by))]
    s = s.select(*of, "kd_n", "kd_mx", "kd_my", "kd_sx", (F.col("kd_c") / F.col("kd_sx")).alias("kd_slope"), F.sqrt("kd_l").alias("kd_s"), (h / cells).alias("kd_d"))
    area = F.col("kd_n") * F.pow(F.col("kd_d"), F.lit(2.0)) * F.col("kd_sx") * F.col("kd_s")
    return s.withColumn("kd_area", area).withColumn("kd_k", F.monotonically_increasing_id())


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of one block after the other; rows come sorted by block, which comes first."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        of = np.stack(rows[: len(_BLOCK)])
        cuts = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if begin == end:
                continue
            if held and any(held[0][c][0] != of[c, begin] for c in range(len(_BLOCK))):
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            held.append([r[begin:end] for r in rows])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _smoothing(cells: int, side: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of grid cells -> the smoothed counts on the patches that hold a block's own cells."""
    reach = REACH * cells
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2.0 * cells * cells)) / (math.sqrt(2 * math.pi) * cells)

    def along(at: np.ndarray, patches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """On one axis: places of the cells' lower and upper corners, and what these give to the patches' corners."""
        source, place = np.unique(np.stack([at, at + 1]), return_inverse=True)
        o = source - (patches[:, None] * PATCH + np.arange(PATCH + 1)).reshape(-1, 1)
        return place.reshape(2, -1), np.where(abs(o) <= reach, kernel[np.clip(o, -reach, reach) + reach], 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, bi, bj, i, j, *w in _blocks(batches):
            own = (i // side == bi) & (j // side == bj)
            if not own.any():
                continue
            (us, at), (vs, to) = (np.unique(c[own] // PATCH, return_inverse=True) for c in (i, j))
            (pi, gi), (pj, gj) = along(i, us), along(j, vs)
            grid = np.zeros((gi.shape[1], gj.shape[1]))
            for (a, b), v in zip(_CORNERS, w, strict=True):
                grid[pi[a], pj[b]] += v  # of cells that have this place as such a corner there is one
            u, v = np.divmod(np.unique(at * len(vs) + to), len(vs))
            f = (gi @ grid @ gj.T).reshape(len(us), PATCH + 1, len(vs), PATCH + 1)[u, :, v, :].reshape(-1)
            ends = np.arange(len(u) + 1, dtype=np.int32) * (PATCH + 1) ** 2
            yield pa.RecordBatch.from_arrays([pa.array(k[: len(u)]), pa.array(us[u]), pa.array(vs[v]), pa.ListArray.from_arrays(ends, f)], names=[*_PATCH, "kd_f"])

    return run


def _patches(at: DataFrame, cells: int) -> DataFrame:
    """The smoothed counts ``kd_f`` at the corners of every patch of the grid that holds a point."""
    reach, side = REACH * cells, SIDE
    counts = at.groupBy("kd_k", "kd_i", "kd_j").agg(*[F.sum(_bilinear(a, b)).alias(f"kd_w{a}{b}") for a, b in _CORNERS])
    meets = lambda c: F.explode(F.sequence(*[F.floor((F.col(c) + o) / side).cast("long") for o in (-reach - 1, reach + 1)]))
    dealt = counts.withColumn("kd_bi", meets("kd_i")).withColumn("kd_bj", meets("kd_j"))
    dealt = B.spread(dealt.select(*_BLOCK, "kd_i", "kd_j", *[f"kd_w{a}{b}" for a, b in _CORNERS]), _BLOCK).sortWithinPartitions(*_BLOCK)
    return dealt.mapInArrow(_smoothing(cells, side), "kd_k long, kd_u long, kd_v long, kd_f array<double>")


def density_2d(points: DataFrame, x: str, y: str, by: list[str], name: str = "density", cells: int = CELLS) -> DataFrame:
    """``points`` with a Gaussian density of each group ``by`` at (x, y).

    The bandwidth is the group's covariance times n^(-1/3).  Points are whitened by
    that covariance, so the kernel becomes round; they are dealt bilinearly to a grid
    of ``cells`` cells a bandwidth, the counts are convolved along either axis and
    read back bilinearly.  Rows that are shuffled: occupied cells, once a task that
    found them and once a block whose kernel reaches them; no pair of points is ever made,
    and no point is moved while groups and patches are few enough to be broadcast
    (``GROUPS``, ``PATCHES``).  Against the direct sum the error is below 2 % of the
    highest density with 8 cells.

    Points with a missing or infinite coordinate, and groups of fewer than three
    points or without spread in two directions, have a null density.

    ``points`` are read twice while the frame is built, for the axes and for the grid.
    """
    ok = F.abs(F.col(x)).cast("double") < F.lit(float("inf"))
    ok = F.coalesce(ok & (F.abs(F.col(y)).cast("double") < F.lit(float("inf"))), F.lit(False))
    p = points.withColumn("kd_x", F.when(ok, F.col(x).cast("double"))).withColumn("kd_y", F.when(ok, F.col(y).cast("double")))
    groups = settle(_groups(p.where("kd_x is not null"), by, cells))  # every later pass has to see the same bits
    same = [F.col(c).eqNullSafe(F.col(f"kd_by{k}")) for k, c in enumerate(by)]  # null is a group like others
    at = _beside(p, groups, reduce(Column.__and__, same, F.col("kd_x").isNotNull()), GROUPS)
    u = (F.col("kd_x") - F.col("kd_mx")) / F.col("kd_sx")
    v = (F.col("kd_y") - F.col("kd_my") - F.col("kd_slope") * u) / F.col("kd_s")
    at = at.withColumn("kd_a", u / F.col("kd_d")).withColumn("kd_b", v / F.col("kd_d"))
    at = at.withColumn("kd_i", F.floor("kd_a").cast("long")).withColumn("kd_j", F.floor("kd_b").cast("long"))
    at = at.withColumn("kd_a", F.col("kd_a") - F.col("kd_i")).withColumn("kd_b", F.col("kd_b") - F.col("kd_j"))
    at = at.withColumn("kd_u", F.floor(F.col("kd_i") / PATCH).cast("long")).withColumn("kd_v", F.floor(F.col("kd_j") / PATCH).cast("long"))
    read = _beside(at, settle(_patches(at.where("kd_k is not null"), cells)), _PATCH, PATCHES)
    place = ((F.col("kd_i") - F.col("kd_u") * PATCH) * (PATCH + 1) + F.col("kd_j") - F.col("kd_v") * PATCH).cast("int")
    value = reduce(Column.__add__, [_bilinear(a, b) * F.get("kd_f", place + a * (PATCH + 1) + b) for a, b in _CORNERS]) / F.col("kd_area")
    read = read.withColumn(name, value)
    return read.drop(*[c for c in read.columns if c not in {*points.columns, name}])


def summary(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by``, ``n`` (rows), ``low``, ``median``, ``high``, ``mean`` of ``value``.  Groups are few.

    The median is exact: a sketch brackets it, then only the values in the bracket, 0.2 %
    of the rows, are counted one by one.  Groups of up to 100,000 values, and all should
    the sketch have missed, are counted whole.
    """
    half = STEPS / ACCURACY
    near = F.percentile_approx(value, F.array(F.lit(0.5 - half), F.lit(0.5 + half)), F.lit(ACCURACY))
    first = values.groupBy(*[F.col(c).alias(f"md_by{k}") for k, c in enumerate(by)]).agg(
        F.count("*").alias("n"), F.count(value).alias("md_n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"), near.alias("md_near"),
    )
    first = settle(first.withColumn("md_k", F.monotonically_increasing_id()))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"md_by{k}")) for k, c in enumerate(by)], F.lit(True))
    below, upper = F.floor((F.col("md_n") - 1) / 2), F.floor(F.col("md_n") / 2)  # the two in the middle, from 0

    def middle(whole: bool) -> DataFrame:
        all_of = F.lit(whole) | (F.col("md_n") <= STEPS * ACCURACY)
        bounds = first.withColumn("md_low", F.when(all_of, F.col("low")).otherwise(F.col("md_near")[0])).withColumn("md_high", F.when(all_of, F.col("high")).otherwise(F.col("md_near")[1]))
        inside = values.join(F.broadcast(bounds), same).where(F.col(value) <= F.col("md_high"))
        counts = inside.groupBy("md_k", F.when(F.col(value) >= F.col("md_low"), F.col(value)).alias("md_v")).agg(F.count("*").alias("md_c"))  # null: what lies below the bracket
        until = counts.withColumn("md_u", F.sum("md_c").over(Window.partitionBy("md_k").orderBy("md_v").rowsBetween(Window.unboundedPreceding, 0)))
        return settle(until.join(F.broadcast(first.select("md_k", "md_n")), "md_k").groupBy("md_k").agg(
            F.min(F.when(F.col("md_u") > below, F.col("md_v"))).alias("md_1"), F.min(F.when(F.col("md_u") > upper, F.col("md_v"))).alias("md_2"),
            F.coalesce(F.bool_or(F.col("md_v").isNull() & (F.col("md_u") > below)), F.lit(False)).alias("md_missed"),
        ))

    found = middle(False)
    if found.where("md_missed or md_2 is null").limit(1).count():
        found = middle(True)
    out = first.join(F.broadcast(found), "md_k", "left")
    return out.select(*[F.col(f"md_by{k}").alias(c) for k, c in enumerate(by)], "n", "low", ((F.col("md_1") + F.col("md_2")) / 2).alias("median"), "high", "mean")
