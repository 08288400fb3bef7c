"""Cells as blocks: dense pieces of a matrix small enough for one Arrow row.

A group's cells are dealt to blocks by a hash of their ids, so that a block has
about ``most`` cells whatever the size of its group.  Work on all pairs of cells is
work on pairs of blocks; each pair of blocks is a row of its own, keyed by the
block that it needs, hence a large group spreads over tasks.  A block is copied once
for each block that it meets, so larger blocks move less; what one row takes in a task
is bounded by them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Cells of a block at most, and least where there are many genes; numbers of a block
#: in between, about: 1 MB.  The distances of two blocks take 32 MB.
CELLS, LEAST, NUMBERS = 2048, 128, 1 << 17


def counted(vec: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``n`` (cells of the group) and ``count`` (its blocks, by cells and genes)."""
    genes = F.greatest(F.max(F.size("v")), F.lit(1))
    most = F.greatest(F.least(F.floor(F.lit(NUMBERS) / genes), F.lit(CELLS)), F.lit(min(LEAST, CELLS)))
    return vec.groupBy(*keys).agg(F.count("*").alias("n"), F.ceil(F.count("*") / most).cast("int").alias("count"))


def block_number(count: str | Column, cell: str = "cell") -> Column:
    """Block of a cell in a group of ``count`` blocks."""
    return F.pmod(F.xxhash64(cell), count).cast("int")


def blocks(vec: DataFrame, keys: list[str], sizes: DataFrame) -> DataFrame:
    """``keys``, ``n``, ``count``, ``block``, ``body`` (cell, v; by cell); ``sizes`` as of :func:`counted`."""
    dealt = vec.join(sizes, keys).withColumn("block", block_number("count"))
    return dealt.groupBy(*keys, "n", "count", "block").agg(F.array_sort(F.collect_list(F.struct("cell", "v"))).alias("body"))


def spread(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` dealt to a fixed number of tasks: its rows are few, but each is much work, and
    by their bytes, or joined by a few units, they would lie in few tasks."""
    return df.repartition(max(32, 2 * df.sparkSession.sparkContext.defaultParallelism), *by)


def added(arrays: str) -> Column:
    """Aggregate: arrays of one length, one or a few for each block of a group, added up."""
    xs = F.collect_list(arrays)
    return F.aggregate(F.slice(xs, 2, F.size(xs)), xs[0], lambda x, y: F.zip_with(x, y, lambda p, q: p + q))


def beside_each(left: DataFrame, right: DataFrame, keys: list[str], first: str | Column, count: Column) -> DataFrame:
    """Each row of ``left`` with the blocks ``first`` to ``count - 1`` of the same ``keys`` in ``right``."""
    begin = F.col(first) if isinstance(first, str) else first
    return left.withColumn("meets", F.explode(F.sequence(begin.cast("int"), count.cast("int") - 1))).join(right.withColumnRenamed("block", "meets").hint("merge"), [*keys, "meets"])


def matrix(column: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell ids, cells x genes) of a row of ``body``."""
    body = column[row].values
    return np.asarray(body.field("cell").to_numpy(zero_copy_only=False)), body.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(body), -1)


def indicators(halves: Iterable[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Which of ``n`` cells are in either half, two rows for each draw."""
    sides = [at for pair in halves for at in pair]
    h = np.zeros((len(sides), n))
    for k, at in enumerate(sides):
        h[k, at] = 1.0
    return h


#: Squared distances below this share of the squared lengths are taken by differences.
CANCELS = 1e-6


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean, by a matrix product; where it cancels by differences: equal cells are 0
    apart to the last bit."""
    mean = x.mean(axis=0)
    u, v = x - mean, y - mean
    uu, vv = (u * u).sum(axis=1), (v * v).sum(axis=1)
    d = u @ v.T
    d *= -2
    d += uu[:, None]
    d += vv
    flat = d.reshape(-1)
    close = np.flatnonzero(flat <= CANCELS * (uu.max() + vv.max()))
    np.sqrt(np.maximum(d, 0, out=d), out=d)
    for k in range(0, len(close), 1 << 16):
        at = close[k : k + (1 << 16)]
        i, j = np.divmod(at, len(y))
        flat[at] = np.sqrt(((x[i] - y[j]) ** 2).sum(axis=1))
    return d


def by_row(df: DataFrame, keys: list[str], extra: str, make: Callable[[pa.RecordBatch, int], list[list]]) -> DataFrame:
    """For each row of ``df`` the rows of the columns ``extra`` that ``make`` gives
    (as lists, one a column), beside the row's ``keys``, which stay Arrow values."""
    made = T.StructType.fromDDL(extra)
    schema = T.StructType([*(df.schema[k] for k in keys), *made.fields])
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                new = [pa.array(v, type=f.type) for v, f in zip(make(batch, row), arrow, strict=True)]
                at = pa.array([row] * len(new[0]), type=pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), *new], names=[*keys, *made.names])

    return df.mapInArrow(run, schema)
