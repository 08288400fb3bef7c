"""Sharding by a Feistel permutation of global row numbers.

Rows get the numbers 0..N-1 in the order of their id.  A keyed Feistel network
over the next even number of bits, with cycle walking, permutes [0, N); number
p goes to shard ``p mod shards`` at slot ``p div shards``.  Shard and slot of
any row number can be computed from (seed, N, shards) alone, shard sizes differ
by one row at most and slots have no gaps.

Row numbers come without a window over all rows: ids are dealt into ranges,
sorted inside each, and the rows of every range are counted, which gives its
offset.

Defined results: rows with equal ids are ordered by ``tie``; repeated rows get
numbers of their own; a null id sorts first; an empty table gives no rows; other
columns are kept, but for those named like the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

ROUNDS = 4


def _mix(x: np.ndarray, key: np.uint64) -> np.ndarray:
    x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def permute(numbers: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Positions of row ``numbers`` under the permutation of [0, n)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64((seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        return (left << shift) | right

    out = once(np.asarray(numbers).astype(np.uint64))
    while (far := out >= np.uint64(n)).any():  # cycle walking: ends, as the start lies in [0, n)
        out[far] = once(out[far])
    return out.astype(np.int64)


#: Bits of Spark's ``monotonically_increasing_id`` that count inside a partition.
_INSIDE = 33


def row_numbers(df: DataFrame, id_col: str, tie: str, name: str) -> tuple[DataFrame, int]:
    """``df`` with global row numbers by ``id_col``; and the number of rows."""
    at, part, offset = (fresh(df, c) for c in ("at", "part", "offset"))
    order = [F.col(id_col).asc_nulls_first(), F.col(tie)]
    # Written out: the ranges are sampled, and numbers and counts must be of one deal.
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    dealt = dealt.withColumn(part, F.shiftright(at, _INSIDE).cast("int"))
    offsets, n = [], 0
    for k, rows in sorted((r[0], r[1]) for r in dealt.groupBy(part).count().collect()):  # one row per range
        offsets.append((k, n))
        n += rows
    table = df.sparkSession.createDataFrame(offsets, f"{part} int, {offset} long")
    inside = F.col(at).bitwiseAND(F.lit((1 << _INSIDE) - 1))
    out = dealt.join(F.broadcast(table), part).withColumn(name, inside + F.col(offset))
    return out.drop(at, part, offset), n


def feistel_shards(df: DataFrame, id_col: str = "doc_id", tie: Column | None = None, shards: int = 40, seed: int = 7) -> DataFrame:
    """``df`` with ``shard`` int and ``slot`` long; ``tie`` orders rows of one id.

    Every column of ``df`` moves with its row once: leave long texts out and
    join them later.
    """
    df = df.drop("shard", "slot")
    tied, number, at = fresh(df, "tie"), fresh(df, "number"), fresh(df, "place")
    numbered, n = row_numbers(df.withColumn(tied, F.lit(0) if tie is None else tie), id_col, tied, number)

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permute(x.to_numpy(), n, seed))

    numbered = numbered.withColumn(at, place(number))
    return numbered.withColumn("shard", (F.col(at) % shards).cast("int")).withColumn("slot", F.floor(F.col(at) / shards).cast("long")).drop(tied, number, at)
