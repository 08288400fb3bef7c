"""Deterministic resampling: MD5-ordered windows instead of random streams.

Results depend on keys alone, not on partitioning, and any SQL engine can
reproduce them.  Windows run over ids, never over vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hash_position


def repeats(df: DataFrame, n: int, name: str = "rep") -> DataFrame:
    """``df`` with one row for each repeat 1..n."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))


def permuted(df: DataFrame, by: list[str], key: list[str | Column], tie: str, name: str = "rk") -> DataFrame:
    """Rank of each row in a hash-ordered permutation of its group."""
    w = Window.partitionBy(*by).orderBy(F.md5(F.concat_ws(":", *key)), tie)
    return df.withColumn(name, F.row_number().over(w))


def halves(df: DataFrame, by: list[str], key: list[str | Column], tie: str, n: str) -> DataFrame:
    """Two disjoint halves of size ``n`` (a column) of each group: ``half`` 1 or 2."""
    out = permuted(df, by, key, tie).where(F.col("rk") <= 2 * F.col(n))
    return out.withColumn("half", F.when(F.col("rk") <= F.col(n), 1).otherwise(2)).drop("rk")


def subset(df: DataFrame, by: list[str], key: list[str | Column], tie: str, size: str | Column) -> DataFrame:
    """Sample without replacement of ``size`` rows of each group."""
    return permuted(df, by, key, tie).where(F.col("rk") <= size).drop("rk")


def split_test(df: DataFrame, strata: list[str], key: list[str | Column], tie: str, share: float = 0.25) -> DataFrame:
    """Stratified split: ``max(1, round-half-even(share n))`` test rows, none in strata of one."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*strata))
    test = F.when(n >= 2, F.greatest(F.lit(1), F.bround(share * n, 0))).otherwise(0)
    ranked = permuted(df.withColumn("n_test", test), strata, key, tie)
    return ranked.withColumn("split", F.when(F.col("rk") <= F.col("n_test"), "test").otherwise("train")).drop("rk", "n_test")


def bootstrap_draws(units: DataFrame, strata: list[str], tie: list[str], iterations: int, salt: str) -> DataFrame:
    """With-replacement draws, paired across whatever joins them: for every
    (iteration, stratum, slot) the unit at a hashed position."""
    w = Window.partitionBy(*strata)
    placed = units.withColumn("pos", F.row_number().over(w.orderBy(*tie)) - 1).withColumn("size", F.count(F.lit(1)).over(w))
    slots = repeats(placed.select(*strata, "size", F.col("pos").alias("slot")), iterations, "iter")
    drawn = slots.withColumn("pos", hash_position("size", F.lit(salt), "iter", *strata, "slot").cast("int"))
    return drawn.select("iter", *strata, "slot", "pos").join(placed.drop("size"), [*strata, "pos"])
