"""Score tables: key-normalising joins, excess over a baseline, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import stats as S


def first_by(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in an explicit order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def join_triage(scores: DataFrame, triage: DataFrame, key: list[str], order: list[str], how: str = "inner") -> DataFrame:
    """Scores with the triage row of their unit; several contexts of a unit
    collapse to the first.  Null keys never match."""
    return scores.join(first_by(triage, key, *[F.col(c) for c in order]), key, how)


def join_with_fallback(scores: DataFrame, triage: DataFrame, op: str, condition: str, prefix: str = "pat") -> DataFrame:
    """Match on the normalised ``op``; where that fails, on it without ``prefix``."""
    known = first_by(triage.withColumn("nkey", K.normalise(condition)), ["dataset", "nkey"], F.col(condition))
    one, two = (known.select("dataset", F.col("nkey").alias(k), F.col(condition).alias(c)) for k, c in (("k1", "c1"), ("k2", "c2")))
    probe = scores.withColumn("k1", K.normalise(op)).withColumn("k2", F.replace(K.normalise(op), F.lit(prefix), F.lit("")))
    out = probe.join(one, ["dataset", "k1"], "left").join(two, ["dataset", "k2"], "left")
    return out.withColumn("matched", F.coalesce("c1", "c2")).where("matched is not null").drop("k1", "k2", "c1", "c2")


def fold_excess(scores: DataFrame, baseline: str, skip: list[str] | None = None, score: str = "score") -> DataFrame:
    """score - baseline's score of the same (dataset, op); units without a baseline drop."""
    base = scores.where(F.col("method") == baseline).groupBy("dataset", "op").agg(F.avg(score).alias("base"))
    rows = scores.where(~F.col("method").isin([baseline, *(skip or [])]))
    return rows.join(base, ["dataset", "op"]).withColumn("excess", F.col(score) - F.col("base"))


def dataset_weighted(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean of the per-dataset means."""
    return rows.groupBy(*by, "dataset").agg(F.avg(value).alias("m")).groupBy(*by).agg(F.avg("m").alias(value), F.count("*").alias("n_datasets"))


def excess_by_method(scores: DataFrame, baseline: str, skip: list[str] | None = None, absent_as_zero: bool = False, where: Column | None = None) -> DataFrame:
    rows = fold_excess(scores, baseline, skip)
    out = dataset_weighted(rows if where is None else rows.where(where), "excess", ["method"])
    if absent_as_zero:
        methods = scores.where(~F.col("method").isin([baseline, *(skip or [])])).select("method").distinct()
        out = methods.join(out, "method", "left").na.fill({"excess": 0.0, "n_datasets": 0})
    return out


def rank_shift(scores: DataFrame, baseline: str, cls: str = "cls", flag_at: int = 3, skip: list[str] | None = None) -> DataFrame:
    """Ranks over all units and over Specific ones, their shift, and a flag for large shifts."""
    every = excess_by_method(scores, baseline, skip, True).select("method", F.col("excess").alias("excess_all"))
    some = excess_by_method(scores, baseline, skip, True, F.col(cls) == "Specific").select("method", F.col("excess").alias("excess_specific"))
    out = every.join(some, "method")
    # Methods are few: one partition ranks them.
    out = out.withColumn("rank_all", S.rank_truncated(F.desc("excess_all"), "excess_all", [])).withColumn("rank_specific", S.rank_truncated(F.desc("excess_specific"), "excess_specific", []))
    return out.withColumn("shift", F.col("rank_all") - F.col("rank_specific")).withColumn("large", F.abs("shift") >= flag_at)


def top_method(excess: DataFrame, by: list[str], value: str = "excess") -> DataFrame:
    """Best method of each setting, the alphabetically first of equals."""
    return first_by(excess, by, F.desc(value), F.col("method"))


def method_rankings(scores: DataFrame, cls: str = "cls") -> DataFrame:
    """Mean, median and count per method over all, Specific and Shared units, mean
    ceiling efficiency, ranks and drop."""
    sp, sh = F.col(cls) == "Specific", F.col(cls) == "Shared"
    out = scores.groupBy("method").agg(
        F.avg("score").alias("mean_all"), F.percentile("score", F.lit(0.5)).alias("median_all"), F.count("score").alias("n_all"),
        F.avg(F.when(sp, F.col("score"))).alias("mean_specific"), F.percentile(F.when(sp, F.col("score")), F.lit(0.5)).alias("median_specific"), F.count(F.when(sp, F.col("score"))).alias("n_specific"),
        F.avg(F.when(sh, F.col("score"))).alias("mean_shared"), F.count(F.when(sh, F.col("score"))).alias("n_shared"), F.avg("ce").alias("mean_ce"),
    )
    out = out.withColumn("rank_all", S.rank_truncated(F.desc("mean_all"), "mean_all", [])).withColumn("rank_specific", S.rank_truncated(F.desc_nulls_last("mean_specific"), "mean_specific", []))
    return out.withColumn("rank_delta", F.col("rank_all") - F.col("rank_specific")).withColumn("drop_specific", F.col("mean_all") - F.col("mean_specific"))


def shared_fraction(scores: DataFrame, baseline: str) -> DataFrame:
    """Share of a method's score that the baseline reaches on the same unit."""
    w = Window.partitionBy("dataset", "unit", "fold")
    out = scores.withColumn("base", F.max(F.when(F.col("method") == baseline, F.col("score"))).over(w))
    return out.where(F.col("method") != baseline).withColumn("shared_fraction", S.guarded_ratio(F.col("base"), F.col("score")))


def win_rate(scores: DataFrame, baseline: str) -> DataFrame:
    rows = fold_excess(scores, baseline)
    return rows.groupBy("method").agg((F.avg((F.col("excess") > 0).cast("int")) * 100).alias("win_pct"), F.count("*").alias("n"))


def relabel(df: DataFrame, other: DataFrame, key: list[str], label: str) -> DataFrame:
    """``df`` with the label that ``other`` has for its key; where it has none, its own stays."""
    swap = first_by(other.select(*key, F.col(label).alias("swapped")), key, F.col("swapped"))
    return df.join(swap, key, "left").withColumn(label, F.coalesce("swapped", label)).drop("swapped")
