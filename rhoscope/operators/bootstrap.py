"""Stratified paired bootstrap of ranks, and bootstrap intervals of effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from .sampling import bootstrap_draws


def _drawn_excess(units: DataFrame, iterations: int, salt: str) -> DataFrame:
    """(iter, method, dataset): mean excess of the drawn units, all and Specific ones.

    Units are drawn within (dataset, class), the same draw for all methods; draws
    are joined to the scores, so a large number of iterations is a larger join,
    not a loop.
    """
    strata = ["dataset", "cls"]
    drawn = bootstrap_draws(units.select(*strata, "unit").distinct(), strata, ["unit"], iterations, salt)
    counts = drawn.groupBy("iter", *strata, "unit").agg(F.count("*").alias("w"))  # a unit drawn k times weighs k
    rows = counts.join(units, [*strata, "unit"])
    return rows.groupBy("iter", "method", "dataset").agg(
        F.try_divide(F.sum(F.col("w") * F.col("excess")), F.sum("w")).alias("all"),
        F.try_divide(F.sum(F.when(F.col("cls") == "Specific", F.col("w") * F.col("excess"))), F.sum(F.when(F.col("cls") == "Specific", F.col("w")))).alias("specific"),
    )


def _ranked(excess: DataFrame, by: list[str]) -> DataFrame:
    """One row for each stratum, with the min-tie rank inside (``by``, stratum).
    Excesses equal to twelve digits tie: the order of a sum must not decide a rank."""
    long = excess.select(*by, "method", F.explode(F.create_map(F.lit("all"), "all", F.lit("specific"), "specific")).alias("stratum", "excess"))
    return long.withColumn("rank", S.rank_min(F.round("excess", 12).desc_nulls_last(), "excess", [*by, "stratum"]))


def bootstrap_ranks(units: DataFrame, iterations: int, salt: str = "boot") -> DataFrame:
    """(iter, stratum, method): dataset-weighted excess and min-tie rank.

    ``units``: method, dataset, unit, cls, excess.
    """
    per = _drawn_excess(units, iterations, salt)
    return _ranked(per.groupBy("iter", "method").agg(F.avg("all").alias("all"), F.avg("specific").alias("specific")), ["iter"])


def bootstrap_ranks_by_dataset(units: DataFrame, iterations: int, least: int = 5, salt: str = "boot") -> DataFrame:
    """(iter, dataset, stratum, method): excess and rank inside each dataset that
    has ``least`` Specific units or more; others have no rows."""
    enough = units.where("cls = 'Specific'").groupBy("dataset").agg(F.countDistinct("unit").alias("n")).where(F.col("n") >= least)
    return _ranked(_drawn_excess(units.join(enough.select("dataset"), "dataset", "left_semi"), iterations, salt), ["iter", "dataset"])


def bootstrap_summary(ranks: DataFrame) -> DataFrame:
    """Median and 95 % interval of ranks, shift and excess; stable if the shift's interval holds 0."""
    at = lambda s, c: F.max(F.when(F.col("stratum") == s, F.col(c)))
    wide = ranks.groupBy("iter", "method").agg(at("all", "rank").alias("ra"), at("specific", "rank").alias("rs"), at("all", "excess").alias("xa"))
    wide = wide.withColumn("d", F.col("ra") - F.col("rs"))
    q = F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))
    out = wide.groupBy("method").agg(*[F.percentile(c, q).alias(c) for c in ("ra", "rs", "d", "xa")])
    cols = [F.col(c)[k].alias(f"{name}_{part}") for c, name in (("ra", "rank_all"), ("rs", "rank_specific"), ("d", "shift"), ("xa", "excess")) for k, part in enumerate(("low", "median", "high"))]
    return out.select("method", *cols).withColumn("stable", (F.col("shift_low") <= 0) & (F.col("shift_high") >= 0))


def effect_interval(effects: DataFrame, by: list[str], value: str, tie: list[str], iterations: int, salt: str = "ci") -> DataFrame:
    """n, mean, median, 95 % interval of the bootstrap mean and a verdict for each
    group; groups below two values have no interval."""
    units = effects.select(*by, *tie, value)
    drawn = bootstrap_draws(units, by, tie, iterations, salt)
    means = drawn.groupBy(*by, "iter").agg(F.avg(value).alias("m")).groupBy(*by).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    out = units.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("median")).join(means, by)
    out = out.withColumn("ci_low", F.when(F.col("n") > 1, F.col("q")[0])).withColumn("ci_high", F.when(F.col("n") > 1, F.col("q")[1])).drop("q")
    verdict = F.when(F.col("ci_low").isNull(), "insufficient_n").when(F.col("ci_low") > 0, "better").when(F.col("ci_high") < 0, "worse").otherwise("inconclusive")
    return out.withColumn("conclusion", verdict)
