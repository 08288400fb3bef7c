"""Training-subset experiments as joins: arms, sweeps, weights, pools.

An arm is a set of rows (arm keys, unit, weight); predictors aggregate the
training vectors of each arm, and every test unit is scored against them.  All
arms, draws and fractions run in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from .retrain import prediction_metrics, ridge_predictor, strategy_weight
from .sampling import repeats, subset


def weighted_mean_predictor(arms: DataFrame, deltas: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean of the training deltas (weights below 0 or missing count as 0):
    ``keys``, ``g``, ``pred``; arms whose weights sum to 0 have no prediction."""
    w = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    rows = arms.join(deltas, "unit").withColumn("w", w)
    out = rows.groupBy(*keys, "g").agg(F.sum(F.col("w") * F.col("delta")).alias("s"), F.sum("w").alias("sw")).where("sw > 0")
    return out.select(*keys, "g", (F.col("s") / F.col("sw")).alias("pred"))


def weighted_scores(arms: DataFrame, tests: DataFrame, facts: DataFrame, by: list[str], base: list[str], keys: list[str]) -> DataFrame:
    """L2 and correlation of each arm's weighted mean on the test units of its job.

    ``arms``: keys (with base), unit, weight.  ``tests``: base, unit.  ``facts``: by,
    unit, g, delta.  Weights below 0 or missing count as 0; arms without weight have
    no rows.
    """
    w, delta = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)), facts.select(*by, "unit", "g", "delta")
    rows = arms.withColumn("w", w).where("w > 0").join(delta, [*by, "unit"])
    pred = rows.groupBy(*keys, "g").agg((F.sum(F.col("w") * F.col("delta")) / F.sum("w")).alias("pred"))
    met = pred.join(tests.select(*base, "unit").join(delta, [*by, "unit"]), [*base, "g"])
    return met.groupBy(*keys, "unit").agg(F.sqrt(F.sum((F.col("pred") - F.col("delta")) ** 2)).alias("l2"), S.pearson_or_null("pred", "delta").alias("pcc"))


def score_units(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """L2 and correlation of each arm's prediction with every test unit's delta."""
    j = pred.join(truth.select("unit", "g", "delta"), "g")
    return j.groupBy(*keys, "unit").agg(F.sqrt(F.sum((F.col("pred") - F.col("delta")) ** 2)).alias("l2"), S.pearson_or_null("pred", "delta").alias("pcc"))


def model_scores(arms: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(model, ``keys``, unit): L2 and correlation of the mean and the bilinear
    predictor of each arm on every unit.

    ``arms``: keys, unit, optional weight.  ``vectors``: unit, target, expr, delta
    (arrays).  Arms whose weights sum to 0 have no rows; an arm too small for the
    bilinear model, or a unit without a known target, has no bilinear row.  Arms
    are as many as the question asks for, so their keys may be broadcast; each arm
    is fitted in a task of its own.
    """
    truth = vectors.select("unit", F.posexplode("delta").alias("g", "delta"))
    weighted = "weight" in arms.columns
    if weighted:
        some = arms.groupBy(*keys).agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("w")).where("w > 0").select(*keys)
        arms = arms.join(some, keys, "left_semi")
    even = arms if weighted else arms.withColumn("weight", F.lit(1.0))
    mean = score_units(weighted_mean_predictor(even, truth, keys), truth, keys).withColumn("model", F.lit("mean"))
    train = arms.join(vectors, "unit").select(*keys, "unit", "target", "expr", "delta", *["weight"][:weighted])
    test = vectors.select("unit", "target").crossJoin(F.broadcast(arms.select(*keys).distinct()))
    rows = prediction_metrics(ridge_predictor(train, test, keys), truth, [*keys, "unit"]).withColumn("model", F.lit("bilinear"))
    columns = ["model", *keys, "unit", "l2", "pcc"]
    return mean.select(*columns).unionByName(rows.select(*columns))


def quantity_arms(pool: DataFrame, fractions: list[float], draws: int, least: int = 2, salt: str = "qty", by: list[str] = []) -> DataFrame:
    """Random subsets of the pool of each ``by``: (by, frac, draw, unit), of
    max(least, round(frac n)) units."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))  # without ``by``: units of one pool
    grid = repeats(pool.select(*by, "unit", n.alias("n_pool")).withColumn("frac", F.explode(F.array(*map(F.lit, fractions)))), draws, "draw")
    grid = grid.withColumn("size", F.greatest(F.lit(least), F.bround(F.col("frac") * F.col("n_pool"), 0)))
    return subset(grid, [*by, "frac", "draw"], [F.lit(salt), *by, "frac", "draw", "unit"], "unit", F.col("size")).select(*by, "frac", "draw", "unit")


def scaling_arms(members: DataFrame, fractions: list[float], draws: int, least: int = 8, salt: str = "pool", by: list[str] = []) -> DataFrame:
    """Random subsets of every pool of ``least`` units or more: (by, pool, frac, draw, unit);
    ``members``: by, pool, unit.  The whole pool is drawn once."""
    n = members.groupBy(*by, "pool").agg(F.count("*").alias("n_pool")).where(F.col("n_pool") >= least)
    drawn = [F.struct(F.lit(f).alias("frac"), F.lit(r).alias("draw")) for f in fractions for r in range(1, (draws if f < 1 else 1) + 1)]
    cells = F.explode(F.array(*drawn)).alias("c")
    grid = members.join(n, [*by, "pool"]).select(*by, "pool", "unit", "n_pool", cells).select(*by, "pool", "unit", "n_pool", "c.*")
    grid = grid.withColumn("size", F.greatest(F.lit(1), F.bround(F.col("frac") * F.col("n_pool"), 0)))
    of = [*by, "pool", "frac", "draw"]
    return subset(grid, of, [F.lit(salt), *of, "unit"], "unit", F.col("size")).select(*of, "unit")


def strategy_arms(units: DataFrame, strategies: list[str], by: list[str] = []) -> DataFrame:
    """(by, strategy, unit, weight) of filter-or-weight strategies; ``units``: by, unit, rho, phi, label."""
    w = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), strategy_weight(s, F.col("rho"), F.col("phi"), F.col("label")).alias("weight")) for s in strategies])).alias("w")
    return units.select(*by, "unit", w).select(*by, "w.strategy", "unit", "w.weight")


def pool_members(units: DataFrame, pools: dict[str, Column], by: list[str] = []) -> DataFrame:
    """(by, pool, unit) for every named predicate that holds."""
    hit = F.array_compact(F.array(*[F.when(c, F.lit(p)) for p, c in pools.items()]))
    return units.select(*by, F.explode(hit).alias("pool"), "unit")


def relative_to(scores: DataFrame, by: list[str], value: str, reference: Column, within: list[str] = []) -> DataFrame:
    """Mean of each group divided by the mean of the reference group of its ``within``."""
    means = scores.groupBy(*within, *by).agg(F.avg(value).alias("mean"))
    ref = F.max(F.when(reference, F.col("mean"))).over(Window.partitionBy(*within))  # groups of the question
    return means.select(*within, *by, "mean", F.try_divide("mean", F.nullif(ref, F.lit(0.0))).alias("relative"))
