"""Three-way quality labels and their summaries.

The three labelling rules differ in what a missing value means; each keeps its
own function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RHO, COS = 0.5, 0.5**0.5
CLASSES = ("Unreliable", "Shared", "Specific")


def label(rho: Column, cos: Column, rho_min: float | Column = RHO, cos_min: float | Column = COS) -> Column:
    """Missing rho: Unreliable; reliable with missing cos: Specific."""
    ok = F.coalesce(rho >= rho_min, F.lit(False))
    return F.when(~ok, "Unreliable").when(F.coalesce(cos >= cos_min, F.lit(False)), "Shared").otherwise("Specific")


def label_alternative(rho: Column, cos: Column, rho_min: float | Column, cos_min: float | Column) -> Column:
    """Missing rho or cos: Specific."""
    return F.when(rho < rho_min, "Unreliable").when((rho >= rho_min) & (cos >= cos_min), "Shared").otherwise("Specific")


def label_scalar(rho: Column, cos: Column, rho_min: float = RHO, cos_min: float = COS) -> Column:
    """Missing rho: Unreliable; missing cos: Shared."""
    return F.when(rho.isNull() | (rho < rho_min), "Unreliable").when(cos.isNull() | (cos >= cos_min), "Shared").otherwise("Specific")


def pool(name: str, rho: Column, label_: Column, rho_min: float = RHO) -> Column:
    """Predicate of a training pool; missing rho is in neither half."""
    return {"all": F.lit(True), "reliable": rho >= rho_min, "unreliable": rho < rho_min, "specific": label_ == "Specific", "shared": label_ == "Shared"}[name]


def energy_label(rho_e: Column, cos: Column) -> Column:
    """Reliable at rho_E >= 0 (a degenerate 0 counts), shared at cos^2 >= 0.5."""
    ok = F.coalesce(rho_e >= 0, F.lit(False))
    return F.when(~ok, "Unreliable").when(F.coalesce(cos * cos >= 0.5, F.lit(False)), "Shared").otherwise("Specific")


def class_shares(df: DataFrame, scope: str, label_: str = "label") -> DataFrame:
    """Counts and shares of the classes, for every scope and over all (scope 'all')."""
    aggs = [F.count("*").alias("n_total")]
    for c in CLASSES:
        hit = (F.col(label_) == c).cast("int")
        aggs += [F.sum(hit).cast("long").alias(f"n_{c.lower()}"), F.avg(hit).alias(f"frac_{c.lower()}")]
    out = df.groupingSets([[], [F.col(scope)]], F.col(scope)).agg(F.grouping_id().alias("gid"), *aggs)
    return out.withColumn(scope, F.when(F.col("gid") > 0, "all").otherwise(F.col(scope).cast("string"))).drop("gid")


def class_crosstab(df: DataFrame, by: str, label_: str = "label") -> DataFrame:
    """Row-normalised shares, absent classes as 0."""
    wide = df.groupBy(by).pivot(label_, list(CLASSES)).count().na.fill(0, list(CLASSES))
    total = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0]))
    return wide.select(by, *[(F.col(c) / total).alias(f"frac_{c.lower()}") for c in CLASSES])
