"""Benchmark panels and fits with labels, and how stable effects are over splits and subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import stats as S
from . import inference as I
from .benchmark import first_by

#: Label of a fit whose unit has none (fixed value).
UNKNOWN = "unknown"


def join_panel(panel: DataFrame, triage: DataFrame, names: dict[str, str], order: list[str], score: str = "r2_delta") -> DataFrame:
    """Panel rows (``dataset_name``, ``perturbation``, ``score``) with the triage row
    (``dataset``, ``perturbation``, ``rho``, ...) of their unit.

    The control half of a label goes, data sets are renamed by a dictionary; rows of
    data sets outside it, and of units without triage, are left out
    (:func:`panel_retention` counts them).  Of several triage rows the first in
    ``order`` stays.  ``ce`` is missing where the ceiling is 0 or missing.
    """
    named = panel.withColumn("perturbation", K.strip_control("perturbation")).withColumn("dataset", K.vocabulary("dataset_name", names)).where("dataset is not null")
    out = named.join(first_by(triage, ["dataset", "perturbation"], *map(F.col, order)), ["dataset", "perturbation"])
    return out.withColumn("ceiling", S.ceiling("rho")).withColumn("ce", S.ratio(F.col(score), F.col("ceiling")))


def panel_retention(panel: DataFrame, triage: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rows of each panel data set, how many have a triage row, and whether its name is known."""
    known = triage.select("dataset", "perturbation", F.lit(1).alias("kept")).distinct()
    p = panel.withColumn("perturbation", K.strip_control("perturbation")).withColumn("dataset", K.vocabulary("dataset_name", names))
    g = p.join(known, ["dataset", "perturbation"], "left").groupBy("dataset_name")
    out = g.agg(F.count("*").alias("n_rows"), F.count("kept").alias("n_kept"), F.bool_or(F.col("dataset").isNotNull()).alias("mapped"))
    return out.withColumn("share", F.col("n_kept") / F.col("n_rows"))


def join_fits(fits: DataFrame, labels: DataFrame | None, key: list[str], order: list[str], label: str = "label", carry: tuple[str, ...] = ("cos_sim", "frac_systematic_var")) -> DataFrame:
    """Fits with the label of their unit, ``unknown`` where it has none or there is no
    table of labels at all; of ``carry``, columns that the labels lack are null."""
    if labels is None:
        return fits.select("*", F.lit(UNKNOWN).alias(label), *[F.lit(None).cast("double").alias(c) for c in carry])
    slim = first_by(labels, key, *map(F.col, order)).select(*key, label, *[c for c in carry if c in labels.columns])
    out = fits.join(slim, key, "left").withColumn(label, F.coalesce(label, F.lit(UNKNOWN)))
    return out.select("*", *[F.lit(None).cast("double").alias(c) for c in carry if c not in slim.columns])


def _aligned(scores: DataFrame, treatment: str, comparator: str, by: list[str], unit: str, metrics: dict[str, bool]) -> DataFrame:
    """(by, unit, subset, metric, effect): the treatment's mean score of a unit against
    each random subset's; ``metrics``: column -> whether higher is better."""
    own = scores.where(F.col("arm") == treatment).groupBy(*by, unit).agg(*[F.avg(m).alias(f"t_{m}") for m in metrics])
    drawn = scores.where(F.col("arm") == comparator).groupBy(*by, unit, "subset").agg(*[F.avg(m).alias(f"c_{m}") for m in metrics])
    each = [F.struct(F.lit(m).alias("metric"), S.directed(F.col(f"t_{m}"), F.col(f"c_{m}"), F.lit(up)).alias("effect")) for m, up in metrics.items()]
    return drawn.join(own, [*by, unit]).select(*by, unit, "subset", F.explode(F.array(*each)).alias("e")).select(*by, unit, "subset", "e.*").where("effect is not null")


def subset_stability(scores: DataFrame, treatment: str, comparator: str, by: list[str], unit: str, metrics: dict[str, bool]) -> DataFrame:
    """Spread over random subsets of the mean effect on the units they share with the
    treatment; ``pct_winning`` is the share of subsets that the treatment beats."""
    each = _aligned(scores, treatment, comparator, by, unit, metrics).groupBy(*by, "metric", "subset").agg(F.avg("effect").alias("e"))
    return each.groupBy(*by, "metric").agg(
        F.count("*").alias("n_subsets"), F.avg("e").alias("mean_effect"), F.stddev_pop("e").alias("std_effect"), F.min("e").alias("min_effect"), F.max("e").alias("max_effect"),
        (100 * F.avg((F.col("e") > 0).cast("int"))).alias("pct_winning"),
    )


def split_stability(scores: DataFrame, treatment: str, comparator: str, split: str, dataset: str, unit: str, metrics: dict[str, bool], tolerance: float = 1e-6) -> DataFrame:
    """For each split, the data sets' mean effects: number, positive ones, median, mean
    and signed-rank p.  Effects within the tolerance are left out; p needs five data sets."""
    by = [split, dataset]
    per_unit = _aligned(scores, treatment, comparator, by, unit, metrics).groupBy(*by, "metric", unit).agg(F.avg("effect").alias("e"))
    d = per_unit.groupBy(*by, "metric").agg(F.avg("e").alias("e")).where(F.abs("e") > tolerance)
    keys = [split, "metric"]
    out = d.groupBy(*keys).agg(F.count("*").alias("n_datasets"), F.count_if(F.col("e") > 0).alias("n_pos"), F.percentile("e", F.lit(0.5)).alias("median_effect"), F.avg("e").alias("mean_effect"))
    return out.join(I.wilcoxon(d, keys, "e", tolerance).select(*keys, "p_wilcoxon"), keys, "left")


def specific_terms(result: DataFrame, side: str, fdr: float = 0.05, most: int = 300, shown: int = 11) -> DataFrame:
    """Terms significant for most units on the specific side and on none of the shared
    side: of the ``most`` commonest, the first ``shown`` that are not shared.

    ``result``: unit, term, fdr and ``side``.  Equals come in the order of the term.
    Counting is distributed; what is ranked is one row a term.
    """
    sig = result.where(F.col("fdr") < fdr)
    n = sig.groupBy("term").agg(F.countDistinct(F.when(F.col(side) == "specific", F.col("unit"))).alias("n_units"), F.bool_or(F.col(side) == "shared").alias("shared"))
    common = n.where("n_units > 0").orderBy(F.desc("n_units"), "term").limit(most)
    top = common.where(~F.col("shared")).orderBy(F.desc("n_units"), "term").limit(shown)
    return top.select("term", "n_units", F.row_number().over(Window.orderBy(F.desc("n_units"), "term")).alias("place"))  # ``shown`` rows
