"""Queries that join panels and fits with labels, stability of effects over splits and
subsets, densities, files named by their data set; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import density as D
from ..operators import experiments as P
from ..operators import holdout as H
from ..operators import panels as J
from ..operators import saturation as N
from ..sources import fixtures as X
from ..sources import readers as IO
from .catalog import AXIS, POINTS, REL, SCORES, _points, _triage, _units, query, r6, rounded
from .heldout import _BASE, _SCORED, _SET, BASE, BY, DRAWS, HOLD, LEAST_TEST, _arms_sql, _facts, _members, _tests

# --- panels and fits -----------------------------------------------------------------------------

#: Names of a panel's data sets; one of the five is not in it.
PANELS = {"africa": "AFRICA", "america": "AMERICA", "asia": "ASIA", "europe": "EUROPE"}


def _panel(spark, d):
    """Score rows as a panel writes them: lower-case names, single perturbations with the control."""
    s = X.scores(spark, d)
    label = F.when(F.col("fold") % 2 == 0, F.concat("unit", F.lit("+ctrl"))).otherwise(F.col("unit"))
    return s.select("method", F.lower("dataset").alias("dataset_name"), label.alias("perturbation"), "fold", F.col("score").alias("r2_delta"))


def _panel_triage(spark, d):
    """Units above 0.15 only, so that some panel rows have none."""
    return _units(spark, d).where("rho > 0.15").select("dataset", F.col("unit").alias("perturbation"), "rho", "cos", F.col("cls").alias("label"))


@query(f"""WITH {SCORES} SELECT sc.dataset, sc.unit AS perturbation, method, fold, cls AS label, {r6('score AS r2_delta', 'sqrt(rho) AS ceiling', 'score / nullif(sqrt(rho), 0) AS ce')}
FROM sc JOIN uc USING (dataset, unit) WHERE rho > 0.15 AND dataset <> 'MIDDLE EAST'""")
def panel_join(spark, d):
    out = J.join_panel(_panel(spark, d), _panel_triage(spark, d), PANELS, ["rho", "label"])
    return rounded(out.select("dataset", "perturbation", "method", "fold", "label", "r2_delta", "ceiling", "ce"))


@query(f"""WITH {SCORES} SELECT lower(dataset) AS dataset_name, count(*) AS n_rows, count(*) FILTER (rho > 0.15 AND dataset <> 'MIDDLE EAST') AS n_kept, dataset <> 'MIDDLE EAST' AS mapped,
  {r6("count(*) FILTER (rho > 0.15 AND dataset <> 'MIDDLE EAST') / count(*) AS share")} FROM sq GROUP BY dataset""")
def panel_retention(spark, d):
    return rounded(J.panel_retention(_panel(spark, d), _panel_triage(spark, d), PANELS))


FITTED = f"{AXIS}{POINTS.removeprefix(REL)}"


@query(f"""WITH {FITTED}, l AS (SELECT unit, label, cos_sim FROM tri WHERE unit % 3 <> 0)
SELECT unit::BIGINT AS unit, {r6('tau_sq', 'fit_r2')}, coalesce(label, 'unknown') AS label, {r6('cos_sim', 'cos_sim * cos_sim AS frac_systematic_var')} FROM ft LEFT JOIN l USING (unit)""")
def fit_labels(spark, d):
    """Fits of all units; a third of them has no label."""
    t = _triage(spark, d).where("unit % 3 != 0").select("unit", "label", "cos_sim", (F.col("cos_sim") * F.col("cos_sim")).alias("frac_systematic_var"))
    out = J.join_fits(N.fit_on_grid(_points(spark, d), ["unit"]), t, ["unit"], ["label"])
    return rounded(out.select("unit", "tau_sq", "fit_r2", "label", "cos_sim", "frac_systematic_var"))


# --- stability -----------------------------------------------------------------------------------

METRICS = {"l2": False, "pcc": True}
EFFECTS = f"""{HOLD}, {_arms_sql('hs', _BASE)}, te AS (SELECT * FROM hs WHERE split = 'test' AND label = 'Specific' AND kind = 'single'), a AS (SELECT *, 1.0::DOUBLE AS w FROM ar WHERE arm IN ('genuine', 'random_matched')), {_SCORED.format(_SET)},
ef AS (SELECT {_BASE}, c.subset, unit, unnest(['l2', 'pcc']) AS metric, unnest([c.l2 - t.l2, t.pcc - c.pcc]) AS effect FROM (SELECT * FROM s WHERE arm = 'random_matched') c JOIN (SELECT {_BASE}, unit, l2, pcc FROM s WHERE arm = 'genuine') t USING ({_BASE}, unit)),
ok AS (SELECT * FROM ef WHERE effect IS NOT NULL)"""


def _stability_scores(spark, d):
    """Mean model of the genuine and the random arms on genuine single test units."""
    members, facts = _members(spark, d), _facts(spark, d)
    arms = H.training_arms(members, H.jobs(members, BASE, least_test=LEAST_TEST), BASE, DRAWS).where("arm in ('genuine', 'random_matched')").withColumn("weight", F.lit(1.0))
    return P.weighted_scores(arms, _tests(members).where("label = 'Specific' and kind = 'single'"), facts, BY, BASE, [*BASE, "arm", "subset"])


@query(f"""WITH {EFFECTS}, e AS (SELECT {_BASE}, metric, subset, avg(effect) AS e FROM ok GROUP BY ALL)
SELECT {_BASE}, metric, count(*) AS n_subsets, {r6('avg(e) AS mean_effect', 'stddev_pop(e) AS std_effect', 'min(e) AS min_effect', 'max(e) AS max_effect')}, {r6('100 * avg((round(e, 9) > 0)::INT) AS pct_winning')} FROM e GROUP BY ALL""")
def subset_stability(spark, d):
    """Each random subset against the genuine arm: spread of the effect in every data set and split."""
    return rounded(J.subset_stability(_stability_scores(spark, d), "genuine", "random_matched", BASE, "unit", METRICS))


@query(f"""WITH {EFFECTS}, u AS (SELECT {_BASE}, metric, unit, avg(effect) AS e FROM ok GROUP BY ALL), v AS (SELECT {_BASE}, metric, avg(e) AS e FROM u GROUP BY ALL)
SELECT split_seed, metric, count(*) AS n_datasets, count(*) FILTER (e > 0) AS n_pos, {r6('quantile_cont(e, 0.5) AS median_effect', 'avg(e) AS mean_effect')}, NULL::DOUBLE AS p_wilcoxon FROM v WHERE abs(e) > 1e-6 GROUP BY ALL""")
def split_stability(spark, d):
    """Effects of the data sets in each split; two data sets are too few for a p (five), which stays null."""
    return rounded(J.split_stability(_stability_scores(spark, d), "genuine", "random_matched", "split_seed", "dataset", "unit", METRICS))


# --- density -------------------------------------------------------------------------------------

_CORNERS = ", ".join(f"SELECT {{0}}, floor(p)::BIGINT + {a} AS i, floor(q)::BIGINT + {b} AS j, {'(p - floor(p))' if a else '(1 - (p - floor(p)))'} * {'(q - floor(q))' if b else '(1 - (q - floor(q)))'} AS w FROM {{1}}" for a in (0, 1) for b in (0, 1)).replace(", SELECT", " UNION ALL SELECT")
_KERNEL = f"(SELECT o, exp(-(o * o) / {2.0 * D.CELLS**2}) / (sqrt(2 * pi()) * {D.CELLS}) AS k FROM (SELECT unnest(range({-D.REACH * D.CELLS}, {D.REACH * D.CELLS + 1})) AS o))"


@query(f"""WITH pt AS (SELECT l_returnflag AS flag, l_orderkey, l_linenumber, l_quantity::DOUBLE AS x, log10(l_extendedprice::DOUBLE) AS y FROM lineitem),
st AS (SELECT flag, count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_samp(x) AS sx, covar_samp(x, y) / stddev_samp(x) AS b, sqrt(var_samp(y) - covar_samp(x, y) * covar_samp(x, y) / var_samp(x)) AS s, (count(*)::DOUBLE ** (-1 / 6.0::DOUBLE)) / {D.CELLS} AS dl FROM pt GROUP BY flag),
gp AS (SELECT *, u / dl AS p, (y - my - b * u) / s / dl AS q FROM (SELECT *, (x - mx) / sx AS u FROM pt JOIN st USING (flag))),
g0 AS (SELECT flag, i, j, sum(w) AS w FROM ({_CORNERS.format('flag', 'gp')}) GROUP BY ALL),
g1 AS (SELECT flag, i + o AS i, j, sum(w * k) AS w FROM g0, {_KERNEL} GROUP BY ALL),
g2 AS (SELECT flag, i, j + o AS j, sum(w * k) AS f FROM g1, {_KERNEL} GROUP BY ALL),
pl AS (SELECT DISTINCT flag, x, y, p, q, n * dl * dl * sx * s AS area FROM gp),
rd AS (SELECT flag, x, y, sum(w * f) / max(area) AS density FROM ({_CORNERS.format('flag, x, y, area', 'pl')}) JOIN g2 USING (flag, i, j) GROUP BY flag, x, y)
SELECT flag, count(*) AS n, {r6('min(density) AS low', 'quantile_cont(density, 0.5) AS median', 'max(density) AS high', 'avg(density) AS mean')} FROM pt JOIN rd USING (flag, x, y) GROUP BY flag""")
def density_of_lines(spark, d):
    """Density of quantity and logarithm of price at every line, within each return flag, described."""
    p = IO.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("double").alias("x"), F.log10(F.col("l_extendedprice").cast("double")).alias("y"))
    return rounded(D.summary(D.density_2d(p, "x", "y", ["flag"]), ["flag"], "density"))


# --- files ---------------------------------------------------------------------------------------


@query("SELECT 'segment_' || (c_custkey % 4) AS dataset, count(*) AS n, min(c_custkey)::BIGINT AS low, max(c_custkey)::BIGINT AS high FROM customer GROUP BY ALL")
def glob_of_stems(spark, d):
    """Four files named by their data set and a summary, written, then read by one glob that leaves the summary out."""
    path = IO.scratch(spark)
    c = IO.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    for k in range(4):
        IO.write_csv(c.where(F.col("k") % 4 == k), f"{path}/segment_{k}.csv")
    IO.write_csv(c.agg(F.max("k").alias("k")), f"{path}/segment_summary.csv")
    t = IO.read_stems(spark, f"{path}/*.csv", "k long")
    return t.groupBy("dataset").agg(F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"))
