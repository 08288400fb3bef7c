"""Held-out experiments: queries over datasets x splits, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import stats as S
from ..operators import bootstrap as BS
from ..operators import experiments as P
from ..operators import gram as M
from ..operators import holdout as H
from ..operators import reliability as R
from ..operators import retrain as T
from ..operators import sampling as W
from ..operators import triage as C
from ..sources import fixtures as X
from ..sources.readers import settle
from .catalog import AXIS, BOOT, CELLS, TOPK, _by_context, _context_triage, query, r6, rounded

SPLITS, DRAWS = 5, 50
#: Test units that a job needs; the operator's own least is 5, the tables give each dataset some 45 units.
LEAST_TEST = 2
RHOS, COSINES = [0.3, 0.4, 0.5, 0.6, 0.7], [0.4, 0.5, 0.7071, 0.8, 0.9]
BY, BASE = ["dataset"], ["dataset", "split_seed"]
CELL = [*BASE, "rho_min", "cos_min"]

HOLD = f"""{CELLS},
tri2 AS ({_by_context(AXIS, 'vec_id % 2', range(2), 'SELECT unit, rho, cos_sim, label FROM tri')}),
ec AS (SELECT cell % 2 AS dataset, CASE WHEN unit = 0 THEN 0 ELSE 5 * unit + (cell // 2) % 5 END AS unit, g, x FROM cells),
em AS (SELECT dataset, unit, g, avg(x) AS m, var_samp(x) AS v, count(*) AS n FROM ec GROUP BY ALL),
ed AS (SELECT a.dataset, a.unit, a.g, a.m - b.m AS delta, b.m AS m0, coalesce((a.m - b.m) / nullif(sqrt(a.v / a.n + b.v / b.n), 0), 0) AS t FROM em a JOIN em b ON a.dataset = b.dataset AND a.g = b.g AND b.unit = 0 WHERE a.unit <> 0 AND a.n >= 3),
tf AS (SELECT dataset, unit, g, delta, m0, row_number() OVER (PARTITION BY dataset, unit ORDER BY abs(t) DESC, g) <= {TOPK} AS top_t, row_number() OVER (PARTITION BY dataset, unit ORDER BY m0 DESC, g) <= {TOPK} AS top_e FROM ed),
eu AS (
  SELECT *, CASE k WHEN 4 THEN 'g' || (5 * p) || '+' || CASE WHEN p % 3 = 0 THEN 'x' || p ELSE 'g' || (5 * (p % 9 + 1) + 1) END WHEN 3 THEN 'x' || unit ELSE 'g' || unit END AS name
  FROM (SELECT DISTINCT dataset, unit, unit // 5 AS p, unit % 5 AS k FROM ed)),
ev AS (SELECT eu.dataset, eu.unit, name, CASE WHEN k = 4 THEN 'double' ELSE 'single' END AS kind, rho, cos_sim, coalesce(label, 'Unreliable') AS label FROM eu LEFT JOIN tri2 ON tri2.context = eu.dataset AND tri2.unit = eu.p),
hs AS (SELECT dataset, split_seed, unit, name, kind, rho, cos_sim, label, CASE WHEN n >= 2 AND rk <= greatest(1, round_even(0.25 * n, 0)) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY dataset, split_seed, label, kind ORDER BY md5('split:' || split_seed || ':' || dataset || ':' || unit), unit) AS rk
  FROM ev, (SELECT unnest(range(1, {SPLITS + 1})) AS split_seed) WINDOW w AS (PARTITION BY dataset, split_seed, label, kind)))"""

LATTICE = f"""{HOLD}, hl AS (
  SELECT dataset, split_seed, rho_min, cos_min, unit, name, kind, split, CASE WHEN NOT coalesce(rho >= rho_min, false) THEN 'Unreliable' WHEN coalesce(cos_sim >= cos_min, false) THEN 'Shared' ELSE 'Specific' END AS label
  FROM hs, (VALUES ({'::DOUBLE), ('.join(map(str, RHOS))}::DOUBLE)) a(rho_min), (VALUES ({'::DOUBLE), ('.join(map(str, COSINES))}::DOUBLE)) b(cos_min))"""


def _jobs_sql(members: str, keys: str) -> str:
    ok = "label = 'Specific'"
    return f"""jb AS (SELECT {keys}, {', '.join(f'sum({c})::BIGINT AS {c}' for c in H.COUNTS)}, min(n_rest_train - n_genuine_train) AS spare FROM (
  SELECT {keys}, kind, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split = 'train' AND {ok}) AS n_genuine_train,
    count(*) FILTER (split = 'test' AND {ok}) AS n_genuine_test, count(*) FILTER (split = 'train' AND NOT {ok}) AS n_rest_train FROM {members} GROUP BY {keys}, kind) GROUP BY {keys}),
jr AS (SELECT *, CASE WHEN n_genuine_train < 5 THEN 'genuine_train_below_5' WHEN n_genuine_test < {LEAST_TEST} THEN 'genuine_test_below_{LEAST_TEST}' END AS reason,
  CASE WHEN n_rest_train < 5 THEN 'rest_train_below_5' WHEN spare < 0 THEN 'rest_kinds_too_few' END AS rest_reason FROM jb)"""


def _arms_sql(members: str, keys: str) -> str:
    using = f"USING ({keys})"
    return f"""{_jobs_sql(members, keys)},
tn AS (SELECT m.*, rest_reason FROM {members} m JOIN jr {using} WHERE reason IS NULL AND split = 'train'),
nd AS (SELECT {keys}, kind, count(*) AS need FROM tn WHERE label = 'Specific' GROUP BY ALL),
rd AS (SELECT {keys}, arm, subset, unit, need, row_number() OVER (PARTITION BY {keys}, arm, subset, kind ORDER BY md5(arm || ':' || split_seed || ':' || subset || ':' || unit), unit) AS rk
  FROM (SELECT *, 'random_matched' AS arm FROM tn UNION ALL SELECT *, 'random_rest' FROM tn WHERE label <> 'Specific' AND rest_reason IS NULL) JOIN nd USING ({keys}, kind), (SELECT unnest(range(1, {DRAWS + 1})) AS subset)),
ar AS (SELECT {keys}, 'all' AS arm, 0 AS subset, unit FROM tn UNION ALL SELECT {keys}, 'genuine', 0, unit FROM tn WHERE label = 'Specific' UNION ALL SELECT {keys}, arm, subset, unit FROM rd WHERE rk <= need)"""


_GUARD = "CASE WHEN stddev_pop({0}) >= 1e-12 AND stddev_pop({1}) >= 1e-12 THEN covar_pop({0}, {1}) / (stddev_pop({0}) * stddev_pop({1})) END"


def _in(hit: str, c: str) -> str:
    return f"(CASE WHEN {hit} THEN {c} END)"


def _members(spark: SparkSession, d: str) -> DataFrame:
    """(dataset, split_seed, unit, name, kind, rho, cos_sim, label, split)."""
    cells = X.experiment_cells(spark, d)
    units = R.centroids(cells, BY).where("unit != 0 and n >= 3").select(*BY, "unit").distinct().withColumn("name", X.experiment_name())
    of = _context_triage(spark, d).select(F.col("context").alias("dataset"), F.col("unit").alias("parent"), "rho", "cos_sim", "label")
    units = units.withColumn("parent", F.expr(f"unit div {X.PARTS}")).join(of, [*BY, "parent"], "left").drop("parent")
    units = units.withColumn("label", F.coalesce("label", F.lit("Unreliable"))).withColumn("kind", K.label_type("name"))
    return settle(H.splits(units, BY, SPLITS))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    cells = X.experiment_cells(spark, d)
    deltas = R.deltas(cells, by=BY).where("n >= 3")
    control = R.centroids(cells, BY).where("unit = 0").select(*BY, "g", "m")
    return settle(H.truth(deltas, R.welch_t(cells, by=BY), control, BY, TOPK))


@query(f"""WITH {LATTICE}, {_jobs_sql('hl', ', '.join(CELL))}
SELECT {', '.join(CELL)}, NULL::VARCHAR AS arm, reason, {', '.join(H.COUNTS)} FROM jr WHERE reason IS NOT NULL
UNION ALL SELECT {', '.join(CELL)}, 'random_rest', rest_reason, {', '.join(H.COUNTS)} FROM jr WHERE reason IS NULL AND rest_reason IS NOT NULL""")
def holdout_skips(spark, d):
    """What every cell of the threshold lattice leaves out, and why."""
    job = H.jobs(H.lattice(_members(spark, d), RHOS, COSINES), CELL, least_test=LEAST_TEST)
    out = H.skipped(job, CELL)
    return out.select(*[F.col(c).cast("long").alias(c) if c == "split_seed" else F.col(c) for c in out.columns])


_BASE, _SET = ", ".join(BASE), f"{', '.join(BASE)}, arm, subset"
_METRIC_SQL = f"""{_GUARD.format(_in('top_t', 'pred'), _in('top_t', 'delta'))} AS pcc_top, avg({_in('top_t', '(pred - delta) ** 2')}) AS mse_top,
  CASE WHEN least(sum(top_p::INT), sum(top_t::INT)) >= 2 THEN sum((top_p AND top_t)::INT) / least(sum(top_p::INT), sum(top_t::INT)) END AS overlap_top,
  sqrt(sum({_in('top_e', '(pred - delta) ** 2')})) AS l2_expr, {_GUARD.format(_in('top_e', 'pred'), _in('top_e', 'delta'))} AS pcc_expr, {_GUARD.format(_in('top_e', '(m0 + pred)'), _in('top_e', '(m0 + delta)'))} AS r_raw,
  sqrt(sum((pred - delta) ** 2)) AS l2, {_GUARD.format('pred', 'delta')} AS pcc"""


@query(f"""WITH {HOLD}, {_arms_sql('hs', _BASE)},
pm AS (SELECT *, row_number() OVER (PARTITION BY {_SET} ORDER BY abs(pred) DESC, g) <= {TOPK} AS top_p FROM (SELECT {_SET}, g, avg(delta) AS pred FROM ar JOIN tf USING (dataset, unit) GROUP BY ALL)),
te AS (SELECT {_BASE}, unit, name, label, kind FROM hs WHERE split = 'test'),
sm AS (SELECT {_SET}, unit, {_METRIC_SQL} FROM pm JOIN te USING ({_BASE}) JOIN tf USING (dataset, unit, g) GROUP BY ALL),
mm AS (SELECT 'mean' AS model, *, CASE WHEN count(*) OVER (PARTITION BY {_SET}) > 1 THEN (rank() OVER (PARTITION BY {_SET} ORDER BY l2 DESC) - 1) / (count(*) OVER (PARTITION BY {_SET}) - 1) END AS centroid FROM sm),
cb AS (SELECT {_BASE}, unit AS combo, unnest(string_split(name, '+')) AS part FROM te WHERE kind = 'double'),
fa AS (SELECT {_SET}, combo, list(unit) AS units FROM ar JOIN (SELECT dataset, unit, name FROM ev WHERE kind = 'single') s USING (dataset, unit) JOIN cb USING ({_BASE}) WHERE part = name GROUP BY {_SET}, combo HAVING count(*) = 2),
pa AS (SELECT *, row_number() OVER (PARTITION BY {_SET}, unit ORDER BY abs(pred) DESC, g) <= {TOPK} AS top_p FROM (SELECT {_SET}, combo AS unit, g, sum(delta) AS pred FROM (SELECT {_SET}, combo, unnest(units) AS unit FROM fa) x JOIN tf USING (dataset, unit) GROUP BY {_SET}, combo, g)),
sa AS (SELECT {_SET}, unit, {_METRIC_SQL} FROM pa JOIN tf USING (dataset, unit, g) GROUP BY ALL),
da AS (SELECT {_SET}, i, unit AS j, sqrt(sum((pred - delta) ** 2)) AS d FROM (SELECT {_SET}, unit AS i, g, pred FROM pa) x JOIN (SELECT {_SET}, combo AS unit FROM fa) y USING ({_SET}) JOIN tf USING (dataset, unit, g) GROUP BY ALL),
na AS (SELECT {_SET}, i AS unit, CASE WHEN count(*) > 1 THEN count(*) FILTER (d > d0) / (count(*) - 1) END AS centroid FROM (SELECT *, max(d) FILTER (i = j) OVER (PARTITION BY {_SET}, i) AS d0 FROM da) GROUP BY {_SET}, i),
mo AS (SELECT * FROM mm UNION ALL BY NAME SELECT 'additive' AS model, sa.*, centroid FROM sa JOIN na USING ({_SET}, unit)),
nt AS (SELECT {_SET}, count(*) AS n_train FROM ar GROUP BY ALL)
SELECT model, dataset, split_seed, arm, subset::BIGINT AS subset, unit::BIGINT AS unit, label, kind, n_train, {', '.join(r6(m) for m in H.METRICS)} FROM mo JOIN te USING ({_BASE}, unit) JOIN nt USING ({_SET})""")
def holdout_scores(spark, d):
    """Mean and additive model of every arm on the test units of its job: two datasets, five splits."""
    members, facts = _members(spark, d), _facts(spark, d)
    arms = settle(H.training_arms(members, H.jobs(members, BASE, least_test=LEAST_TEST), BASE, DRAWS))
    sets, arm_of = H.distinct_arms(arms, BASE, BASE)
    tests = members.where("split = 'test'").select(*BASE, "unit", "label", "kind")
    whom, names = tests.select(*BASE, "unit"), members.select(*BY, "unit", "name").distinct()
    by_set = {"mean": H.mean_scores(sets, whom, facts, BY, BASE, TOPK), "additive": H.additive_scores(sets, whom, facts, names, BY, BASE, TOPK)}
    return rounded(H.scores(arm_of, by_set, tests, BASE, BASE, list(H.METRICS)))


def _grams(spark: SparkSession, d: str, members: DataFrame, facts: DataFrame) -> DataFrame:
    values = R.centroids(X.experiment_cells(spark, d), BY).select(*BY, "unit", "g", "m").join(facts.select(*BY, "unit", "g", "delta", "top_e"), [*BY, "unit", "g"])
    parts = K.components("name")
    each = members.select(*BY, "unit", "name").distinct().select(*BY, "unit", F.size(parts).alias("parts"), F.explode(parts).alias("part"))
    gene = F.when(F.col("part").startswith("g"), F.substring("part", 2, 9).cast("int")).otherwise(-1)
    return M.gram(values, each.select(*BY, "unit", gene.alias("g"), "parts"), BY)


@query()
def holdout_models(spark, d):
    """The bilinear and the mean model of every arm, all fitted on one Gram matrix per dataset."""
    members, facts = _members(spark, d), _facts(spark, d)
    arms = settle(H.training_arms(members, H.jobs(members, BASE, least_test=LEAST_TEST), BASE, DRAWS))
    sets, arm_of = H.distinct_arms(arms, BASE, BASE)
    tests = members.where("split = 'test'").select(*BASE, "unit", "label", "kind")
    s = M.gram_scores(_grams(spark, d, members, facts), sets, tests, BY, BASE)
    rows = arm_of.join(s, [*BASE, "set"]).drop("set").join(tests, [*BASE, "unit"])
    return rounded(rows.select("model", *BASE, "arm", "subset", "unit", "label", "kind", "n_train", *M.METRICS))


# --- thresholds through the whole chain ----------------------------------------------------------

_CELL = ", ".join(CELL)
_GROUP = "rho_min, cos_min, dataset, comparator, metric"
SWEEP = f"""{LATTICE}, {_arms_sql('hl', _CELL)},
pm AS (SELECT {_CELL}, arm, subset, g, avg(delta) AS pred FROM ar JOIN tf USING (dataset, unit) GROUP BY ALL),
te AS (SELECT {_CELL}, unit, label FROM hl WHERE split = 'test' AND label = 'Specific'),
sm AS (SELECT {_CELL}, arm, subset, unit, sqrt(sum((pred - delta) ** 2)) AS l2, {_GUARD.format('pred', 'delta')} AS pcc FROM pm JOIN te USING ({_CELL}) JOIN tf USING (dataset, unit, g) GROUP BY ALL),
sv AS (SELECT {_CELL}, arm, unit, avg(l2) AS l2, avg(pcc) AS pcc FROM sm GROUP BY ALL),
ef AS (
  SELECT {', '.join(f'c.{k}' for k in CELL)}, c.arm AS comparator, c.unit, unnest(['l2', 'pcc']) AS metric, unnest([c.l2 - t.l2, t.pcc - c.pcc]) AS effect
  FROM sv c JOIN sv t USING ({_CELL}, unit) WHERE t.arm = 'genuine' AND c.arm <> 'genuine'),
pe AS (SELECT {_GROUP}, unit, round(avg(effect), 9) AS effect FROM ef WHERE effect IS NOT NULL GROUP BY ALL)"""


def _sweep_effects(spark: SparkSession, d: str) -> DataFrame:
    """Effects of the genuine arm on genuine test units, averaged over the splits in
    which a unit is tested: (rho_min, cos_min, dataset, comparator, metric, unit, effect).

    Cells, splits and vectors are made once; cells that lead to the same arm share
    its scores.
    """
    members, facts = _members(spark, d), _facts(spark, d)
    cells = H.lattice(members, RHOS, COSINES)
    arms = settle(H.training_arms(cells, H.jobs(cells, CELL, least_test=LEAST_TEST), CELL, DRAWS))
    sets, arm_of = H.distinct_arms(arms, BASE, CELL)
    tests = cells.where("split = 'test' and label = 'Specific'").select(*CELL, "unit", "label", "kind")
    whom = members.where("split = 'test'").select(*BASE, "unit")
    s = H.scores(arm_of, {"mean": H.mean_scores(sets, whom, facts, BY, BASE, TOPK)}, tests, BASE, CELL, ["l2", "pcc"])
    e = T.paired_effects(s, "genuine", ["all", "random_matched", "random_rest"], [*CELL, "unit"], {"l2": False, "pcc": True})
    return e.groupBy("rho_min", "cos_min", "dataset", "comparator", "metric", "unit").agg(F.round(F.avg("effect"), 9).alias("effect"))


@query(f"""WITH {SWEEP}, pl AS (SELECT *, row_number() OVER (PARTITION BY {_GROUP} ORDER BY unit) - 1 AS pos, count(*) OVER (PARTITION BY {_GROUP}) AS size FROM pe),
dr AS (SELECT iter, {_GROUP}, ('0x' || substr(md5('sweep:' || iter || ':' || rho_min || ':' || cos_min || ':' || dataset || ':' || comparator || ':' || metric || ':' || pos), 1, 8))::BIGINT % size AS pick FROM pl, (SELECT unnest(range(1, {BOOT + 1})) AS iter)),
ms AS (SELECT iter, {_GROUP}, avg(effect) AS m FROM dr JOIN pl USING ({_GROUP}) WHERE pick = pos GROUP BY ALL),
ci AS (SELECT {_GROUP}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM ms GROUP BY ALL),
g AS (SELECT {_GROUP}, count(effect) AS n, avg(effect) AS mean, quantile_cont(effect, 0.5) AS median FROM pe GROUP BY ALL),
f AS (SELECT g.*, CASE WHEN n > 1 THEN lo END AS ci_low, CASE WHEN n > 1 THEN hi END AS ci_high FROM g JOIN ci USING ({_GROUP}))
SELECT {_GROUP}, n, {r6('mean', 'median', 'ci_low', 'ci_high')}, CASE WHEN ci_low IS NULL THEN 'insufficient_n' WHEN ci_low > 0 THEN 'better' WHEN ci_high < 0 THEN 'worse' ELSE 'inconclusive' END AS conclusion FROM f""")
def threshold_sweep(spark, d):
    """The chain from labels to intervals under each of 25 pairs of thresholds."""
    return rounded(BS.effect_interval(_sweep_effects(spark, d), _GROUP.split(", "), "effect", ["unit"], BOOT, "sweep"))


@query(f"""WITH {LATTICE}, {_jobs_sql('hl', _CELL)},
n AS (SELECT rho_min, cos_min, dataset, count(*) AS n_jobs, count(*) FILTER (reason IS NULL) AS n_run, count(*) FILTER (reason IS NULL AND rest_reason IS NULL) AS n_with_rest FROM jr GROUP BY ALL),
u AS (SELECT rho_min, cos_min, dataset, count(DISTINCT unit) AS n_units FROM hl JOIN jr USING ({_CELL}) WHERE reason IS NULL AND split = 'test' AND label = 'Specific' GROUP BY ALL)
SELECT rho_min, cos_min, dataset, n_jobs, n_run, n_with_rest, coalesce(n_units, 0) AS n_units FROM n LEFT JOIN u USING (rho_min, cos_min, dataset)""")
def threshold_availability(spark, d):
    """Jobs that run, and different genuine test units in them, under each pair of thresholds."""
    cells = H.lattice(_members(spark, d), RHOS, COSINES)
    job = H.jobs(cells, CELL, least_test=LEAST_TEST)
    of = ["rho_min", "cos_min", "dataset"]
    n = job.groupBy(*of).agg(F.count("*").alias("n_jobs"), F.count_if(F.col("reason").isNull()).alias("n_run"), F.count_if(F.col("reason").isNull() & F.col("rest_reason").isNull()).alias("n_with_rest"))
    tested = cells.where("split = 'test' and label = 'Specific'").join(job.where("reason is null").select(*CELL), CELL, "left_semi")
    u = tested.groupBy(*of).agg(F.count_distinct("unit").alias("n_units"))
    return n.join(u, of, "left").withColumn("n_units", F.coalesce("n_units", F.lit(0)))


# --- pools, weights and quantities, on units held out --------------------------------------------

POOLS = ["all", "reliable", "unreliable", "specific"]
SCALES = [0.1, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 1.0]
FRACS, QUANTITY_DRAWS, SCALE_DRAWS, RANDOM_DRAWS, LEAST_POOL = [0.1, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8], 10, 6, 10, 8
STRATEGIES = ["all", "specific", "reliable", "weight_rho", "weight_specificity", "weight_both", "reliable_then_specificity"]


def _pools(names: list[str]) -> dict:
    return {p: C.pool(p, F.col("rho"), F.col("label")) for p in names}


def _train(members: DataFrame) -> DataFrame:
    return members.where("split = 'train'")


def _tests(members: DataFrame) -> DataFrame:
    return members.where("split = 'test'")


def _both(spark: SparkSession, d: str, members: DataFrame, facts: DataFrame, arms: DataFrame, keys: list[str]) -> DataFrame:
    """(model, keys, unit, l2, pcc) of the mean and the bilinear model; ``arms``: keys, unit, weight."""
    of = arms.withColumn("set", F.md5(F.concat_ws(":", *keys)))
    s = M.gram_scores(_grams(spark, d, members, facts), of.select(*BASE, "set", "unit", "weight"), _tests(members), BY, BASE)
    return of.select(*keys, "set").distinct().join(s, [*BASE, "set"]).select("model", *keys, "unit", "l2", "pcc")


_POOL_SQL = """SELECT {0}, 'all' AS pool, unit FROM {1} UNION ALL SELECT {0}, 'reliable', unit FROM {1} WHERE rho >= 0.5 UNION ALL SELECT {0}, '{2}', unit FROM {1} WHERE {3} UNION ALL SELECT {0}, 'specific', unit FROM {1} WHERE label = 'Specific'"""
TESTED = f"{HOLD}, tn AS (SELECT * FROM hs WHERE split = 'train'), te AS (SELECT * FROM hs WHERE split = 'test')"
_SCORED = """pm AS (SELECT {0}, g, sum(w * delta) / sum(w) AS pred FROM a JOIN tf USING (dataset, unit) WHERE w > 0 GROUP BY ALL),
s AS (SELECT {0}, unit, sqrt(sum((pred - delta) ** 2)) AS l2, covar_pop(pred, delta) / nullif(stddev_pop(pred) * stddev_pop(delta), 0) AS pcc
  FROM pm JOIN (SELECT dataset, split_seed, unit FROM te) t USING (dataset, split_seed) JOIN tf USING (dataset, unit, g) GROUP BY ALL)"""


@query(f"""WITH {HOLD}, {_arms_sql('hs', _BASE)}, te AS (SELECT * FROM hs WHERE split = 'test'), a AS (SELECT *, 1.0::DOUBLE AS w FROM ar), {_SCORED.format(_SET)}
SELECT dataset, split_seed, arm, unit::BIGINT AS unit, count(*) AS n_subsets, {r6('avg(l2) AS l2', 'avg(pcc) AS pcc')} FROM s GROUP BY ALL""")
def arm_scores(spark, d):
    """The mean model, random subsets averaged: one row for each arm and test unit."""
    members, facts = _members(spark, d), _facts(spark, d)
    arms = H.training_arms(members, H.jobs(members, BASE, least_test=LEAST_TEST), BASE, DRAWS).withColumn("weight", F.lit(1.0))
    s = P.weighted_scores(arms, _tests(members), facts, BY, BASE, [*BASE, "arm", "subset"])
    return rounded(s.groupBy(*BASE, "arm", "unit").agg(F.count("*").alias("n_subsets"), F.avg("l2").alias("l2"), F.avg("pcc").alias("pcc")))


@query()
def model_arm_scores(spark, d):
    """Both models, random subsets averaged: one row for each arm and test unit."""
    members, facts = _members(spark, d), _facts(spark, d)
    arms = settle(H.training_arms(members, H.jobs(members, BASE, least_test=LEAST_TEST), BASE, DRAWS).withColumn("weight", F.lit(1.0)))
    s = _both(spark, d, members, facts, arms, [*BASE, "arm", "subset"])
    return rounded(s.groupBy("model", *BASE, "arm", "unit").agg(F.count("*").alias("n_subsets"), F.avg("l2").alias("l2"), F.avg("pcc").alias("pcc")))


@query(f"""WITH {TESTED}, pl AS (SELECT dataset, split_seed, unit, count(*) OVER (PARTITION BY dataset, split_seed) AS n FROM tn WHERE rho >= 0.5),
q AS (SELECT dataset, split_seed, frac, draw, unit, greatest(2, round_even(frac * n, 0)) AS size, row_number() OVER (PARTITION BY dataset, split_seed, frac, draw ORDER BY md5('qty:' || dataset || ':' || split_seed || ':' || frac || ':' || draw || ':' || unit), unit) AS rk
  FROM pl, (VALUES ({'::DOUBLE), ('.join(map(str, FRACS))}::DOUBLE)) f(frac), (SELECT unnest(range(1, {QUANTITY_DRAWS + 1})) AS draw)),
a AS (SELECT dataset, split_seed, frac, draw, unit, 1.0::DOUBLE AS w FROM q WHERE rk <= size UNION ALL SELECT dataset, split_seed, 1.0::DOUBLE, 1, unit, 1.0 FROM pl),
{_SCORED.format('dataset, split_seed, frac, draw')}, m AS (SELECT dataset, frac, avg(l2) AS mean FROM s GROUP BY ALL)
SELECT dataset, frac, {r6('mean', 'mean / max(mean) FILTER (frac = 1) OVER (PARTITION BY dataset) AS relative')} FROM m""")
def quantity_sweep(spark, d):
    members, facts = _members(spark, d), _facts(spark, d)
    pool = _train(members).where("rho >= 0.5").select(*BASE, "unit")
    whole = pool.select(*BASE, F.lit(1.0).alias("frac"), F.lit(1).alias("draw"), "unit")
    arms = P.quantity_arms(pool, FRACS, QUANTITY_DRAWS, by=BASE).unionByName(whole).withColumn("weight", F.lit(1.0))
    s = P.weighted_scores(arms, _tests(members), facts, BY, BASE, [*BASE, "frac", "draw"])
    return rounded(P.relative_to(s, ["frac"], "l2", F.col("frac") == 1.0, BY))


def _scaling(members: DataFrame) -> DataFrame:
    of = P.pool_members(_train(members), _pools(POOLS), BASE)
    return P.scaling_arms(of, SCALES, SCALE_DRAWS, LEAST_POOL, by=BASE).withColumn("weight", F.lit(1.0))


def _curves(s: DataFrame, by: list[str]) -> DataFrame:
    each = s.groupBy(*by, "split_seed", "draw").agg(F.avg("l2").alias("l2"), F.avg("pcc").alias("pcc"))
    return each.groupBy(*by).agg(F.count("*").alias("n_draws"), F.avg("l2").alias("mean_l2"), S.sem("l2").alias("sem_l2"), F.avg("pcc").alias("mean_pcc"))


@query(f"""WITH {TESTED}, pm0 AS ({_POOL_SQL.format(_BASE, 'tn', 'unreliable', 'rho < 0.5')}),
pn AS (SELECT {_BASE}, pool, count(*) AS n FROM pm0 GROUP BY ALL HAVING count(*) >= {LEAST_POOL}),
q AS (SELECT {_BASE}, pool, frac, draw, unit, greatest(1, round_even(frac * n, 0)) AS size, row_number() OVER (PARTITION BY {_BASE}, pool, frac, draw ORDER BY md5('pool:' || dataset || ':' || split_seed || ':' || pool || ':' || frac || ':' || draw || ':' || unit), unit) AS rk
  FROM pm0 JOIN pn USING ({_BASE}, pool), (VALUES ({'::DOUBLE), ('.join(map(str, SCALES))}::DOUBLE)) f(frac), (SELECT unnest(range(1, {SCALE_DRAWS + 1})) AS draw) WHERE frac < 1 OR draw = 1),
a AS (SELECT *, 1.0::DOUBLE AS w FROM q WHERE rk <= size), {_SCORED.format(f'{_BASE}, pool, frac, draw')},
m AS (SELECT {_BASE}, pool, frac, draw, avg(l2) AS l2, avg(pcc) AS pcc FROM s GROUP BY ALL)
SELECT dataset, pool, frac, count(*) AS n_draws, {r6('avg(l2) AS mean_l2', 'stddev_samp(l2) / sqrt(count(l2)) AS sem_l2', 'avg(pcc) AS mean_pcc')} FROM m GROUP BY ALL""")
def pool_scaling(spark, d):
    """Scaling curves on units held out: 4 pools of 8 units or more, 8 fractions, 6 draws a split."""
    members, facts = _members(spark, d), _facts(spark, d)
    keys = [*BASE, "pool", "frac", "draw"]
    return rounded(_curves(P.weighted_scores(_scaling(members), _tests(members), facts, BY, BASE, keys), ["dataset", "pool", "frac"]))


@query()
def model_pool_scaling(spark, d):
    """The same curves under both models."""
    members, facts = _members(spark, d), _facts(spark, d)
    s = _both(spark, d, members, facts, settle(_scaling(members)), [*BASE, "pool", "frac", "draw"])
    return rounded(_curves(s, ["model", "dataset", "pool", "frac"]))


def _strategies(members: DataFrame) -> DataFrame:
    """Seven strategies and ``random_matched``: random subsets as large as the specific pool."""
    train = _train(members).withColumn("phi", F.col("cos_sim") * F.col("cos_sim"))
    reliable = F.col("strategy").isin("reliable", "reliable_then_specificity")
    keep = F.when(F.col("strategy") == "specific", F.col("label") == "Specific").when(reliable, F.col("rho") >= 0.5).otherwise(True)
    own = P.strategy_arms(train, STRATEGIES, BASE).join(train.select(*BASE, "unit", "rho", "label"), [*BASE, "unit"]).where(keep).select(*BASE, "strategy", F.lit(0).alias("subset"), "unit", "weight")
    size = F.count_if(F.col("label") == "Specific").over(Window.partitionBy(*BASE))
    rows = W.repeats(train.withColumn("size", size), RANDOM_DRAWS, "subset")
    random = W.subset(rows, [*BASE, "subset"], [F.lit("random_matched"), *BASE, "subset", "unit"], "unit", F.col("size"))
    return own.unionByName(random.select(*BASE, F.lit("random_matched").alias("strategy"), "subset", "unit", F.lit(1.0).alias("weight")))


@query(f"""WITH {TESTED}, u AS (SELECT *, least(greatest(coalesce(rho, 0), 0), 1) AS r, coalesce(1 - cos_sim * cos_sim, 0) AS sp FROM tn),
w0 AS (SELECT {_BASE}, unit, unnest(['all', 'specific', 'reliable', 'weight_rho', 'weight_specificity', 'weight_both', 'reliable_then_specificity']) AS strategy, 0 AS subset,
  unnest([1.0::DOUBLE, (label = 'Specific')::INT, (rho >= 0.5)::INT, r, sp, r * sp, CASE WHEN rho >= 0.5 THEN sp ELSE 0 END]) AS w FROM u),
k AS (SELECT {_BASE}, unit, subset, count(*) FILTER (label = 'Specific') OVER (PARTITION BY {_BASE}, subset) AS size, row_number() OVER (PARTITION BY {_BASE}, subset ORDER BY md5('random_matched:' || dataset || ':' || split_seed || ':' || subset || ':' || unit), unit) AS rk
  FROM tn, (SELECT unnest(range(1, {RANDOM_DRAWS + 1})) AS subset)),
a AS (SELECT {_BASE}, strategy, subset, unit, w FROM w0 UNION ALL SELECT {_BASE}, 'random_matched', subset, unit, 1.0 FROM k WHERE rk <= size), {_SCORED.format(f'{_BASE}, strategy, subset')}
SELECT {_BASE}, strategy, subset::BIGINT AS subset, unit::BIGINT AS unit, {r6('l2', 'pcc')} FROM s""")
def weight_strategies(spark, d):
    """Eight filter-or-weight strategies under the mean model, on units held out."""
    members, facts = _members(spark, d), _facts(spark, d)
    return rounded(P.weighted_scores(_strategies(members), _tests(members), facts, BY, BASE, [*BASE, "strategy", "subset"]))


@query()
def model_strategies(spark, d):
    """The eight strategies under both models: filters leave units out, weights keep
    them in the bilinear model's coordinates."""
    members, facts = _members(spark, d), _facts(spark, d)
    return rounded(_both(spark, d, members, facts, settle(_strategies(members)), [*BASE, "strategy", "subset"]))


GRID_POOLS = ["all", "reliable", "specific", "shared"]


def _grid(s: DataFrame, tests: DataFrame, by: list[str]) -> DataFrame:
    members = P.pool_members(tests, _pools(GRID_POOLS), BASE).withColumnRenamed("pool", "test")
    return s.withColumnRenamed("pool", "train").join(members, [*BASE, "unit"]).groupBy(*by, "train", "test").agg(F.count("*").alias("n"), F.avg("l2").alias("mean_l2"), F.avg("pcc").alias("mean_pcc"), S.sem("l2").alias("sem_l2"))


@query(f"""WITH {TESTED}, a AS (SELECT *, 1.0::DOUBLE AS w FROM ({_POOL_SQL.format(_BASE, 'tn', 'shared', "label = 'Shared'")})), {_SCORED.format(f'{_BASE}, pool')},
tp AS ({_POOL_SQL.format(_BASE, 'te', 'shared', "label = 'Shared'")})
SELECT dataset, s.pool AS train, tp.pool AS test, count(*) AS n, {r6('avg(l2) AS mean_l2', 'avg(pcc) AS mean_pcc', 'stddev_samp(l2) / sqrt(count(l2)) AS sem_l2')} FROM s JOIN tp USING ({_BASE}, unit) GROUP BY ALL""")
def retraining_grid(spark, d):
    """Training pool by test pool, mean model, on units held out."""
    members, facts = _members(spark, d), _facts(spark, d)
    arms = P.pool_members(_train(members), _pools(GRID_POOLS), BASE).withColumn("weight", F.lit(1.0))
    return rounded(_grid(P.weighted_scores(arms, _tests(members), facts, BY, BASE, [*BASE, "pool"]), _tests(members), BY))


@query()
def model_grid(spark, d):
    """Model by training pool by test pool: mean and s.e.m. of the scores of units held out."""
    members, facts = _members(spark, d), _facts(spark, d)
    arms = settle(P.pool_members(_train(members), _pools(GRID_POOLS), BASE).withColumn("weight", F.lit(1.0)))
    return rounded(_grid(_both(spark, d, members, facts, arms, [*BASE, "pool"]), _tests(members), ["model", *BY]))
