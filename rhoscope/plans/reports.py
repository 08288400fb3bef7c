"""Experiment and report queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import benchmark as B
from ..operators import reliability as R
from ..operators import retrain as T
from ..operators import saturation as N
from ..operators import triage as C
from ..sources import fixtures as X
from .catalog import AXIS, BASELINE, EXCESS, PAIRS, PILOTS, POINTS, SCORES, _effects, _points, _reliability, _scored, _triage, _units, query, r6, rounded

# --- experiments ---------------------------------------------------------------------------------

SUBSETS = 50
ARMS = f"""{AXIS}, kk AS (SELECT count(*) AS k FROM tri WHERE label = 'Specific'),
ra AS (SELECT 'random_matched' AS arm, subset, unit, row_number() OVER (PARTITION BY subset ORDER BY md5('random_matched:' || subset || ':' || unit), unit) AS rk FROM tri, (SELECT unnest(range(1, {SUBSETS + 1})) AS subset)
  UNION ALL SELECT 'random_rest', subset, unit, row_number() OVER (PARTITION BY subset ORDER BY md5('random_rest:' || subset || ':' || unit), unit) FROM tri, (SELECT unnest(range(1, {SUBSETS + 1})) AS subset) WHERE label <> 'Specific'),
arms0 AS (SELECT 'all' AS arm, 0 AS subset, unit FROM tri UNION ALL SELECT 'genuine', 0, unit FROM tri WHERE label = 'Specific' UNION ALL SELECT arm, subset, unit FROM ra, kk WHERE rk <= k),
arms AS (SELECT * FROM arms0 WHERE (arm, subset) IN (SELECT (arm, subset) FROM arms0 GROUP BY arm, subset HAVING count(*) >= 2))"""


@query(f"WITH {ARMS} SELECT arm, subset::BIGINT AS subset, unit::BIGINT AS unit FROM arms")
def retraining_arms(spark, d):
    return rounded(T.arms(_triage(spark, d).select("unit", "label"), SUBSETS, 2))


_SCORE = "sqrt(sum((p.pred - d.delta) ** 2)) AS l2, covar_pop(p.pred, d.delta) / nullif(stddev_pop(p.pred) * stddev_pop(d.delta), 0) AS pcc"


RHOS, COSINES = [0.3, 0.4, 0.5, 0.6, 0.7], [0.4, 0.5, 0.7071, 0.8, 0.9]


@query(f"""WITH {AXIS}, gr AS (SELECT r, c FROM (VALUES ({'::DOUBLE), ('.join(map(str, RHOS))}::DOUBLE)) a(r), (VALUES ({'::DOUBLE), ('.join(map(str, COSINES))}::DOUBLE)) b(c)),
l AS (SELECT r, c, unit, CASE WHEN NOT coalesce(rho >= r, false) THEN 'Unreliable' WHEN coalesce(cos_sim >= c, false) THEN 'Shared' ELSE 'Specific' END AS k FROM tri, gr)
SELECT r AS rho_min, c AS cos_min, count(*) FILTER (k = 'Specific') AS n_specific, count(*) FILTER (k = 'Shared') AS n_shared, count(*) FILTER (k = 'Specific') >= 2 AS available FROM l GROUP BY ALL""")
def threshold_sensitivity(spark, d):
    grid = F.explode(F.array(*[F.struct(F.lit(r).alias("rho_min"), F.lit(c).alias("cos_min")) for r in RHOS for c in COSINES])).alias("t")
    l = _triage(spark, d).select("unit", "rho", "cos_sim", grid).select("*", "t.*")
    l = l.withColumn("k", C.label(F.col("rho"), F.col("cos_sim"), F.col("rho_min"), F.col("cos_min")))
    n = lambda c: F.count_if(F.col("k") == c)
    return l.groupBy("rho_min", "cos_min").agg(n("Specific").alias("n_specific"), n("Shared").alias("n_shared"), (n("Specific") >= 2).alias("available"))


@query(f"""WITH {PAIRS} SELECT comparator, metric, dataset, count(*) AS n, {r6('avg((effect > 0)::INT) AS share_better', 'avg(effect) AS mean_effect')}, count(DISTINCT unit) AS n_units FROM pe GROUP BY ALL""")
def effect_stability(spark, d):
    return rounded(_effects(spark, d).groupBy("comparator", "metric", "dataset").agg(F.count("*").alias("n"), F.avg((F.col("effect") > 0).cast("int")).alias("share_better"), F.avg("effect").alias("mean_effect"), F.countDistinct("unit").alias("n_units")))


# --- reports -------------------------------------------------------------------------------------


@query(f"WITH {SCORES} SELECT dataset, least(floor(rho * 20), 19)::BIGINT AS bin, count(*) AS n, count(*) FILTER (cls = 'Specific') AS n_specific FROM uc GROUP BY ALL")
def report_rho_histogram(spark, d):
    return _units(spark, d).groupBy("dataset", S.hist_bin("rho", 0.0, 1.0, 20).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("cls") == "Specific").alias("n_specific"))


@query(f"WITH {SCORES}, m AS (SELECT method, cls, dataset, avg(score) AS m FROM sq GROUP BY ALL) SELECT method, {', '.join(r6(f'avg(m) FILTER (cls = {chr(39)}{c}{chr(39)}) AS mean_{c.lower()}') for c in C.CLASSES)} FROM m GROUP BY method")
def report_class_means(spark, d):
    m = _scored(spark, d).groupBy("method", "cls", "dataset").agg(F.avg("score").alias("m"))
    return rounded(m.groupBy("method").agg(*[F.avg(F.when(F.col("cls") == c, F.col("m"))).alias(f"mean_{c.lower()}") for c in C.CLASSES]))


@query(f"""WITH {POINTS}, m AS (SELECT quantile_cont(tau_sq, 0.5) AS tau FROM ft)
SELECT n_total::BIGINT AS n_total, count(*) AS n_units, {r6('quantile_cont(rho, 0.25) AS q25', 'quantile_cont(rho, 0.5) AS median', 'quantile_cont(rho, 0.75) AS q75', 'n_total * max(tau) / (n_total * max(tau) + 1) AS model')} FROM pt, m GROUP BY n_total""")
def report_rho_vs_n(spark, d):
    p = N.usable(_points(spark, d), ["unit"])
    tau = N.fit_on_grid(p, ["unit"]).agg(F.percentile("tau_sq", F.lit(0.5)).alias("tau"))
    q = p.groupBy("n_total").agg(F.count("*").alias("n_units"), F.percentile("rho", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    out = q.crossJoin(F.broadcast(tau))  # one row
    return rounded(out.select("n_total", "n_units", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), S.rho_at("tau", "n_total").alias("model")))


@query(f"WITH {POINTS} SELECT least(floor((greatest(fit_r2, -1) + 1) * 10), 19)::BIGINT AS bin, count(*) AS n FROM ft GROUP BY ALL")
def report_fit_histogram(spark, d):
    f = N.fit_on_grid(_points(spark, d), ["unit"]).withColumn("r2", F.greatest("fit_r2", F.lit(-1.0)))
    return f.groupBy(S.hist_bin("r2", -1.0, 1.0, 20).alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {POINTS}, gr AS (SELECT unit, p AS pilot_n, n_total, rho FROM pt, (VALUES ({'), ('.join(map(str, PILOTS))})) t(p) WHERE n_total <= p),
ok AS (SELECT gr.unit, pilot_n FROM gr JOIN (SELECT unit, count(*) AS n_all FROM pt GROUP BY unit) a ON gr.unit = a.unit GROUP BY gr.unit, pilot_n HAVING count(DISTINCT n_total) >= 2 AND count(*) < max(n_all)),
s2 AS (SELECT gr.unit, pilot_n, k, max(tau_sq) AS tau_sq, sum((rho - n_total * tau_sq / (n_total * tau_sq + 1)) ** 2) AS sse FROM gr JOIN ok USING (unit, pilot_n), gk GROUP BY gr.unit, pilot_n, k),
b2 AS (SELECT unit, pilot_n, tau_sq FROM (SELECT *, row_number() OVER (PARTITION BY unit, pilot_n ORDER BY round(sse, 12), k) AS rn FROM s2) WHERE rn = 1),
j AS (SELECT pilot_n, log10(ft.tau_sq) AS a, log10(b2.tau_sq) AS b, (b2.tau_sq / ft.tau_sq BETWEEN 0.5 AND 2)::INT AS w FROM b2 JOIN ft USING (unit))
SELECT pilot_n::BIGINT AS pilot_n, {r6('covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS log_r', 'avg(w) AS within_2x')}, count(*) AS n FROM j GROUP BY pilot_n""")
def report_pilot_accuracy(spark, d):
    p = _points(spark, d)
    full = N.fit_on_grid(p, ["unit"]).select("unit", F.col("tau_sq").alias("f"))
    part = N.fit_on_grid(N.pilot_points(p, ["unit"], PILOTS), ["unit", "pilot_n"]).select("unit", "pilot_n", F.col("tau_sq").alias("t"))
    return rounded(N.accuracy(part.join(full, "unit"), "f", "t", ["pilot_n"]))


@query(f"""WITH {POINTS}, c AS (SELECT n AS x, avg(median_r) AS y FROM rl WHERE gene_mode = 'all_genes' AND mode = 'fixed' GROUP BY n),
l AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM c)
SELECT x::BIGINT AS x, round(y, 6) + 0.0 AS y FROM (SELECT *, round((y - y0) / nullif(y1 - y0, 0) - (x - x0) / nullif(x1 - x0, 0)::DOUBLE, 9) AS gap FROM c, l) ORDER BY gap DESC NULLS LAST, x LIMIT 1""")
def report_elbow(spark, d):
    c = _reliability(spark, d).where("gene_mode = 'all_genes' and mode = 'fixed'").groupBy(F.col("n").alias("x")).agg(F.avg("median_r").alias("y"))
    return rounded(N.elbow(c, "x", "y"))


@query(f"""WITH {AXIS} SELECT CASE WHEN n_cells BETWEEN 0 AND 48 THEN '0-48' WHEN n_cells <= 52 THEN '48-52' WHEN n_cells <= 200 THEN '52-200' ELSE '>200' END AS bin,
  count(*) AS n, {', '.join(r6(f'avg((label = {chr(39)}{c}{chr(39)})::INT) AS frac_{c.lower()}') for c in C.CLASSES)} FROM tri WHERE n_cells IS NOT NULL GROUP BY ALL""")
def report_class_by_cells(spark, d):
    t = _triage(spark, d).where("n_cells is not null").withColumn("bin", S.labelled_bin("n_cells", [0, 48, 52, 200]))
    return rounded(t.groupBy("bin").agg(F.count("*").alias("n"), *[F.avg((F.col("label") == c).cast("int")).alias(f"frac_{c.lower()}") for c in C.CLASSES]))


@query(f"""WITH {EXCESS}, s2 AS (SELECT dataset, op, avg(score2) AS base2 FROM sc WHERE method = '{BASELINE}' GROUP BY ALL),
a AS (SELECT ex.*, score2 - base2 AS excess2 FROM ex JOIN s2 USING (dataset, op))
SELECT method, {r6('avg(a1) AS metric1', 'avg(a2) AS metric2')} FROM (SELECT method, dataset, avg(excess) AS a1, avg(excess2) AS a2 FROM a GROUP BY ALL) GROUP BY method""")
def report_metric_heatmap(spark, d):
    s = _scored(spark, d)
    one = B.excess_by_method(s, BASELINE).select("method", F.col("excess").alias("metric1"))
    rows = B.fold_excess(s, BASELINE, score="score2")
    two = B.dataset_weighted(rows, "excess", ["method"]).select("method", F.col("excess").alias("metric2"))
    return rounded(one.join(two, "method"))


@query(f"""WITH {SCORES}, m AS (SELECT dataset, method, avg(score) AS a, avg(score2) AS b FROM sc GROUP BY ALL),
r AS (SELECT dataset, method, row_number() OVER (PARTITION BY dataset ORDER BY a DESC, method) AS p1, row_number() OVER (PARTITION BY dataset ORDER BY b DESC, method) AS p2 FROM m)
SELECT dataset, method, p1, p2, abs(p1 - p2) AS moved FROM r""")
def report_rank_comparison(spark, d):
    m = X.scores(spark, d).groupBy("dataset", "method").agg(F.avg("score").alias("a"), F.avg("score2").alias("b"))
    rn = lambda c: F.row_number().over(S.over(["dataset"], F.desc(c), F.col("method"))).cast("long")
    return m.select("dataset", "method", rn("a").alias("p1"), rn("b").alias("p2")).withColumn("moved", F.abs(F.col("p1") - F.col("p2")))


@query(f"""WITH {SCORES}, k AS (SELECT method, dataset, unit, max(cls) AS cls, avg(score) AS score, max(rho) AS rho FROM sq GROUP BY ALL) SELECT method, dataset, unit, cls, {r6('score', 'sqrt(greatest(rho, 0)) AS ceiling')} FROM k""")
def fold_collapse(spark, d):
    k = _scored(spark, d).groupBy("method", "dataset", "unit").agg(F.max("cls").alias("cls"), F.avg("score").alias("score"), F.max("rho").alias("rho"))
    return rounded(k.select("method", "dataset", "unit", "cls", "score", S.ceiling("rho").alias("ceiling")))


@query(f"WITH {SCORES} SELECT method, {r6('avg((abs(score) > 0.5)::INT) AS share_large', 'median(score) AS median_score', 'stddev_samp(score) / sqrt(count(score)) AS sem')}, count(DISTINCT unit) AS n_units, count(DISTINCT dataset) AS n_datasets FROM sc GROUP BY method")
def report_method_spread(spark, d):
    s = X.scores(spark, d)
    return rounded(s.groupBy("method").agg(F.avg((F.abs("score") > 0.5).cast("int")).alias("share_large"), F.percentile("score", F.lit(0.5)).alias("median_score"), S.sem("score").alias("sem"), F.countDistinct("unit").alias("n_units"), F.countDistinct("dataset").alias("n_datasets")))


@query("""WITH l AS (SELECT quality, toxic FROM labels), c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM l GROUP BY ALL) SELECT a::BIGINT AS a, b::BIGINT AS b, n FROM c""")
def label_contingency(spark, d):
    from ..sources.readers import table

    return rounded(table(spark, d, "labels").groupBy(F.col("quality").alias("a"), F.col("toxic").alias("b")).agg(F.count("*").alias("n")))


