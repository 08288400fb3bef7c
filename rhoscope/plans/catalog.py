"""Named queries over the driver's tables, and the SQL another engine runs for each."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import stats as S
from ..operators import benchmark as B
from ..operators import bootstrap as BS
from ..operators import energy as E
from ..operators import enrichment as G
from ..operators import fastnull as GF
from ..operators import inference as I
from ..operators import panels as P
from ..operators import reliability as R
from ..operators import retrain as T
from ..operators import sampling as W
from ..operators import saturation as N
from ..operators import triage as C
from ..sources import fixtures as X
from ..sources import readers as IO

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

REPS, TOPK, BOOT, PERMS, FDR = 100, 16, 1000, 1000, 0.05
#: Sizes of a half and of a pilot as in the reference; a unit takes those it has cells for.
GRID, PILOTS = [8, 16, 32, 64, 128, 256, 512], [*range(10, 99, 2)]
BASELINE = "m1"
#: The tables have 64 genes a ranking; the operator's own least is 200.
LEAST_GENES = 32


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "smallint", "decimal(20,0)") else F.col(c) for c, t in df.dtypes])


def r6(*names: str) -> str:
    return ", ".join(f"round({n.split(' AS ')[0]}, 6) + 0.0 AS {n.split(' AS ')[-1]}" for n in names)


# --- views ---------------------------------------------------------------------------------------

CELLS = """units AS (SELECT vec_id AS cell, label AS unit FROM embeddings),
cells AS (
  SELECT cell, unit, g, x0 + CASE WHEN unit <> 0 THEN
    0.01::DOUBLE * (unit % 4) * (((5 * g) % 7) - 3) + 0.01::DOUBLE * (unit % 3) * (((7 * unit + 13 * g) % 11) - 5) ELSE 0 END AS x
  FROM (SELECT vec_id AS cell, label AS unit, unnest(range(0, 64)) AS g, unnest(embedding)::DOUBLE AS x0 FROM embeddings)),
delta AS (
  SELECT a.unit, a.g, a.m - b.m AS delta, a.n FROM (SELECT unit, g, avg(x) AS m, count(*) AS n FROM cells GROUP BY unit, g) a
  JOIN (SELECT g, avg(x) AS m FROM cells WHERE unit = 0 GROUP BY g) b ON a.g = b.g WHERE a.unit <> 0)"""

_CLIP = "least(greatest(coalesce(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 0), -1), 1)"
_SB = "CASE WHEN abs(1 + {0}) > 1e-10 THEN greatest(2 * {0} / (1 + {0}), 0) ELSE 0 END"
REL = f"""{CELLS},
sizes AS (SELECT unit, count(*) AS cells FROM units GROUP BY unit),
most AS (SELECT unit, least(cells // 2, (SELECT cells FROM sizes WHERE unit = 0) // 2)::INT AS most FROM sizes WHERE unit <> 0),
conf AS (
  SELECT unit, 'max' AS mode, most AS n FROM most WHERE most >= 4
  UNION ALL SELECT unit, 'fixed', v FROM most, (VALUES ({'), ('.join(map(str, GRID))})) t(v) WHERE most >= 4 AND v <= most),
reps AS (SELECT unnest(range(1, {REPS + 1}))::INT AS rep),
tr AS (
  SELECT cell, u.unit, mode, n, rep, row_number() OVER (PARTITION BY u.unit, mode, n, rep ORDER BY md5(rep || ':' || mode || ':' || n || ':t:' || cell), cell) AS rk
  FROM units u JOIN conf c ON u.unit = c.unit, reps),
ct AS (
  SELECT cell, mode, n, rep, row_number() OVER (PARTITION BY mode, n, rep ORDER BY md5(rep || ':' || mode || ':' || n || ':c:' || cell), cell) AS rk
  FROM (SELECT cell FROM units WHERE unit = 0), (SELECT DISTINCT mode, n FROM conf), reps),
mt AS (SELECT t.unit, mode, n, rep, rk <= n AS h, g, avg(x) AS m FROM tr t JOIN cells USING (cell) WHERE rk <= 2 * n GROUP BY ALL),
mc AS (SELECT mode, n, rep, rk <= n AS h, g, avg(x) AS m FROM ct JOIN cells USING (cell) WHERE rk <= 2 * n GROUP BY ALL),
ab AS (
  SELECT mt.unit, mode, n, rep, g, max(mt.m - mc.m) FILTER (h) AS a, max(mt.m - mc.m) FILTER (NOT h) AS b
  FROM mt JOIN mc USING (mode, n, rep, h, g) GROUP BY ALL),
topk AS (SELECT g FROM (SELECT g, avg(x) AS m FROM cells WHERE unit = 0 GROUP BY g) ORDER BY m DESC, g LIMIT {TOPK}),
r AS (
  SELECT unit, mode, n, rep, 'all_genes' AS gene_mode, {_CLIP} AS r FROM ab GROUP BY ALL
  UNION ALL SELECT unit, mode, n, rep, 'top_expressed', {_CLIP} FROM ab WHERE g IN (SELECT g FROM topk) GROUP BY ALL),
rl0 AS (
  SELECT unit, mode, n, gene_mode, count(*) AS n_repeats, avg(r) AS mean_r, stddev_pop(r) AS std_r, min(r) AS min_r, max(r) AS max_r,
    quantile_cont(r, 0.25) AS q25_r, quantile_cont(r, 0.5) AS median_r, quantile_cont(r, 0.75) AS q75_r,
    CASE WHEN stddev_pop(r) > 1e-10 THEN (avg(r * r * r) - 3 * avg(r) * avg(r * r) + 2 * avg(r) * avg(r) * avg(r)) / (stddev_pop(r) * stddev_pop(r) * stddev_pop(r)) ELSE 0 END AS skewness_r,
    avg({_SB.format('r')}) AS sb_mean_per_repeat, quantile_cont({_SB.format('r')}, 0.5) AS sb_median_per_repeat
  FROM r GROUP BY ALL),
rl AS (SELECT *, {_SB.format('mean_r')} AS sb_from_mean, {_SB.format('median_r')} AS sb_from_median FROM rl0)"""

AXIS = f"""{REL},
rho AS (SELECT unit, sb_from_median AS rho FROM rl WHERE mode = 'max' AND gene_mode = 'all_genes'),
good AS (SELECT unit FROM rho WHERE rho >= 0.5),
axis AS (
  SELECT a.g, a.m - b.m AS avg_delta FROM (SELECT g, avg(x) AS m FROM cells WHERE unit IN (SELECT unit FROM good) GROUP BY g) a
  JOIN (SELECT g, avg(x) AS m FROM cells WHERE unit = 0 GROUP BY g) b ON a.g = b.g),
ax AS (
  SELECT unit, max(n) AS n_cells, unit IN (SELECT unit FROM good) AS reliable, sum(delta * delta) AS dd, sum(avg_delta * avg_delta) AS aa, sum(delta * avg_delta) AS da
  FROM delta JOIN axis USING (g) GROUP BY unit),
axm AS (
  SELECT unit, n_cells, reliable, CASE WHEN reliable THEN da / (sqrt(dd) * sqrt(aa)) END AS cos_sim, CASE WHEN reliable THEN sqrt(dd) END AS norm_delta_p,
    CASE WHEN reliable THEN sqrt(aa) END AS norm_delta_avg, CASE WHEN reliable THEN sqrt(greatest(dd - da * da / aa, 0)) END AS norm_delta_specific FROM ax),
tri AS (
  SELECT unit, n_cells, rho, cos_sim,
    CASE WHEN NOT coalesce(rho >= 0.5, false) THEN 'Unreliable' WHEN coalesce(cos_sim >= sqrt(0.5::DOUBLE), false) THEN 'Shared' ELSE 'Specific' END AS label
  FROM rho LEFT JOIN axm USING (unit))"""

SCORES = r"""sc AS (
  SELECT 'm' || l_linenumber AS method, r_name AS dataset, p_brand AS unit, l_suppkey % 5 AS fold, p_brand || '_' || (l_suppkey % 5) AS op,
    avg(1 - 10 * l_discount) AS score, avg(l_quantity / 50) AS score2
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
uq AS (
  SELECT dataset, unit, ((7 * b) % 11) / 10::DOUBLE AS rho, CASE WHEN ((7 * b) % 11) >= 5 THEN ((5 * b) % 9) / 8::DOUBLE END AS cos
  FROM (SELECT DISTINCT p_brand AS unit, regexp_extract(p_brand, '(\d+)$', 1)::BIGINT AS b FROM part), (SELECT r_name AS dataset FROM region)),
uc AS (SELECT *, CASE WHEN rho < 0.5 THEN 'Unreliable' WHEN coalesce(cos >= sqrt(0.5::DOUBLE), false) THEN 'Shared' ELSE 'Specific' END AS cls FROM uq),
sq AS (SELECT sc.*, rho, cos, cls, score / nullif(sqrt(rho), 0) AS ce FROM sc JOIN uc USING (dataset, unit))"""

EXCESS = f"""{SCORES},
ba AS (SELECT dataset, op, avg(score) AS base FROM sc WHERE method = '{BASELINE}' GROUP BY ALL),
ex AS (SELECT sq.*, score - base AS excess FROM sq JOIN ba USING (dataset, op) WHERE method <> '{BASELINE}'),
xa AS (SELECT method, avg(m) AS excess, count(*) AS n_datasets FROM (SELECT method, dataset, avg(excess) AS m FROM ex GROUP BY ALL) GROUP BY method),
xs AS (SELECT method, avg(m) AS excess FROM (SELECT method, dataset, avg(excess) AS m FROM ex WHERE cls = 'Specific' GROUP BY ALL) GROUP BY method)"""


def _rank_trunc(value: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    tie = f"PARTITION BY {by}, {value}" if by else f"PARTITION BY {value}"
    return f"CASE WHEN {value} IS NOT NULL THEN floor(rank() OVER ({part}ORDER BY {value} DESC NULLS LAST) + (count(*) OVER ({tie}) - 1) / 2.0)::BIGINT END"


def _by_context(sql: str, part: str, contexts: range, select: str) -> str:
    """The same SQL on the cells of each context, one after the other."""
    one = lambda k: f"SELECT {k}::BIGINT AS context, q.* FROM (WITH {sql.replace('FROM embeddings', f'FROM (SELECT * FROM embeddings WHERE {part} = {k})')} {select}) q"
    return " UNION ALL ".join(map(one, contexts))


def _context(df: DataFrame) -> DataFrame:
    return df.select("*", (F.col("cell") % 2).alias("context"))


def _reliability(spark: SparkSession, d: str) -> DataFrame:
    return R.reliability_long(R.split_half_r(X.cells_planted(spark, d), X.cell_units(spark, d), REPS, GRID, TOPK))


def _rho(spark: SparkSession, d: str) -> DataFrame:
    """Reliability of each unit at its largest split over all genes."""
    long = R.reliability_long(R.split_half_r(X.cells_planted(spark, d), X.cell_units(spark, d), REPS))
    return long.select("unit", F.col("sb_from_median").alias("rho"))


def _axis(spark: SparkSession, d: str, rho: DataFrame) -> DataFrame:
    return R.axis_metrics(X.cells_planted(spark, d), rho.where("rho >= 0.5"))


def _triage(spark: SparkSession, d: str) -> DataFrame:
    rho = _rho(spark, d)
    t = rho.join(_axis(spark, d, rho), "unit", "left")
    return t.select("unit", "n_cells", "rho", "cos_sim", C.label(F.col("rho"), F.col("cos_sim")).alias("label"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    q = X.unit_quality(spark, d)
    return q.withColumn("cls", C.label(F.col("rho"), F.col("cos")))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    s = X.scores(spark, d).join(_units(spark, d), ["dataset", "unit"])
    return s.withColumn("ce", S.ratio(F.col("score"), F.sqrt("rho")))


# --- reliability and triage ----------------------------------------------------------------------


@query(f"WITH {CELLS} SELECT unit::BIGINT AS unit, g, {r6('avg(x) AS m')}, count(*) AS n FROM cells GROUP BY unit, g")
def pseudobulk_centroids(spark, d):
    return rounded(R.centroids(X.cells_planted(spark, d)))


@query(f"WITH {CELLS} SELECT unit::BIGINT AS unit, g, {r6('delta')}, n FROM delta")
def control_delta(spark, d):
    return rounded(R.deltas(X.cells_planted(spark, d)))


@query(f"WITH {REL} SELECT unit::BIGINT AS unit, n::BIGINT AS n, n_repeats, {r6('mean_r', 'std_r', 'median_r', 'sb_from_median AS rho', 'sqrt(sb_from_median) AS ceiling')} FROM rl WHERE mode = 'max' AND gene_mode = 'all_genes'")
def split_half_reliability(spark, d):
    long = R.reliability_long(R.split_half_r(X.cells_planted(spark, d), X.cell_units(spark, d), REPS))
    return rounded(long.select("unit", "n", "n_repeats", "mean_r", "std_r", "median_r", F.col("sb_from_median").alias("rho"), F.col("ceiling_from_median").alias("ceiling")))


_RL_COLS = ["mean_r", "std_r", "median_r", "q25_r", "q75_r", "min_r", "max_r", "sb_from_mean", "sb_from_median", "sb_mean_per_repeat", "sb_median_per_repeat"]


@query(f"WITH {REL} SELECT unit::BIGINT AS unit, mode, n::BIGINT AS n, gene_mode, n_repeats, {r6(*_RL_COLS)}, round(skewness_r, 4) + 0.0 AS skewness_r FROM rl")
def reliability_curve(spark, d):
    long = _reliability(spark, d).withColumn("skewness_r", F.round("skewness_r", 4))
    return rounded(long.select("unit", "mode", "n", "gene_mode", "n_repeats", *_RL_COLS, "skewness_r"))


@query(f"WITH {REL} SELECT unit::BIGINT AS unit, min(n) FILTER (mode = 'fixed' AND median_r >= 0.5 AND gene_mode = 'all_genes')::DOUBLE AS n_star FROM rl GROUP BY unit")
def n_star(spark, d):
    return rounded(_reliability(spark, d).groupBy("unit").agg(R.n_star("all_genes").alias("n_star")))


_WIDE = ", ".join(
    f"max(n) FILTER (mode = 'max' AND gene_mode = '{m}')::BIGINT AS n_{m}, "
    + ", ".join(f"round(max({c}) FILTER (mode = 'max' AND gene_mode = '{m}'), 6) + 0.0 AS {c}_{m}" for c in ("median_r", "mean_r", "sb_from_median"))
    + f", round(sqrt(max(sb_from_median) FILTER (mode = 'max' AND gene_mode = '{m}')), 6) + 0.0 AS ceiling_from_median_{m}"
    + f", min(n) FILTER (mode = 'fixed' AND median_r >= 0.5 AND gene_mode = '{m}')::DOUBLE AS n_star_{m}"
    for m in ("all_genes", "top_expressed")
)


@query(f"WITH {REL} SELECT unit::BIGINT AS unit, {_WIDE} FROM rl GROUP BY unit")
def reliability_wide(spark, d):
    return rounded(R.reliability_wide(_reliability(spark, d)))


@query(_by_context(REL, "vec_id % 2", range(2), f"SELECT unit::BIGINT AS unit, {_WIDE} FROM rl GROUP BY unit"))
def context_reliability_wide(spark, d):
    """The wide summary of every unit within its context."""
    c, u, by = (_context(X.cells_planted(spark, d)), _context(X.cell_units(spark, d)), ["context"])
    return rounded(R.reliability_wide(R.reliability_long(R.split_half_r(c, u, REPS, GRID, TOPK, by=by), by), by=by))


@query(f"WITH {REL} SELECT g FROM topk")
def topk_expressed_mask(spark, d):
    return rounded(R.top_expressed(X.cells_planted(spark, d), TOPK))


@query(f"WITH {AXIS} SELECT unit::BIGINT AS unit, n_cells, reliable, {r6('cos_sim', 'norm_delta_p', 'norm_delta_avg', 'norm_delta_specific', 'cos_sim * cos_sim AS frac_systematic_var')} FROM axm")
def systematic_axis(spark, d):
    return rounded(_axis(spark, d, _rho(spark, d)))


@query(f"WITH {AXIS} SELECT unit::BIGINT AS unit, n_cells, {r6('rho', 'cos_sim')}, label FROM tri")
def triage_labels(spark, d):
    return rounded(_triage(spark, d))


@query(f"WITH {AXIS} SELECT unit::BIGINT AS unit, CASE WHEN rho < 0.6 THEN 'Unreliable' WHEN rho >= 0.6 AND cos_sim >= 0.8 THEN 'Shared' ELSE 'Specific' END AS label FROM tri")
def triage_alt(spark, d):
    return rounded(_triage(spark, d).select("unit", C.label_alternative(F.col("rho"), F.col("cos_sim"), 0.6, 0.8).alias("label")))


@query(f"WITH {AXIS} SELECT unit::BIGINT AS unit, CASE WHEN rho IS NULL OR rho < 0.5 THEN 'Unreliable' WHEN cos_sim IS NULL OR cos_sim >= sqrt(0.5::DOUBLE) THEN 'Shared' ELSE 'Specific' END AS label FROM tri")
def triage_scalar(spark, d):
    return rounded(_triage(spark, d).select("unit", C.label_scalar(F.col("rho"), F.col("cos_sim")).alias("label")))


_SHARES = ", ".join(f"count(*) FILTER (label = '{c}') AS n_{c.lower()}, {r6(f'avg((label = {chr(39)}{c}{chr(39)})::INT) AS frac_{c.lower()}')}" for c in C.CLASSES)


@query(f"WITH {AXIS} SELECT CASE WHEN grouping(scope) > 0 THEN 'all' ELSE scope END AS scope, count(*) AS n_total, {_SHARES} FROM (SELECT *, CASE WHEN unit % 2 = 0 THEN 'even' ELSE 'odd' END AS scope FROM tri) GROUP BY GROUPING SETS ((), (scope))")
def triage_summary(spark, d):
    t = _triage(spark, d).withColumn("scope", F.when(F.col("unit") % 2 == 0, "even").otherwise("odd"))
    return rounded(C.class_shares(t, "scope"))


@query(f"WITH {SCORES} SELECT dataset, {', '.join(r6(f'avg((cls = {chr(39)}{c}{chr(39)})::INT) AS frac_{c.lower()}') for c in C.CLASSES)} FROM uc GROUP BY dataset")
def triage_by_group(spark, d):
    return rounded(C.class_crosstab(_units(spark, d), "dataset", "cls"))


@query(rf"""WITH {AXIS} SELECT pool, count(unit) AS n, {r6('avg(rho) AS mean_rho')} FROM (
  SELECT 'all' AS pool, unit, rho FROM tri UNION ALL SELECT 'reliable', unit, rho FROM tri WHERE rho >= 0.5 UNION ALL SELECT 'unreliable', unit, rho FROM tri WHERE rho < 0.5
  UNION ALL SELECT 'specific', unit, rho FROM tri WHERE label = 'Specific' UNION ALL SELECT 'shared', unit, rho FROM tri WHERE label = 'Shared') GROUP BY pool""")
def training_pools(spark, d):
    t = _triage(spark, d)
    names = ["all", "reliable", "unreliable", "specific", "shared"]
    hit = F.array(*[F.when(C.pool(p, F.col("rho"), F.col("label")), F.lit(p)) for p in names])
    one = t.select(F.explode(F.array_compact(hit)).alias("pool"), "unit", "rho")
    return rounded(one.groupBy("pool").agg(F.count("unit").alias("n"), F.avg("rho").alias("mean_rho")))


def _context_triage(spark: SparkSession, d: str) -> DataFrame:
    c, u, by = (_context(X.cells_planted(spark, d)), _context(X.cell_units(spark, d)), ["context"])
    rho = R.reliability_long(R.split_half_r(c, u, REPS, by=by), by).select(*by, "unit", F.col("sb_from_median").alias("rho"))
    t = rho.join(R.axis_metrics(c, rho.where("rho >= 0.5"), by=by), [*by, "unit"], "left")
    return t.select(*by, "unit", "n_cells", "rho", "cos_sim", C.label(F.col("rho"), F.col("cos_sim")).alias("label"))


@query(_by_context(AXIS, "vec_id % 2", range(2), f"SELECT unit::BIGINT AS unit, n_cells, {r6('rho', 'cos_sim')}, label FROM tri"))
def context_triage(spark, d):
    """Reliability, axis and label of every unit within its context."""
    return rounded(_context_triage(spark, d))


@query(_by_context(REL, "vec_id % 2", range(2), f"SELECT unit::BIGINT AS unit, mode, n::BIGINT AS n, gene_mode, {r6('median_r', 'sb_from_median AS rho')} FROM rl"))
def context_reliability_curve(spark, d):
    c, u, by = (_context(X.cells_planted(spark, d)), _context(X.cell_units(spark, d)), ["context"])
    long = R.reliability_long(R.split_half_r(c, u, REPS, GRID, TOPK, by=by), by)
    return rounded(long.select(*by, "unit", "mode", "n", "gene_mode", "median_r", F.col("sb_from_median").alias("rho")))


@query("""WITH s AS (SELECT label AS unit, count(*) AS cells FROM embeddings GROUP BY label)
SELECT unit::BIGINT AS unit, cells, (SELECT cells FROM s WHERE unit = 0) AS ctrl_cells FROM s WHERE unit <> 0 AND cells >= 48 AND (SELECT cells FROM s WHERE unit = 0) >= 16""")
def cohort_units(spark, d):
    return rounded(R.cohort(X.cell_units(spark, d), cells=48))


# --- energy distance -----------------------------------------------------------------------------

ENERGY = f"""{CELLS},
vec AS (SELECT cell, unit, list(x ORDER BY g) AS v FROM cells GROUP BY cell, unit),
pd AS (SELECT a.unit, a.cell AS i, b.cell AS j, list_distance(a.v, b.v) AS d FROM vec a JOIN vec b ON a.unit = b.unit),
pc AS (SELECT p.unit, sum(list_distance(p.v, c.v)) AS s FROM vec p, vec c WHERE c.unit = 0 AND p.unit <> 0 GROUP BY p.unit),
sz AS (SELECT unit, count(*) AS n FROM units GROUP BY unit),
sx AS (SELECT unit, sum(d) AS s FROM pd GROUP BY unit),
eb AS (
  SELECT unit, n, 2 * pc.s / (n * n0) - sx.s / (n * n) - s0 / (n0 * n0) AS e_between
  FROM sz JOIN sx USING (unit) JOIN pc USING (unit), (SELECT n AS n0 FROM sz WHERE unit = 0), (SELECT s AS s0 FROM sx WHERE unit = 0) WHERE unit <> 0),
ec AS (
  SELECT unit, e_between, n AS n_cells, n // 2 AS whole, n // 2 AS size FROM eb WHERE n // 2 >= 4
  UNION ALL SELECT unit, e_between, n, n // 2, v FROM eb, (VALUES ({'), ('.join(map(str, GRID))})) t(v) WHERE n // 2 >= 4 AND v >= 4 AND v < n // 2),
eh AS (
  SELECT u.cell, u.unit, size, rep, row_number() OVER (PARTITION BY u.unit, size, rep ORDER BY md5(rep || ':' || size || ':e:' || cell), cell) AS rk
  FROM units u JOIN ec ON u.unit = ec.unit, (SELECT unnest(range(1, {REPS + 1}))::INT AS rep)),
ew AS (
  SELECT pd.unit, a.size, a.rep,
    (2 * sum(CASE WHEN a.rk <= a.size AND b.rk > b.size THEN d ELSE 0 END) - sum(CASE WHEN a.rk <= a.size AND b.rk <= b.size THEN d ELSE 0 END)
     - sum(CASE WHEN a.rk > a.size AND b.rk > b.size THEN d ELSE 0 END)) / (a.size * a.size) AS e_within
  FROM pd JOIN eh a ON pd.unit = a.unit AND pd.i = a.cell JOIN eh b ON pd.unit = b.unit AND pd.j = b.cell AND a.size = b.size AND a.rep = b.rep
  WHERE a.rk <= 2 * a.size AND b.rk <= 2 * b.size GROUP BY pd.unit, a.size, a.rep),
el AS (
  SELECT unit, size, whole, n_cells, e_between, quantile_cont(CASE WHEN e_between > 0 THEN e_within / e_between END, 0.5) AS med FROM ew JOIN ec USING (unit, size) GROUP BY ALL),
er AS (
  SELECT unit, CASE WHEN size = whole THEN -1 ELSE size END AS n_half, med * e_between AS e_within_med, e_between,
    CASE WHEN e_between <= 0 THEN 0.0 ELSE least(greatest(1 - med, -1), 1) END AS rho_e, n_cells FROM el)"""


def _energy(spark: SparkSession, d: str) -> DataFrame:
    return E.reliability_curve(E.vectors(X.cells_planted(spark, d)), REPS, GRID)


@query(f"WITH {ENERGY} SELECT unit::BIGINT AS unit, n, {r6('e_between')} FROM eb")
def energy_between(spark, d):
    return rounded(E.between(E.vectors(X.cells_planted(spark, d))).select("unit", "n", "e_between"))


@query(f"WITH {ENERGY} SELECT unit::BIGINT AS unit, n_half::BIGINT AS n_half, {r6('e_within_med', 'e_between', 'rho_e')}, n_cells FROM er")
def energy_curve(spark, d):
    return rounded(_energy(spark, d))


@query(f"""WITH {CELLS}, vec AS (SELECT cell, cell % 7 AS context, unit, list(x ORDER BY g) AS v FROM cells GROUP BY cell, unit),
own AS (SELECT context, count(*) FILTER (unit = 0) AS k FROM vec GROUP BY context),
pool AS (SELECT o.context, v FROM own o JOIN vec c ON c.unit = 0 AND (o.k < 8 OR c.context = o.context)),
xx AS (SELECT a.context, a.unit, sum(list_distance(a.v, b.v)) AS s, sqrt(count(*)) AS n FROM vec a JOIN vec b ON a.context = b.context AND a.unit = b.unit WHERE a.unit <> 0 GROUP BY ALL),
xy AS (SELECT a.context, a.unit, sum(list_distance(a.v, p.v)) AS s FROM vec a JOIN pool p ON a.context = p.context WHERE a.unit <> 0 GROUP BY ALL),
yy AS (SELECT a.context, sum(list_distance(a.v, b.v)) AS s, sqrt(count(*)) AS m FROM pool a JOIN pool b ON a.context = b.context GROUP BY ALL)
SELECT context, unit::BIGINT AS unit, n::BIGINT AS n, m::BIGINT AS n_ctrl, {r6('2 * xy.s / (n * m) - xx.s / (n * n) - yy.s / (m * m) AS e_between')} FROM xx JOIN xy USING (context, unit) JOIN yy USING (context)""")
def energy_matched_controls(spark, d):
    """Contexts with fewer than 8 controls of their own take all controls."""
    vec = E.vectors(X.cells_planted(spark, d).withColumn("context", F.col("cell") % 7), ["context"])
    return rounded(E.between(vec, ["context"]))


@query(f"""WITH {CELLS},
vec AS (SELECT cell, CASE WHEN unit = 0 AND cell % 3 = 2 AND cell % 40 <> 2 THEN 0 ELSE cell % 3 END AS context, unit, list(x ORDER BY g) AS v FROM cells GROUP BY cell, unit),
own AS (SELECT context, count(*) FILTER (unit = 0) AS k FROM vec GROUP BY context),
pool AS (SELECT o.context, c.cell, c.v FROM own o JOIN vec c ON c.unit = 0 AND (o.k < 8 OR c.context = o.context)),
pd AS (SELECT a.context, a.unit, a.cell AS i, b.cell AS j, list_distance(a.v, b.v) AS d FROM vec a JOIN vec b ON a.context = b.context AND a.unit = b.unit WHERE a.unit <> 0),
xx AS (SELECT context, unit, sum(d) AS s FROM pd GROUP BY ALL),
sz AS (SELECT context, unit, count(*) AS n FROM vec WHERE unit <> 0 GROUP BY ALL),
xy AS (SELECT a.context, a.unit, sum(list_distance(a.v, p.v)) AS s FROM vec a JOIN pool p ON a.context = p.context WHERE a.unit <> 0 GROUP BY ALL),
yy AS (SELECT a.context, sum(list_distance(a.v, b.v)) AS s, sqrt(count(*)) AS m FROM pool a JOIN pool b ON a.context = b.context GROUP BY ALL),
eb AS (SELECT context, unit, n, m, 2 * xy.s / (n * m) - xx.s / (n * n) - yy.s / (m * m) AS e_between FROM sz JOIN xx USING (context, unit) JOIN xy USING (context, unit) JOIN yy USING (context)),
ec AS (
  SELECT context, unit, n // 2 AS size FROM eb WHERE n // 2 >= 4
  UNION ALL SELECT context, unit, v FROM eb, (VALUES ({'), ('.join(map(str, GRID))})) t(v) WHERE v >= 4 AND v < n // 2),
eh AS (
  SELECT vec.cell, vec.context, vec.unit, size, rep, row_number() OVER (PARTITION BY vec.context, vec.unit, size, rep ORDER BY md5(rep || ':' || size || ':e:' || cell), cell) AS rk
  FROM vec JOIN ec ON vec.context = ec.context AND vec.unit = ec.unit, (SELECT unnest(range(1, {REPS + 1}))::INT AS rep)),
ew AS (
  SELECT pd.context, pd.unit, a.size, a.rep, sum(CASE WHEN (a.rk <= a.size) = (b.rk <= b.size) THEN -d ELSE d END) / (a.size * a.size) AS e_within
  FROM pd JOIN eh a ON pd.context = a.context AND pd.unit = a.unit AND pd.i = a.cell JOIN eh b ON pd.context = b.context AND pd.unit = b.unit AND pd.j = b.cell AND a.size = b.size AND a.rep = b.rep
  WHERE a.rk <= 2 * a.size AND b.rk <= 2 * b.size GROUP BY pd.context, pd.unit, a.size, a.rep),
el AS (SELECT context, unit, size, n, m, e_between, quantile_cont(CASE WHEN e_between > 0 THEN e_within / e_between END, 0.5) AS med FROM ew JOIN eb USING (context, unit) GROUP BY ALL)
SELECT context, unit::BIGINT AS unit, CASE WHEN size = n // 2 THEN -1 ELSE size END::BIGINT AS n_half, {r6('med * e_between AS e_within_med', 'e_between', 'CASE WHEN e_between <= 0 THEN 0.0 ELSE least(greatest(1 - med, -1), 1) END AS rho_e')}, n AS n_cells FROM el""")
def energy_context_curve(spark, d):
    """rho_E of each unit and sample size within contexts, one of which has too few controls of its own."""
    context = F.when((F.col("unit") == 0) & (F.col("cell") % 3 == 2) & (F.col("cell") % 40 != 2), 0).otherwise(F.col("cell") % 3)
    vec = E.vectors(X.cells_planted(spark, d).withColumn("context", context.cast("long")), ["context"])
    return rounded(E.reliability_curve(vec, REPS, GRID, ["context"]))


_ENERGY_REST = ENERGY.removeprefix(CELLS).lstrip(",\n")


TWO = f"""{AXIS}, {_ENERGY_REST},
two AS (
  SELECT tri.unit, rho, cos_sim, label, rho_e, CASE WHEN NOT coalesce(rho_e >= 0, false) THEN 'Unreliable' WHEN coalesce(cos_sim * cos_sim >= 0.5, false) THEN 'Shared' ELSE 'Specific' END AS label_e
  FROM tri LEFT JOIN (SELECT unit, rho_e FROM er WHERE n_half = -1) USING (unit))"""


def _two_labels(spark: SparkSession, d: str) -> DataFrame:
    """Units with both reliabilities and the labels that follow from either."""
    e = _energy(spark, d).where("n_half = -1").select("unit", "rho_e")
    return _triage(spark, d).join(e, "unit", "left").withColumn("label_e", C.energy_label(F.col("rho_e"), F.col("cos_sim")))


@query(f"""WITH {TWO},
rk AS (SELECT *, rank() OVER (ORDER BY rho) + (count(*) OVER (PARTITION BY rho) - 1) / 2.0 AS a, rank() OVER (ORDER BY rho_e) + (count(*) OVER (PARTITION BY rho_e) - 1) / 2.0 AS b FROM two WHERE rho IS NOT NULL AND rho_e IS NOT NULL)
SELECT {r6('covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS spearman', 'avg((label = label_e)::INT) AS agreement')}, count(*) AS n, count(*) FILTER (label_e <> label) AS n_changed FROM rk""")
def energy_vs_pearson(spark, d):
    t = _two_labels(spark, d).where("rho is not null and rho_e is not null")
    t = t.withColumn("a", S.rank_average(F.asc("rho"), "rho", [])).withColumn("b", S.rank_average(F.asc("rho_e"), "rho_e", []))
    same = (F.col("label") == F.col("label_e")).cast("int")
    return rounded(t.agg(S.pearson_or_null("a", "b").alias("spearman"), F.avg(same).alias("agreement"), F.count("*").alias("n"), F.sum(1 - same).alias("n_changed")))


@query(f"""WITH {TWO},
sr AS (SELECT unnest(['all', CASE WHEN unit % 2 = 0 THEN 'even' ELSE 'odd' END]) AS scope, rho, rho_e, label, label_e FROM two WHERE rho IS NOT NULL AND rho_e IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY scope ORDER BY rho) + (count(*) OVER (PARTITION BY scope, rho) - 1) / 2.0 AS a, rank() OVER (PARTITION BY scope ORDER BY rho_e) + (count(*) OVER (PARTITION BY scope, rho_e) - 1) / 2.0 AS b FROM sr),
ag AS (SELECT scope, covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS spearman, avg((label = label_e)::INT) AS po, count(*) AS n FROM rk GROUP BY scope),
l1 AS (SELECT scope, label AS k, count(*) AS n1 FROM sr GROUP BY ALL), l2 AS (SELECT scope, label_e AS k, count(*) AS n2 FROM sr GROUP BY ALL),
ch AS (SELECT scope, sum(n1 * n2) AS cr FROM l1 JOIN l2 USING (scope, k) GROUP BY scope),
pe AS (SELECT ag.*, coalesce(cr, 0) / (n * n) AS pe FROM ag LEFT JOIN ch USING (scope))
SELECT scope, {r6('spearman', 'po AS agreement', '(po - pe) / nullif(1 - pe, 0) AS kappa')}, n FROM pe""")
def energy_validation(spark, d):
    """Spearman, agreement and kappa, pooled and for each scope (even and odd units)."""
    scope = F.explode(F.array(F.lit("all"), F.when(F.col("unit") % 2 == 0, "even").otherwise("odd")))
    return rounded(I.compare_scorings(_two_labels(spark, d).withColumn("scope", scope), "rho", "rho_e", "label", "label_e", C.CLASSES, ["scope"]))


# --- benchmark tables ----------------------------------------------------------------------------


@query(f"WITH {SCORES} SELECT method, dataset, unit, fold, {r6('score', 'rho', 'ce')}, cls FROM sq")
def score_triage_join(spark, d):
    s = X.scores(spark, d).drop("unit").withColumn("unit", K.strip_fold("op"))
    j = B.join_triage(s, _units(spark, d), ["dataset", "unit"], ["rho"]).withColumn("ce", S.ratio(F.col("score"), F.sqrt("rho")))
    return rounded(j.select("method", "dataset", "unit", "fold", "score", "rho", "ce", "cls"))


_NORM = "lower(replace(translate({0}, ' .', '__'), '-', ''))"
_DIRTY = "CASE WHEN fold = 0 THEN 'Pat' || upper(unit) WHEN fold = 1 THEN replace(unit, '#', '-#') ELSE unit END"


@query(f"""WITH {SCORES}, p AS (SELECT DISTINCT dataset, {_DIRTY} AS op, {_NORM.format(_DIRTY)} AS k FROM sc),
t AS (SELECT dataset, unit, {_NORM.format('unit')} AS k, cls FROM uc)
SELECT p.dataset, op, coalesce(a.unit, b.unit) AS matched FROM p LEFT JOIN t a ON p.dataset = a.dataset AND p.k = a.k LEFT JOIN t b ON p.dataset = b.dataset AND replace(p.k, 'pat', '') = b.k
WHERE coalesce(a.unit, b.unit) IS NOT NULL""")
def score_fallback_join(spark, d):
    dirty = F.when(F.col("fold") == 0, F.concat(F.lit("Pat"), F.upper("unit"))).when(F.col("fold") == 1, F.replace("unit", F.lit("#"), F.lit("-#"))).otherwise(F.col("unit"))
    probe = X.scores(spark, d).select("dataset", dirty.alias("op")).distinct()
    return B.join_with_fallback(probe, _units(spark, d).select("dataset", F.col("unit").alias("condition")), "op", "condition").select("dataset", "op", "matched")


@query(f"""WITH {SCORES}, u AS (SELECT DISTINCT unit FROM uc),
p AS (SELECT a.unit || '+' || b.unit AS label, least(a.unit, b.unit) || '+' || greatest(a.unit, b.unit) AS k FROM u a, u b WHERE a.unit <> b.unit),
q AS (SELECT DISTINCT k, length(k) AS w FROM p) SELECT label, k AS pair, w::BIGINT AS w FROM p JOIN q USING (k)""")
def pair_key_join(spark, d):
    u = X.unit_quality(spark, d).select("unit").distinct()
    pairs = u.crossJoin(F.broadcast(u.withColumnRenamed("unit", "other"))).where("unit <> other").select(F.concat_ws("+", "unit", "other").alias("label"))  # 25 x 25
    pairs = pairs.withColumn("pair", K.pair_key("label"))
    return rounded(pairs.join(pairs.select("pair").distinct().withColumn("w", F.length("pair")), "pair").select("label", "pair", "w"))


@query(f"WITH {EXCESS} SELECT method, {r6('excess')}, n_datasets FROM xa")
def baseline_excess(spark, d):
    return rounded(B.excess_by_method(_scored(spark, d), BASELINE))


@query(f"""WITH {EXCESS}, j AS (SELECT method, xa.excess AS a, coalesce(xs.excess, 0) AS s FROM xa LEFT JOIN xs USING (method)),
k AS (SELECT method, a, s, {_rank_trunc('a')} AS ra, {_rank_trunc('s')} AS rs FROM j)
SELECT method, {r6('a AS excess_all', 's AS excess_specific')}, ra AS rank_all, rs AS rank_specific, ra - rs AS shift, abs(ra - rs) >= 3 AS large FROM k""")
def rank_all_vs_specific(spark, d):
    return rounded(B.rank_shift(_scored(spark, d), BASELINE))


@query(f"""WITH {EXCESS}, m AS (SELECT dataset, cls, method, avg(excess) AS e FROM (SELECT dataset, 'all' AS cls, method, excess FROM ex UNION ALL SELECT dataset, cls, method, excess FROM ex WHERE cls = 'Specific') GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY dataset, cls ORDER BY e DESC, method) AS rn FROM m)
SELECT a.dataset, a.method AS top_all, s.method AS top_specific, a.method <> s.method AS changed, o.rn AS old_top_new_rank
FROM k a JOIN k s ON a.dataset = s.dataset AND a.rn = 1 AND s.rn = 1 AND a.cls = 'all' AND s.cls = 'Specific' JOIN k o ON o.dataset = a.dataset AND o.cls = 'Specific' AND o.method = a.method""")
def top_method_change(spark, d):
    ex = B.fold_excess(_scored(spark, d), BASELINE)
    m = lambda rows: rows.groupBy("dataset", "method").agg(F.avg("excess").alias("excess"))
    every, some = m(ex), m(ex.where("cls = 'Specific'"))
    rank = some.withColumn("rn", F.row_number().over(S.over(["dataset"], F.desc("excess"), F.col("method"))))
    a = B.top_method(every, ["dataset"]).select("dataset", F.col("method").alias("top_all"))
    s = rank.where("rn = 1").select("dataset", F.col("method").alias("top_specific"))
    o = rank.select("dataset", F.col("method").alias("top_all"), F.col("rn").alias("old_top_new_rank"))
    return rounded(a.join(s, "dataset").join(o, ["dataset", "top_all"]).withColumn("changed", F.col("top_all") != F.col("top_specific")))


@query(f"""WITH {SCORES}, m AS (
  SELECT method, avg(score) AS mean_all, quantile_cont(score, 0.5) AS median_all, count(score) AS n_all, avg(score) FILTER (cls = 'Specific') AS mean_specific, quantile_cont(score, 0.5) FILTER (cls = 'Specific') AS median_specific,
    count(score) FILTER (cls = 'Specific') AS n_specific, avg(score) FILTER (cls = 'Shared') AS mean_shared, count(score) FILTER (cls = 'Shared') AS n_shared, avg(ce) AS mean_ce FROM sq GROUP BY method),
k AS (SELECT *, {_rank_trunc('mean_all')} AS rank_all, {_rank_trunc('mean_specific')} AS rank_specific FROM m)
SELECT method, n_all, n_specific, n_shared, rank_all, rank_specific, rank_all - rank_specific AS rank_delta,
  {r6('mean_all', 'median_all', 'mean_specific', 'median_specific', 'mean_shared', 'mean_ce', 'mean_all - mean_specific AS drop_specific')} FROM k""")
def method_rankings(spark, d):
    return rounded(B.method_rankings(_scored(spark, d)))


@query(f"""WITH {SCORES}, c AS (SELECT method, dataset, avg(CASE WHEN abs(sqrt(rho)) > 0.05 THEN score / sqrt(rho) END) AS m FROM sq WHERE cls = 'Specific' GROUP BY ALL)
SELECT method, {r6('avg(m) AS ce')}, count(m) AS n_datasets FROM c GROUP BY method""")
def ceiling_efficiency(spark, d):
    s = _scored(spark, d).where("cls = 'Specific'").withColumn("ce", S.guarded_ratio(F.col("score"), F.sqrt("rho"), 0.05))
    return rounded(B.dataset_weighted(s, "ce", ["method"]))


@query(f"""WITH {SCORES}, b AS (SELECT dataset, unit, fold, max(score) AS base FROM sc WHERE method = '{BASELINE}' GROUP BY ALL)
SELECT method, cls, {r6('avg(CASE WHEN abs(score) > 1e-3 THEN base / score END) AS mean_fraction')}, count(CASE WHEN abs(score) > 1e-3 THEN base / score END) AS n FROM sq LEFT JOIN b USING (dataset, unit, fold) WHERE method <> '{BASELINE}' GROUP BY method, cls""")
def shared_fraction(spark, d):
    f = B.shared_fraction(_scored(spark, d), BASELINE)
    return rounded(f.groupBy("method", "cls").agg(F.avg("shared_fraction").alias("mean_fraction"), F.count("shared_fraction").alias("n")))


@query(f"WITH {EXCESS} SELECT method, {r6('avg((excess > 0)::INT) * 100 AS win_pct')}, count(*) AS n FROM ex GROUP BY method")
def win_rate(spark, d):
    return rounded(B.win_rate(_scored(spark, d), BASELINE))


@query(f"""WITH {SCORES}, k AS (SELECT dataset, rank() OVER (PARTITION BY dataset ORDER BY score) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY dataset ORDER BY score2) + (count(*) OVER (PARTITION BY dataset, score2) - 1) / 2.0 AS b
  FROM (SELECT dataset, round(score, 9) AS score, round(score2, 9) AS score2 FROM sc))
SELECT dataset, {r6('covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS spearman')}, count(*) AS n FROM k GROUP BY dataset""")
def spearman_avg_rank(spark, d):
    s = X.scores(spark, d).withColumn("score", F.round("score", 9)).withColumn("score2", F.round("score2", 9))
    return rounded(I.spearman(s, "score", "score2", ["dataset"]))


@query(f"""WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), t AS (SELECT sum(n) AS total, sum(n) FILTER (a = b) AS same FROM c),
e AS (SELECT sum(x.n * y.n) AS cr FROM (SELECT a AS k, sum(n) AS n FROM c GROUP BY a) x JOIN (SELECT b AS k, sum(n) AS n FROM c GROUP BY b) y USING (k))
SELECT {r6('same / total AS agreement', '(same / total - cr / (total * total)) / (1 - cr / (total * total)) AS kappa')}, total::BIGINT AS n FROM t, e""")
def cohen_kappa(spark, d):
    return rounded(I.kappa(IO.table(spark, d, "labels"), "quality", "toxic"))


_CELLGRID = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


@query(f"""WITH {EXCESS}, gr AS (SELECT r, c FROM (VALUES ({'::DOUBLE), ('.join(map(str, _CELLGRID))}::DOUBLE)) a(r), (VALUES ({'::DOUBLE), ('.join(map(str, _CELLGRID))}::DOUBLE)) b(c)),
l AS (SELECT r, c, ex.*, CASE WHEN rho < r THEN 'Unreliable' WHEN rho >= r AND cos >= sqrt(c) THEN 'Shared' ELSE 'Specific' END AS k FROM ex, gr),
m AS (SELECT r, c, method, avg(e) AS excess FROM (SELECT r, c, method, dataset, avg(excess) AS e FROM l WHERE k = 'Specific' GROUP BY ALL) GROUP BY ALL)
SELECT r AS rho_min, c AS phi_min, method, {r6('excess')}, rank() OVER (PARTITION BY r, c ORDER BY excess DESC) + (count(*) OVER (PARTITION BY r, c, excess) - 1) / 2.0::DOUBLE AS rank FROM m""")
def threshold_grid(spark, d):
    ex = B.fold_excess(_scored(spark, d), BASELINE)
    grid = F.explode(F.array(*[F.struct(F.lit(r).alias("rho_min"), F.lit(c).alias("phi_min")) for r in _CELLGRID for c in _CELLGRID])).alias("t")
    l = ex.select("*", grid).select("*", "t.*").where(C.label_alternative(F.col("rho"), F.col("cos"), F.col("rho_min"), F.sqrt("phi_min")) == "Specific")
    m = B.dataset_weighted(l, "excess", ["rho_min", "phi_min", "method"]).drop("n_datasets")
    return rounded(m.withColumn("rank", S.rank_average(F.desc("excess"), "excess", ["rho_min", "phi_min"])))


BOOTS = f"""{EXCESS},
un AS (SELECT method, dataset, unit, cls, avg(excess) AS excess FROM ex GROUP BY ALL),
pl AS (SELECT dataset, cls, unit, row_number() OVER (PARTITION BY dataset, cls ORDER BY unit) - 1 AS pos, count(*) OVER (PARTITION BY dataset, cls) AS size FROM (SELECT DISTINCT dataset, cls, unit FROM un)),
dr AS (SELECT iter, dataset, cls, ('0x' || substr(md5('boot:' || iter || ':' || dataset || ':' || cls || ':' || pos), 1, 8))::BIGINT % size AS pick FROM pl, (SELECT unnest(range(1, {BOOT + 1})) AS iter)),
wt AS (SELECT iter, pl.dataset, pl.cls, unit, count(*) AS w FROM dr JOIN pl ON dr.dataset = pl.dataset AND dr.cls = pl.cls AND dr.pick = pl.pos GROUP BY ALL),
pr AS (SELECT iter, method, dataset, sum(w * excess) / sum(w) AS a, sum(w * excess) FILTER (cls = 'Specific') / sum(w) FILTER (cls = 'Specific') AS s FROM wt JOIN un USING (dataset, cls, unit) GROUP BY ALL),
mn AS (SELECT iter, method, avg(a) AS a, avg(s) AS s FROM pr GROUP BY ALL),
bl AS (SELECT iter, method, 'all' AS stratum, a AS excess FROM mn UNION ALL SELECT iter, method, 'specific', s FROM mn),
br AS (SELECT *, CASE WHEN excess IS NOT NULL THEN rank() OVER (PARTITION BY iter, stratum ORDER BY round(excess, 12) DESC NULLS LAST) END AS rank FROM bl)"""


def _excess_units(spark: SparkSession, d: str) -> DataFrame:
    return B.fold_excess(_scored(spark, d), BASELINE).groupBy("method", "dataset", "unit", "cls").agg(F.avg("excess").alias("excess"))


def _boot(spark: SparkSession, d: str) -> DataFrame:
    return BS.bootstrap_ranks(_excess_units(spark, d), BOOT)


# Nine digits: at six, some excesses lie on a rounding border and the order of a sum decides.
@query(f"WITH {BOOTS} SELECT iter, method, stratum, round(excess, 9) + 0.0 AS excess, rank FROM br")
def bootstrap_ranks(spark, d):
    return rounded(_boot(spark, d), 9)


@query(f"""WITH {BOOTS}, ok AS (SELECT dataset FROM un WHERE cls = 'Specific' GROUP BY dataset HAVING count(DISTINCT unit) >= 5),
dl AS (SELECT iter, dataset, method, 'all' AS stratum, a AS excess FROM pr UNION ALL SELECT iter, dataset, method, 'specific', s FROM pr)
SELECT iter, dataset, method, stratum, round(excess, 9) + 0.0 AS excess, CASE WHEN excess IS NOT NULL THEN rank() OVER (PARTITION BY iter, dataset, stratum ORDER BY round(excess, 12) DESC NULLS LAST) END AS rank FROM dl JOIN ok USING (dataset)""")
def bootstrap_ranks_by_dataset(spark, d):
    return rounded(BS.bootstrap_ranks_by_dataset(_excess_units(spark, d), BOOT), 9)


_BQ = ", ".join(f"{r6(f'quantile_cont({c}::DOUBLE, {q}) AS {n}_{p}')}" for c, n in (("ra", "rank_all"), ("rs", "rank_specific"), ("ra - rs", "shift"), ("xa", "excess")) for q, p in ((0.025, "low"), (0.5, "median"), (0.975, "high"))).replace("quantile_cont(ra - rs::DOUBLE", "quantile_cont((ra - rs)::DOUBLE")


@query(f"""WITH {BOOTS}, w AS (SELECT iter, method, max(rank) FILTER (stratum = 'all') AS ra, max(rank) FILTER (stratum = 'specific') AS rs, max(excess) FILTER (stratum = 'all') AS xa FROM br GROUP BY ALL)
SELECT method, {_BQ}, quantile_cont((ra - rs)::DOUBLE, 0.025) <= 0 AND quantile_cont((ra - rs)::DOUBLE, 0.975) >= 0 AS stable FROM w GROUP BY method""")
def bootstrap_ci(spark, d):
    return rounded(BS.bootstrap_summary(_boot(spark, d)))


# Retraining scores: line number 1 is the treated arm, the others are comparators, discount and tax the metrics.
PAIRS = r"""pe0 AS (SELECT r_name AS dataset, p_brand AS unit, l_linenumber AS k, l_discount AS up_metric, l_tax AS down_metric
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
pt AS (SELECT dataset, unit, avg(up_metric) AS u, avg(down_metric) AS w FROM pe0 WHERE k = 1 GROUP BY ALL),
pc AS (SELECT 'arm' || k AS comparator, dataset, unit, avg(up_metric) AS u, avg(down_metric) AS w FROM pe0 WHERE k > 1 GROUP BY ALL),
pe AS (SELECT comparator, dataset, unit, 'up_metric' AS metric, pt.u AS score_treatment, pc.u AS score_comparator, pt.u - pc.u AS effect FROM pc JOIN pt USING (dataset, unit)
  UNION ALL SELECT comparator, dataset, unit, 'down_metric', pt.w, pc.w, pc.w - pt.w FROM pc JOIN pt USING (dataset, unit))"""


def _effects(spark: SparkSession, d: str) -> DataFrame:
    line = IO.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", F.col("l_discount").alias("up_metric"), F.col("l_tax").alias("down_metric"))
    part = IO.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("unit"))
    supp = IO.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    nation = IO.table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    region = IO.table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("dataset"))
    rows = line.join(part, "l_partkey").join(supp, "l_suppkey").join(nation, "n_nationkey").join(region, "r_regionkey").withColumn("arm", F.concat(F.lit("arm"), "l_linenumber"))
    return T.paired_effects(rows, "arm1", [f"arm{k}" for k in range(2, 8)], ["dataset", "unit"], {"up_metric": True, "down_metric": False})


# Nine digits: means of two-decimal values often end in a 5 at the seventh.
@query(f"WITH {PAIRS} SELECT comparator, dataset, unit, metric, {', '.join(f'round({c}, 9) + 0.0 AS {c}' for c in ('score_treatment', 'score_comparator', 'effect'))} FROM pe")
def paired_effects(spark, d):
    return rounded(_effects(spark, d), 9)


@query(f"""WITH {PAIRS}, pl AS (SELECT *, row_number() OVER (PARTITION BY comparator, dataset, metric ORDER BY unit) - 1 AS pos, count(*) OVER (PARTITION BY comparator, dataset, metric) AS size FROM pe),
dr AS (SELECT iter, comparator, dataset, metric, ('0x' || substr(md5('ci:' || iter || ':' || comparator || ':' || dataset || ':' || metric || ':' || pos), 1, 8))::BIGINT % size AS pick FROM pl, (SELECT unnest(range(1, {BOOT + 1})) AS iter)),
ms AS (SELECT iter, comparator, dataset, metric, avg(effect) AS m FROM dr JOIN pl USING (comparator, dataset, metric) WHERE pick = pos GROUP BY ALL),
ci AS (SELECT comparator, dataset, metric, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM ms GROUP BY ALL),
g AS (SELECT comparator, dataset, metric, count(effect) AS n, avg(effect) AS mean, quantile_cont(effect, 0.5) AS median FROM pe GROUP BY ALL),
f AS (SELECT g.*, CASE WHEN n > 1 THEN lo END AS ci_low, CASE WHEN n > 1 THEN hi END AS ci_high FROM g JOIN ci USING (comparator, dataset, metric))
SELECT comparator, dataset, metric, n, {r6('mean', 'median', 'ci_low', 'ci_high')}, CASE WHEN ci_low IS NULL THEN 'insufficient_n' WHEN ci_low > 0 THEN 'better' WHEN ci_high < 0 THEN 'worse' ELSE 'inconclusive' END AS conclusion FROM f""")
def effect_intervals(spark, d):
    return rounded(BS.effect_interval(_effects(spark, d), ["comparator", "dataset", "metric"], "effect", ["unit"], BOOT))


@query(f"""WITH {PAIRS} SELECT comparator, dataset, metric, count(*) AS n_units, {r6('avg(effect) AS mean_effect', 'quantile_cont(effect, 0.5) AS median_effect', 'min(effect) AS min_effect', 'max(effect) AS max_effect', 'stddev_samp(effect) AS std_effect', 'stddev_samp(effect) / sqrt(count(effect)) AS sem_effect')}
FROM pe GROUP BY ALL""")
def dataset_level(spark, d):
    e = F.col("effect")
    return rounded(_effects(spark, d).groupBy("comparator", "dataset", "metric").agg(F.count("*").alias("n_units"), F.avg(e).alias("mean_effect"), F.percentile(e, F.lit(0.5)).alias("median_effect"), F.min(e).alias("min_effect"), F.max(e).alias("max_effect"), F.stddev_samp(e).alias("std_effect"), S.sem(e).alias("sem_effect")))


def _by_unit(spark: SparkSession, d: str) -> DataFrame:
    return _effects(spark, d).groupBy("comparator", "metric", "unit").agg(F.round(F.avg("effect"), 9).alias("effect"))


UNITS_EFFECT = f"""{PAIRS}, ue AS (SELECT comparator, metric, unit, round(avg(effect), 9) AS effect FROM pe GROUP BY ALL), nz AS (SELECT * FROM ue WHERE abs(effect) >= 1e-6)"""


@query(f"""WITH {UNITS_EFFECT}, c AS (SELECT comparator, metric, count(*) AS n, count(*) FILTER (effect > 0) AS n_pos FROM nz GROUP BY ALL)
SELECT comparator, metric, n, n_pos, round(least(1, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM (SELECT unnest(range(0, least(n_pos, n - n_pos) + 1)) AS i))), 6) + 0.0 AS p_sign FROM c""")
def sign_test(spark, d):
    return rounded(I.sign_test(_by_unit(spark, d), ["comparator", "metric"], "effect"))


@query(f"""WITH {UNITS_EFFECT}, k AS (SELECT *, rank() OVER (PARTITION BY comparator, metric ORDER BY abs(effect)) + (count(*) OVER (PARTITION BY comparator, metric, abs(effect)) - 1) / 2.0 AS r FROM nz)
SELECT comparator, metric, count(*) AS n, least(coalesce(sum(r) FILTER (effect > 0), 0), coalesce(sum(r) FILTER (effect < 0), 0))::DOUBLE AS w FROM k GROUP BY ALL""")
def wilcoxon_statistic(spark, d):
    return rounded(I.wilcoxon_statistic(_by_unit(spark, d), ["comparator", "metric"], "effect"))


# erfc(x) = 1 - 2 / sqrt(pi) exp(-x^2) sum of positive terms; rank sums are counted in a list, rank by rank.
@query(f"""WITH RECURSIVE {UNITS_EFFECT}, k AS (SELECT *, rank() OVER (PARTITION BY comparator, metric ORDER BY abs(effect)) + (count(*) OVER (PARTITION BY comparator, metric, abs(effect)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY comparator, metric, abs(effect)) AS t FROM nz),
c AS (SELECT comparator, metric, count(*) AS n, least(coalesce(sum(r) FILTER (effect > 0), 0), coalesce(sum(r) FILTER (effect < 0), 0)) AS w, sum(t * t - 1) AS ties FROM k GROUP BY ALL),
ws AS (SELECT 0 AS j, list_transform(range(0, 1276), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0 END) AS a
  UNION ALL SELECT j + 1, list_transform(range(0, 1276), lambda i: a[i + 1] + CASE WHEN i > j THEN a[i - j] ELSE 0 END) FROM ws WHERE j < 50),
z AS (SELECT *, abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) / sqrt(2) AS x FROM c)
SELECT comparator, metric, n, CASE WHEN n >= 5 THEN w END AS w, CASE WHEN n >= 5 THEN round(least(1, CASE WHEN n <= 50 AND ties = 0 THEN 2 * list_sum(a[1:floor(w)::INT + 1]) / 2.0::DOUBLE ** n
  ELSE 1 - exp(-x * x) * list_sum(list_transform(range(0, 150), lambda i: CASE WHEN x > 0 THEN exp((2 * i + 1) * ln(x) - lgamma(i + 1.5)) ELSE 0 END)) END), 6) + 0.0 END AS p_wilcoxon FROM z LEFT JOIN ws ON j = n""")
def wilcoxon(spark, d):
    return rounded(I.wilcoxon(_by_unit(spark, d), ["comparator", "metric"], "effect"))


# --- splits and subsets --------------------------------------------------------------------------


@query("""WITH u AS (SELECT p_partkey AS unit, p_brand || '|' || p_type AS stratum FROM part), n AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY md5('split:' || unit), unit) AS rk FROM u)
SELECT unit, stratum, CASE WHEN n >= 2 AND rk <= greatest(1, round_even(0.25 * n, 0)) THEN 'test' ELSE 'train' END AS split FROM n""")
def stratified_split(spark, d):
    u = IO.table(spark, d, "part").select(F.col("p_partkey").alias("unit"), F.concat_ws("|", "p_brand", "p_type").alias("stratum"))
    return W.split_test(u, ["stratum"], [F.lit("split"), "unit"], "unit").select("unit", "stratum", "split")


@query("""WITH u AS (SELECT p_partkey AS unit, p_brand AS grp FROM part), k AS (SELECT grp, rep, unit, row_number() OVER (PARTITION BY grp, rep ORDER BY md5('sub:' || rep || ':' || unit), unit) AS rk FROM u, (SELECT unnest(range(1, 4)) AS rep))
SELECT grp, rep, unit FROM k WHERE rk <= 5""")
def matched_subsets(spark, d):
    u = IO.table(spark, d, "part").select(F.col("p_partkey").alias("unit"), F.col("p_brand").alias("grp"))
    return rounded(W.subset(W.repeats(u, 3), ["grp", "rep"], [F.lit("sub"), "rep", "unit"], "unit", 5).select("grp", "rep", "unit"))


# --- predictors ----------------------------------------------------------------------------------

WELCH = f"""{CELLS}, mm AS (SELECT unit, g, avg(x) AS m, var_samp(x) AS v, count(*) AS n FROM cells GROUP BY ALL),
tt AS (SELECT a.unit, a.g, coalesce((a.m - b.m) / nullif(sqrt(a.v / a.n + b.v / b.n), 0), 0) AS t FROM mm a JOIN mm b ON a.g = b.g AND b.unit = 0 WHERE a.unit <> 0),
tk AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY abs(t) DESC, g) AS rk FROM tt)"""


@query(f"WITH {WELCH} SELECT unit::BIGINT AS unit, g, {r6('t')}, rk FROM tk WHERE rk <= {TOPK}")
def welch_topk(spark, d):
    return rounded(R.top_by(R.welch_t(X.cells_planted(spark, d)), ["unit"], "t", TOPK))


@query(f"""WITH {WELCH}, p AS (SELECT unit, g, row_number() OVER (PARTITION BY unit ORDER BY abs(delta) DESC, g) AS rk FROM delta),
h AS (SELECT p.unit, count(*) AS hits FROM p JOIN tk ON p.unit = tk.unit AND p.g = tk.g WHERE p.rk <= {TOPK} AND tk.rk <= {TOPK} GROUP BY ALL)
SELECT u.unit::BIGINT AS unit, {r6(f'coalesce(hits, 0) / {TOPK}::DOUBLE AS overlap')} FROM (SELECT DISTINCT unit FROM delta) u LEFT JOIN h ON u.unit = h.unit""")
def common_topk_overlap(spark, d):
    c = X.cells_planted(spark, d)
    return rounded(T.common_top(R.deltas(c).select("unit", "g", F.col("delta").alias("pred")), R.welch_t(c), TOPK))


@query(f"WITH {CELLS} SELECT g, {r6('avg(delta) AS pred')} FROM delta GROUP BY g")
def mean_predictor(spark, d):
    train = R.deltas(X.cells_planted(spark, d)).withColumn("arm", F.lit("all"))
    return rounded(T.mean_predictor(train, ["arm"]).drop("arm"))


@query(f"""WITH {CELLS}, u AS (SELECT DISTINCT unit FROM delta), c AS (SELECT a.unit AS a, b.unit AS b FROM u a, u b WHERE a.unit < b.unit)
SELECT 'u' || a || '+u' || b AS combo, x.g, {r6('x.delta + y.delta AS pred')} FROM c JOIN delta x ON x.unit = a JOIN delta y ON y.unit = b AND x.g = y.g""")
def additive_predictor(spark, d):
    singles = R.deltas(X.cells_planted(spark, d)).select(F.concat(F.lit("u"), "unit").alias("name"), "g", "delta")
    u = X.cell_units(spark, d).where("unit <> 0").select("unit").distinct()
    combos = u.crossJoin(F.broadcast(u.withColumnRenamed("unit", "b"))).where("unit < b").select(F.concat(F.lit("u"), "unit", F.lit("+u"), "b").alias("combo"))  # a grid of units
    return rounded(T.additive_predictor(singles, combos))


# Prediction of a unit: mean of the other units' deltas plus half its own effect.
PRED = f"""{CELLS}, pr AS (SELECT unit, g, delta, (sum(delta) OVER (PARTITION BY g) - delta) / (count(*) OVER (PARTITION BY g) - 1) + 0.5 * delta AS pred FROM delta)"""


def _predictions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    t = R.deltas(X.cells_planted(spark, d))
    w = Window.partitionBy("g")
    p = t.select("unit", "g", ((F.sum("delta").over(w) - F.col("delta")) / (F.count(F.lit(1)).over(w) - 1) + 0.5 * F.col("delta")).alias("pred"))
    return p, t.select("unit", "g", "delta")


@query(f"""WITH {PRED}, d AS (SELECT a.unit AS i, b.unit AS j, sqrt(sum((a.pred - b.delta) ** 2)) AS d FROM pr a JOIN pr b ON a.g = b.g GROUP BY ALL), o AS (SELECT i, d AS d0 FROM d WHERE i = j)
SELECT i::BIGINT AS unit, {r6('CASE WHEN count(*) > 1 THEN count(*) FILTER (d > d0) / (count(*) - 1) END AS accuracy')} FROM d JOIN o USING (i) GROUP BY i""")
def centroid_accuracy(spark, d):
    p, t = _predictions(spark, d)
    return rounded(T.centroid_accuracy(p.withColumn("arm", F.lit(1)), t.withColumn("arm", F.lit(1)), ["arm"]).drop("arm"))


@query(f"""WITH {PRED}, {WELCH.removeprefix(CELLS).lstrip(', ')}, j AS (SELECT pr.* FROM pr JOIN tk ON pr.unit = tk.unit AND pr.g = tk.g WHERE rk <= {TOPK})
SELECT unit::BIGINT AS unit, {r6('covar_pop(pred, delta) / (stddev_pop(pred) * stddev_pop(delta)) AS pcc', 'avg((pred - delta) ** 2) AS mse', 'sqrt(sum((pred - delta) ** 2)) AS l2')}, count(*) AS n_genes FROM j GROUP BY unit""")
def prediction_metrics(spark, d):
    p, t = _predictions(spark, d)
    return rounded(T.prediction_metrics(p, t, ["unit"], R.top_by(R.welch_t(X.cells_planted(spark, d)), ["unit"], "t", TOPK)))


@query(f"""WITH {PRED}, cm AS (SELECT g, avg(x) AS m FROM cells WHERE unit = 0 GROUP BY g), tk AS (SELECT g, m FROM cm ORDER BY m DESC, g LIMIT {TOPK}), j AS (SELECT unit, pred, delta, m + pred AS pe, m + delta AS oe FROM pr JOIN tk USING (g))
SELECT unit::BIGINT AS unit, {r6('sqrt(sum((pred - delta) ** 2)) AS l2', 'CASE WHEN stddev_pop(pred) >= 1e-12 AND stddev_pop(delta) >= 1e-12 THEN covar_pop(pred, delta) / (stddev_pop(pred) * stddev_pop(delta)) END AS pcc_delta', 'CASE WHEN stddev_pop(pe) >= 1e-12 AND stddev_pop(oe) >= 1e-12 THEN covar_pop(pe, oe) / (stddev_pop(pe) * stddev_pop(oe)) END AS r_raw')}, count(*) AS n_genes FROM j GROUP BY unit""")
def expression_metrics(spark, d):
    p, t = _predictions(spark, d)
    control = R.centroids(X.cells_planted(spark, d)).where("unit = 0").select("g", "m")
    return rounded(T.expression_metrics(p, t, control, ["unit"], TOPK))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Units with mean expression and delta as arrays; the target gene of unit u is gene u."""
    c = X.cells_planted(spark, d)
    arr = lambda v: F.transform(F.array_sort(F.collect_list(F.struct("g", v))), lambda s: s[v])
    expr = R.centroids(c).where("unit <> 0").groupBy("unit").agg(arr("m").alias("expr"))
    both = R.deltas(c).groupBy("unit").agg(arr("delta").alias("delta")).join(expr, "unit")
    return both.withColumn("target", F.col("unit").cast("int"))


@query()
def ridge_predictor(spark, d):
    """Predictions for all units."""
    both = _vectors(spark, d).withColumn("arm", F.lit("all"))
    return rounded(T.ridge_predictor(both, both, ["arm"]))


# --- saturation ----------------------------------------------------------------------------------

# Points: the fixed-size reliabilities of each unit (N = 2 n) and its largest split.
POINTS = f"""{REL}, pt0 AS (SELECT unit, 2 * n AS n_total, least(greatest(sb_from_median, 0), 0.999) AS rho FROM rl WHERE gene_mode = 'all_genes'),
pt AS (SELECT * FROM pt0 WHERE unit IN (SELECT unit FROM pt0 GROUP BY unit HAVING count(DISTINCT n_total) >= 2)),
gk AS (SELECT k, exp(ln(1e-8::DOUBLE) + k * ((ln(10::DOUBLE) - ln(1e-8::DOUBLE)) / {N.GRID})) AS tau_sq FROM (SELECT unnest(range(0, {N.GRID + 1})) AS k)),
ss AS (SELECT unit, k, max(tau_sq) AS tau_sq, sum((rho - n_total * tau_sq / (n_total * tau_sq + 1)) ** 2) AS sse FROM pt, gk GROUP BY unit, k),
bs AS (SELECT unit, tau_sq, sse FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY round(sse, 12), k) AS rn FROM ss) WHERE rn = 1),
ft AS (SELECT unit, tau_sq, CASE WHEN sst > 1e-12 THEN 1 - sse / sst ELSE 0.0 END AS fit_r2, n_points, max_n, min_n FROM bs JOIN (SELECT unit, var_pop(rho) * count(*) AS sst, count(*) AS n_points, max(n_total) AS max_n, min(n_total) AS min_n FROM pt GROUP BY unit) USING (unit))"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    return _reliability(spark, d).where("gene_mode = 'all_genes'").select("unit", (2 * F.col("n")).alias("n_total"), F.col("sb_from_median").alias("rho"))


@query(f"WITH {POINTS} SELECT unit::BIGINT AS unit, {r6('tau_sq', 'fit_r2')}, n_points, max_n::BIGINT AS max_n, min_n::BIGINT AS min_n FROM ft")
def saturation_fit(spark, d):
    return rounded(N.fit_on_grid(_points(spark, d), ["unit"]))


_RHO = "(p.n * exp({0}) / (p.n * exp({0}) + 1))"
_AT = f"({float(np.log(N.LOW))!r}::DOUBLE + ({{0}}) * {float((np.log(N.HIGH) - np.log(N.LOW)) / (N.BRACKET - 1))!r}::DOUBLE)"


def _over(f: str) -> str:
    return f"list_sum(list_transform(p_, lambda p: {f}))"


@query(f"""WITH RECURSIVE {POINTS}, pa AS (SELECT unit, list({{'n': n_total::DOUBLE, 'y': rho}} ORDER BY n_total, rho) AS p_, count(*) AS n_points, max(n_total)::DOUBLE AS max_n, min(n_total)::DOUBLE AS min_n FROM pt GROUP BY unit),
kb AS (SELECT unit, arg_min(k, (e, k)) AS best FROM (SELECT unit, k, {_over(f"(p.y - {_RHO.format('t')}) * (p.y - {_RHO.format('t')})")} AS e FROM (SELECT *, {_AT.format('k')} AS t FROM pa, range({N.BRACKET}) r(k))) GROUP BY unit),
hv AS (SELECT unit, 0 AS step, {_AT.format('greatest(best - 1, 0)')} AS a, {_AT.format(f'least(best + 1, {N.BRACKET - 1})')} AS b, p_ FROM kb JOIN pa USING (unit)
  UNION ALL SELECT unit, step + 1, CASE WHEN up THEN m ELSE a END, CASE WHEN up THEN b ELSE m END, p_ FROM (
    SELECT *, {_over(f"(p.y - {_RHO.format('m')}) * {_RHO.format('m')} * (1 - {_RHO.format('m')})")} > 0 AS up FROM (SELECT *, (a + b) / 2 AS m FROM hv WHERE step < {N.HALVINGS}))),
ts AS (SELECT pa.*, exp((a + b) / 2) AS tau_sq, {_over('p.n').replace('p_', 'pa.p_')} AS total FROM hv JOIN pa USING (unit) WHERE step = {N.HALVINGS}),
tm AS (SELECT *, {_over('p.y')} / n_points AS mu, {_over('p.n * p.y')} / total AS wmu FROM ts),
er AS (SELECT *, {_over('(p.y - p.n * tau_sq / (p.n * tau_sq + 1)) ** 2')} AS e, {_over('p.n * (p.y - p.n * tau_sq / (p.n * tau_sq + 1)) ** 2')} AS we, {_over('(p.y - mu) ** 2')} AS tot, {_over('p.n * (p.y - wmu) ** 2')} AS wtot FROM tm)
SELECT unit::BIGINT AS unit, {r6('tau_sq', 'CASE WHEN tot > 0 THEN 1 - e / tot ELSE 0 END AS fit_r2', 'CASE WHEN wtot > 0 THEN 1 - we / wtot ELSE 0 END AS fit_r2_weighted')}, n_points, max_n, min_n,
  {', '.join(f"round({q} / (tau_sq * (1 - {q}::DOUBLE)), 6) + 0.0 AS n_star_{int(q * 100)}" for q in (0.5, 0.7, 0.9))} FROM er""")
def saturation_fit_numeric(spark, d):
    return rounded(N.fit(_points(spark, d), ["unit"]))


@query(f"""WITH {POINTS} SELECT unit::BIGINT AS unit, {r6('tau_sq', 'n_cells * tau_sq / (n_cells * tau_sq + 1) AS rho_pred')}, n_cells,
  n_cells >= 0.5 / (tau_sq * 0.5) AS powered_50, n_cells >= 0.7 / (tau_sq * (1 - 0.7::DOUBLE)) AS powered_70, n_cells >= 0.9 / (tau_sq * (1 - 0.9::DOUBLE)) AS powered_90
FROM ft JOIN (SELECT unit, count(*) AS n_cells FROM units GROUP BY unit) USING (unit)""")
def power_flags(spark, d):
    n = X.cell_units(spark, d).groupBy("unit").agg(F.count("*").alias("n_cells"))
    return rounded(N.power_flags(N.fit_on_grid(_points(spark, d), ["unit"]).select("unit", "tau_sq").join(n, "unit"), "n_cells"))


@query(f"""WITH {POINTS}, gr AS (SELECT unit, p AS pilot_n, n_total, rho FROM pt, (VALUES ({'), ('.join(map(str, PILOTS))})) t(p) WHERE n_total <= p),
ok AS (SELECT gr.unit, pilot_n FROM gr JOIN (SELECT unit, count(*) AS n_all FROM pt GROUP BY unit) a ON gr.unit = a.unit GROUP BY gr.unit, pilot_n HAVING count(DISTINCT n_total) >= 2 AND count(*) < max(n_all)),
s2 AS (SELECT gr.unit, pilot_n, k, max(tau_sq) AS tau_sq, sum((rho - n_total * tau_sq / (n_total * tau_sq + 1)) ** 2) AS sse FROM gr JOIN ok USING (unit, pilot_n), gk GROUP BY gr.unit, pilot_n, k),
b2 AS (SELECT unit, pilot_n, tau_sq FROM (SELECT *, row_number() OVER (PARTITION BY unit, pilot_n ORDER BY round(sse, 12), k) AS rn FROM s2) WHERE rn = 1)
SELECT unit::BIGINT AS unit, pilot_n::BIGINT AS pilot_n, {r6('ft.tau_sq AS tau_full', 'b2.tau_sq AS tau_pilot')} FROM b2 JOIN ft USING (unit)""")
def pilot_simulation(spark, d):
    p = _points(spark, d)
    full = N.fit_on_grid(p, ["unit"]).select("unit", F.col("tau_sq").alias("tau_full"))
    part = N.fit_on_grid(N.pilot_points(p, ["unit"], PILOTS), ["unit", "pilot_n"]).select("unit", "pilot_n", F.col("tau_sq").alias("tau_pilot"))
    return rounded(part.join(full, "unit"))


@query(f"""WITH {SCORES}, t AS (SELECT unit, dataset, avg(score) AS v FROM sc GROUP BY ALL), p AS (SELECT unit, avg(v) AS m, var_pop(v) AS s, count(*) AS k FROM t GROUP BY unit HAVING count(*) > 1)
SELECT {r6('var_pop(m) AS var_between', 'avg(s) AS var_within', 'var_pop(m) / nullif(var_pop(m) + avg(s), 0) AS icc')}, count(*) AS n_units FROM p""")
def transfer_icc(spark, d):
    t = X.scores(spark, d).groupBy("unit", "dataset").agg(F.avg("score").alias("v"))
    return rounded(I.icc(t, "unit", "v"))


@query(f"""WITH {SCORES}, t AS (SELECT unit, dataset, avg(score2) AS v FROM sc GROUP BY ALL)
SELECT a.dataset AS d1, b.dataset AS d2, count(*) AS n, {r6('avg(abs(a.v - b.v)) AS mean_gap', 'avg((a.v / b.v BETWEEN 0.5 AND 2)::INT) AS within_2x')} FROM t a JOIN t b ON a.unit = b.unit AND a.dataset < b.dataset GROUP BY ALL""")
def transfer_pairs(spark, d):
    t = X.scores(spark, d).groupBy("unit", "dataset").agg(F.avg("score2").alias("v"))
    a, b = t.select("unit", F.col("dataset").alias("d1"), F.col("v").alias("x")), t.select("unit", F.col("dataset").alias("d2"), F.col("v").alias("y"))
    j = a.join(b, "unit").where("d1 < d2")
    return rounded(j.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_gap"), F.avg(I.within_two_fold(F.col("x"), F.col("y")).cast("int")).alias("within_2x")))


# --- enrichment ----------------------------------------------------------------------------------

SETS = "gs AS (SELECT 'T' || k AS term, g FROM (SELECT unnest(range(0, 16)) AS k), (SELECT unnest(range(0, 64)) AS g) WHERE (g * (k + 3) + k) % 8 = 0)"
RANKED = f"""{AXIS}, dj AS (SELECT unit, g, delta, avg_delta, sum(delta * avg_delta) OVER (PARTITION BY unit) / sum(avg_delta * avg_delta) OVER (PARTITION BY unit) AS k FROM delta JOIN axis USING (g)),
rs AS (SELECT unit, g, round(delta - k * avg_delta, 9) AS residual FROM dj), {SETS},
rb AS (SELECT unit, side, g, v FROM (SELECT unit, 'specific' AS side, g, residual AS v FROM rs UNION ALL SELECT 0, 'shared', g, round(avg_delta, 9) FROM axis))"""


def _es(rows: str, order: str, keys: str) -> str:
    return f"""(SELECT {keys}, term, CASE WHEN round(max(run), 9) >= round(-min(run), 9) THEN max(run) ELSE min(run) END AS es, max(nh) AS nh FROM (
    SELECT *, sum(CASE WHEN hit THEN coalesce(abs(v) / nullif(nr, 0), 0) ELSE coalesce(-1.0::DOUBLE / nullif(n - nh, 0), 0) END) OVER (PARTITION BY {keys}, term ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, count(*) OVER w AS n, sum(hit::INT) OVER w AS nh, sum(CASE WHEN hit THEN abs(v) ELSE 0 END) OVER w AS nr FROM (
        SELECT r.*, t.term, gs.g IS NOT NULL AS hit FROM {rows} r CROSS JOIN (SELECT term FROM gs GROUP BY term HAVING count(*) BETWEEN 5 AND 500) t LEFT JOIN gs ON gs.term = t.term AND gs.g = r.g) WINDOW w AS (PARTITION BY {keys}, term))) GROUP BY {keys}, term)"""


ENRICH = f"""{RANKED},
es AS {_es('rb', 'v DESC, g', 'unit, side')},
pm AS (SELECT unit, side, perm, g, row_number() OVER (PARTITION BY unit, side, perm ORDER BY md5('gsea:' || perm || ':' || g), g) AS place FROM rb, (SELECT unnest(range(1, {PERMS + 1})) AS perm)),
po AS (SELECT unit, side, v, row_number() OVER (PARTITION BY unit, side ORDER BY v DESC, g) AS place FROM rb),
nb AS (SELECT pm.unit, pm.side, perm, g, v, pm.place FROM pm JOIN po ON pm.unit = po.unit AND pm.side = po.side AND pm.place = po.place),
e0 AS {_es('nb', 'place', 'unit, side, perm')},
mk AS (SELECT *, es >= 0 AS up, round(abs(es), 9) AS a FROM (SELECT unit, side, term, es, nh, 1 AS own FROM es UNION ALL SELECT unit, side, term, es, nh, 0 FROM e0)),
sp AS (SELECT *, avg(abs(es)) FILTER (own = 0) OVER (PARTITION BY unit, side, term, up) AS scale, sum(1 - own) OVER (PARTITION BY unit, side, term, up) AS same,
  sum(1 - own) OVER (PARTITION BY unit, side, term, up ORDER BY a DESC) AS more FROM mk),
sr AS (SELECT *, es / nullif(scale, 0) AS nes, round(abs(es / nullif(scale, 0)), 9) AS x FROM sp),
en AS (SELECT unit, side, term, es, nes, nh AS set_size, (more + 1) / (same + 1) AS p, CASE WHEN nes IS NULL THEN 1.0 ELSE least(1, coalesce(f, 1.0)) END AS fdr FROM (
  SELECT *, (sum(1 - own) OVER q / sum(1 - own) OVER (PARTITION BY unit, side, up)) / nullif(sum(own) OVER q / sum(own) OVER (PARTITION BY unit, side, up), 0) AS f
  FROM sr WINDOW q AS (PARTITION BY unit, side, up ORDER BY x DESC NULLS LAST)) WHERE own = 1)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    c, good = X.cells_planted(spark, d), _rho(spark, d).where("rho >= 0.5")
    axis = R.shared_axis(c, good)
    own = R.residuals(R.deltas(c), axis).select("unit", F.lit("specific").alias("side"), "g", F.round("residual", 9).alias("v"))
    return own.unionByName(axis.select(F.lit(0).alias("unit"), F.lit("shared").alias("side"), "g", F.round("avg_delta", 9).alias("v")))


@query(f"WITH {RANKED} SELECT unit::BIGINT AS unit, side, g, round(v, 6) + 0.0 AS v FROM rb")
def shared_and_residual_axes(spark, d):
    return rounded(_ranked(spark, d))


@query(f"WITH {ENRICH} SELECT unit::BIGINT AS unit, side, term, {r6('es', 'nes', 'p', 'fdr')}, set_size::BIGINT AS set_size FROM en")
def shared_vs_residual_enrichment(spark, d):
    return rounded(G.enrich(_ranked(spark, d), X.gene_sets(spark), ["unit", "side"], "v", PERMS, genes=LEAST_GENES))


@query()
def fast_enrichment(spark, d):
    """The same rankings with the parametric null of large term libraries (300 draws)."""
    return rounded(GF.fast_enrich(_ranked(spark, d), X.gene_sets(spark), ["unit", "side"], "v", genes=LEAST_GENES))


#: The same with terms that hold what was planted in the cells.
PLANTED = ENRICH.replace(SETS, SETS[:-1] + """ UNION ALL SELECT 'P', g FROM (SELECT unnest(range(0, 64)) AS g) WHERE (5 * g) % 7 >= 5 UNION ALL SELECT 'Q' || (g % 11), g FROM (SELECT unnest(range(0, 64)) AS g))""")


def _planted(spark: SparkSession, d: str) -> DataFrame:
    return G.enrich(_ranked(spark, d), X.planted_sets(spark), ["unit", "side"], "v", PERMS, genes=LEAST_GENES)


@query(f"""WITH {PLANTED}, s AS (SELECT * FROM en WHERE fdr < {FDR})
SELECT term, count(DISTINCT unit) FILTER (side = 'shared') AS n_shared, count(DISTINCT unit) FILTER (side = 'specific') AS n_specific, count(DISTINCT unit) FILTER (side = 'specific') > 0 AND count(DISTINCT unit) FILTER (side = 'shared') = 0 AS specific_only FROM s GROUP BY term""")
def program_sets(spark, d):
    return rounded(G.programs(_planted(spark, d), "side", FDR))


@query(f"""WITH {PLANTED}, n AS (SELECT term, count(DISTINCT unit) FILTER (side = 'specific') AS n_units, bool_or(side = 'shared') AS shared FROM en WHERE fdr < {FDR} GROUP BY term),
c AS (SELECT * FROM n WHERE n_units > 0 ORDER BY n_units DESC, term LIMIT 300)
SELECT term, n_units, row_number() OVER (ORDER BY n_units DESC, term) AS place FROM c WHERE NOT shared ORDER BY n_units DESC, term LIMIT 11""")
def specific_terms(spark, d):
    """Of the 300 commonest terms of the residuals the first 11 that the shared axis lacks."""
    return rounded(P.specific_terms(_planted(spark, d), "side", FDR))


@query(f"""WITH {PLANTED}, qr AS (SELECT unit % 3 AS context, count(*) AS n_reliable FROM good GROUP BY ALL HAVING count(*) >= 2),
qt AS (SELECT unit % 3 AS context, count(DISTINCT term) AS n_terms FROM en WHERE side = 'specific' AND fdr < {FDR} GROUP BY ALL)
SELECT context::BIGINT AS context, n_reliable, n_terms FROM qr JOIN qt USING (context)""")
def qualifying_contexts(spark, d):
    """Contexts are residues of the unit, two units in place of ten, as the table has nine."""
    context = (F.col("unit") % 3).alias("context")
    found = _planted(spark, d).where("side = 'specific'").select(context, "term", "fdr")
    return rounded(G.qualifying(_rho(spark, d).where("rho >= 0.5").select(context, "unit"), found, ["context"], 2, FDR))


@query(f"""WITH {SCORES}, swap AS (SELECT dataset, unit, min(cls) AS cls FROM uc WHERE rho >= 0.8 GROUP BY ALL)
SELECT dataset, unit, coalesce(swap.cls, CASE WHEN m.rho >= 0.5 THEN 'Shared' ELSE 'Unreliable' END) AS cls FROM uc m LEFT JOIN swap USING (dataset, unit)""")
def label_swap(spark, d):
    u = _units(spark, d)
    mine = u.select("dataset", "unit", F.when(F.col("rho") >= 0.5, "Shared").otherwise("Unreliable").alias("cls"))
    return B.relabel(mine, u.where("rho >= 0.8"), ["dataset", "unit"], "cls")


@query("""SELECT lang, arg_min(source, list_position(['absent', 'src0', 'src1', 'src2'], source)) AS source FROM (SELECT DISTINCT lang, source FROM documents WHERE source IN ('absent', 'src0', 'src1', 'src2')) GROUP BY lang""")
def control_label_choice(spark, d):
    """The first candidate, of which the first is in no table, that each group has."""
    return K.control_label(IO.table(spark, d, "documents"), ["absent", "src0", "src1", "src2"], ["lang"], "source")


# --- reports and sources -------------------------------------------------------------------------


@query("SELECT least(floor((l_discount - 0) * 20 / 0.1::DOUBLE), 19)::BIGINT AS bin, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0 AND 0.1::DOUBLE GROUP BY ALL")
def hist_bins(spark, d):
    x = IO.table(spark, d, "lineitem").select(S.hist_bin("l_discount", 0.0, 0.1, 20).alias("bin"))
    return x.where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))


#: 61 edges that widen to the right, of prices; and 66 of equal width.
VARIABLE, FIXED = [float(round(900 * 1.08**k)) for k in range(61)], [float(1000 * k) for k in range(66)]


def _edges_sql(name: str, edges: list[float]) -> str:
    e = f"[{', '.join(map(str, edges))}]"
    return f"""SELECT '{name}' AS edges, least(len(list_filter(e, lambda x: x <= v)), {len(edges) - 1}) - 1 AS bin, count(*) AS n
  FROM (SELECT o_totalprice::DOUBLE AS v, {e}::DOUBLE[] AS e FROM orders) WHERE v BETWEEN {edges[0]} AND {edges[-1]} GROUP BY ALL"""


@query(f"{_edges_sql('variable', VARIABLE)} UNION ALL {_edges_sql('fixed', FIXED)}")
def edge_bins(spark, d):
    """Histograms over given edges, the last bin closed on the right."""
    o = IO.table(spark, d, "orders").select(F.col("o_totalprice").cast("double").alias("v"))
    both = F.explode(F.array(*[F.struct(F.lit(name).alias("edges"), S.edge_bin("v", e).alias("bin")) for name, e in (("variable", VARIABLE), ("fixed", FIXED))])).alias("b")
    return o.select(both).select("b.*").where("bin is not null").groupBy("edges", "bin").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT label AS unit, count(*) AS n FROM embeddings GROUP BY label)
SELECT CASE WHEN n BETWEEN 0 AND 50 THEN '0-50' WHEN n <= 100 THEN '50-100' WHEN n <= 200 THEN '100-200' ELSE '>200' END AS bin, count(*) AS n_units, sum(n)::BIGINT AS n_cells FROM c GROUP BY ALL""")
def count_bins(spark, d):
    c = X.cell_units(spark, d).groupBy("unit").agg(F.count("*").alias("n"))
    return c.groupBy(S.labelled_bin("n", [0, 50, 100, 200]).alias("bin")).agg(F.count("*").alias("n_units"), F.sum("n").alias("n_cells"))


@query("""WITH e AS (SELECT event_id, event_type, user_id, value FROM events), nw AS (SELECT event_type, user_id, max(value) AS value FROM e WHERE event_type IN (SELECT min(event_type) FROM e) GROUP BY ALL),
b AS (SELECT event_type, user_id, min(value) AS value FROM e GROUP BY ALL)
SELECT event_type, user_id, value FROM b WHERE event_type NOT IN (SELECT event_type FROM nw) UNION ALL SELECT * FROM nw""")
def json_upsert(spark, d):
    e = IO.table(spark, d, "events")
    first = e.agg(F.min("event_type").alias("event_type"))
    new = e.join(F.broadcast(first), "event_type", "left_semi").groupBy("event_type", "user_id").agg(F.max("value").alias("value"))
    base = e.groupBy("event_type", "user_id").agg(F.min("value").alias("value"))
    return IO.upsert(base, new, ["event_type"]).select("event_type", "user_id", "value")


@query("""SELECT p.key AS key, count(*) AS n, count(DISTINCT p.value) AS n_distinct FROM (SELECT unnest(map_entries(from_json(props, '"MAP(VARCHAR, VARCHAR)"'))) AS p FROM events) GROUP BY ALL""")
def json_keys(spark, d):
    p = IO.table(spark, d, "events").select(F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return p.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_distinct"))


@query("""SELECT name, n_rows, n_null, n_distinct FROM (
  SELECT 'r_regionkey' AS name, count(*) AS n_rows, count(*) - count(r_regionkey) AS n_null, count(DISTINCT r_regionkey) AS n_distinct FROM region
  UNION ALL SELECT 'r_name', count(*), count(*) - count(r_name), count(DISTINCT r_name) FROM region)""")
def describe_source(spark, d):
    return IO.describe_source(IO.table(spark, d, "region").select("r_regionkey", "r_name")).select("name", "n_rows", "n_null", "n_distinct")


_LABEL = "CASE WHEN doc_id % 4 = 0 THEN 'control' WHEN doc_id % 4 = 1 THEN 'A' || doc_id || '+control' WHEN doc_id % 4 = 2 THEN 'B' || doc_id || ' + A' || doc_id ELSE 'pat-X.' || doc_id || ' y+ctrl' END"


@query(f"""WITH l AS (SELECT doc_id, {_LABEL} AS label FROM documents), p AS (SELECT doc_id, label, [x FOR x IN [trim(y) FOR y IN string_split(label, '+')] IF x <> '' AND x <> 'control'] AS c FROM l)
SELECT doc_id, CASE len(c) WHEN 0 THEN 'control' WHEN 1 THEN 'single' ELSE 'double' END AS kind, array_to_string(list_sort(string_split(label, '+')), '+') AS pair, {_NORM.format('label')} AS norm,
  regexp_replace(label, '\\+ctrl$', '') AS bare, ('0x' || substr(sha256('s::' || label), 1, 8))::BIGINT AS seed FROM p""".replace("\\\\", "\\"))
def label_keys(spark, d):
    i = F.col("doc_id") % 4
    n = F.col("doc_id").cast("string")
    lab = F.when(i == 0, "control").when(i == 1, F.concat(F.lit("A"), n, F.lit("+control"))).when(i == 2, F.concat(F.lit("B"), n, F.lit(" + A"), n)).otherwise(F.concat(F.lit("pat-X."), n, F.lit(" y+ctrl")))
    t = IO.table(spark, d, "documents").select("doc_id", lab.alias("label"))
    return t.select("doc_id", K.label_type("label").alias("kind"), K.pair_key("label").alias("pair"), K.normalise("label").alias("norm"), K.strip_control("label").alias("bare"), K.seed32(F.lit("s"), "label").alias("seed"))
