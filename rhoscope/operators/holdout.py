"""Held-out experiments: splits, training arms with a log of what was left out, scores.

One plan serves all jobs, a job being one (dataset, split): ``by`` are the
dataset's columns, ``keys`` those of a job, thresholds of a sweep included.
Only test units of a job are scored, and no test unit is in an arm.

Arms that are the same set of units are scored once, however many cells of a
sweep or draws of a subset lead to them (:func:`distinct_arms`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import stats as S
from .retrain import centroid_accuracy
from .sampling import repeats, split_test, subset
from .triage import label as triage_label

GENUINE = "Specific"
METRICS = {"pcc_top": True, "mse_top": False, "overlap_top": True, "centroid": True, "l2_expr": False, "pcc_expr": True, "r_raw": True, "l2": False, "pcc": True}
COUNTS = ["n_train", "n_test", "n_genuine_train", "n_genuine_test", "n_rest_train"]


def splits(units: DataFrame, by: list[str], seeds: int, share: float = 0.25) -> DataFrame:
    """``units`` (by, unit, label, kind) once for each ``split_seed`` 1..seeds, with
    ``split`` train or test, stratified by label and kind."""
    each = repeats(units, seeds, "split_seed")
    return split_test(each, [*by, "split_seed", "label", "kind"], [F.lit("split"), "split_seed", *by, "unit"], "unit", share)


def lattice(members: DataFrame, rhos: list[float], cosines: list[float]) -> DataFrame:
    """``members`` once for each pair of thresholds (``rho_min``, ``cos_min``), labelled
    anew from ``rho`` and ``cos_sim``; splits stay as they were."""
    cells = [F.struct(F.lit(r).alias("rho_min"), F.lit(c).alias("cos_min")) for r in rhos for c in cosines]
    grid = members.withColumn("cell_", F.explode(F.array(*cells))).select("*", "cell_.*").drop("cell_")
    return grid.withColumn("label", triage_label(F.col("rho"), F.col("cos_sim"), F.col("rho_min"), F.col("cos_min")))


def jobs(members: DataFrame, keys: list[str], least_train: int = 5, least_test: int = 5, least_rest: int = 5) -> DataFrame:
    """One row per job: counts, ``reason`` why it is left out, and ``rest_reason`` why
    its random arm of other units is; null where nothing is left out."""
    genuine, train = F.coalesce(F.col("label") == GENUINE, F.lit(False)), F.col("split") == "train"
    n = [F.count_if(c).alias(name) for name, c in zip(COUNTS, (train, ~train, train & genuine, ~train & genuine, train & ~genuine), strict=True)]
    spare = F.min(F.col("n_rest_train") - F.col("n_genuine_train")).alias("spare")  # of the scarcest kind
    out = members.groupBy(*keys, "kind").agg(*n).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS], spare)
    short = F.when(F.col("n_genuine_train") < least_train, f"genuine_train_below_{least_train}").when(F.col("n_genuine_test") < least_test, f"genuine_test_below_{least_test}")
    rest = F.when(F.col("n_rest_train") < least_rest, f"rest_train_below_{least_rest}").when(F.col("spare") < 0, "rest_kinds_too_few")
    return out.select(*keys, *COUNTS, short.alias("reason"), rest.alias("rest_reason"))


def skipped(job: DataFrame, keys: list[str]) -> DataFrame:
    """The log: (keys, arm, reason, counts) of whole jobs (arm null) and of single arms."""
    whole = F.when(F.col("reason").isNotNull(), F.struct(F.lit(None).cast("string").alias("arm"), F.col("reason").alias("reason")))
    one = F.when(F.col("reason").isNull() & F.col("rest_reason").isNotNull(), F.struct(F.lit("random_rest").alias("arm"), F.col("rest_reason").alias("reason")))
    return job.select(*keys, *COUNTS, F.explode(F.array_compact(F.array(whole, one))).alias("s")).select(*keys, "s.arm", "s.reason", *COUNTS)


def training_arms(members: DataFrame, job: DataFrame, keys: list[str], draws: int) -> DataFrame:
    """(keys, arm, subset, unit): all, the genuine ones, and ``draws`` random subsets with
    as many units of each kind, from all training units and from the other ones."""
    run = job.where("reason is null").select(*keys, "rest_reason")
    train = members.where("split = 'train'").join(run, keys)
    genuine = F.coalesce(F.col("label") == GENUINE, F.lit(False))
    need = train.where(genuine).groupBy(*keys, "kind").agg(F.count("*").alias("need"))
    named = lambda df, arm: df.select(*keys, F.lit(arm).alias("arm"), F.lit(0).alias("subset"), "unit")

    def drawn(pool: DataFrame, arm: str) -> DataFrame:
        rows = repeats(pool.join(need, [*keys, "kind"]), draws, "subset")
        rows = subset(rows, [*keys, "subset", "kind"], [F.lit(arm), "split_seed", "subset", "unit"], "unit", F.col("need"))
        return rows.select(*keys, F.lit(arm).alias("arm"), "subset", "unit")

    out = named(train, "all").unionByName(named(train.where(genuine), "genuine")).unionByName(drawn(train, "random_matched"))
    return out.unionByName(drawn(train.where(~genuine & F.col("rest_reason").isNull()), "random_rest"))


def distinct_arms(arms: DataFrame, base: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sets of units (``base``, ``set``, unit), and which arm is which set: (keys, arm,
    subset, ``set``, ``n_train``).  ``base``: the columns of a job without thresholds."""
    each = arms.groupBy(*keys, "arm", "subset").agg(F.array_sort(F.collect_list("unit")).alias("units"))
    each = each.withColumn("set", F.md5(F.array_join("units", ","))).where(F.size("units") >= 2)
    sets = each.select(*base, "set", "units").dropDuplicates([*base, "set"])
    return sets.select(*base, "set", F.explode("units").alias("unit")), each.select(*keys, "arm", "subset", "set", F.size("units").alias("n_train"))


def truth(deltas: DataFrame, t: DataFrame, control: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, unit, g): ``delta``, whether the gene is among the unit's ``k`` largest |t|
    (``top_t``) and the ``k`` most expressed of the control (``top_e``), its mean ``m0``."""
    first = lambda df, w: df.withColumn("rk_", F.row_number().over(w)).withColumn("hit_", F.col("rk_") <= k).drop("rk_")
    top = first(t, Window.partitionBy(*by, "unit").orderBy(F.desc(F.abs("t")), "g")).select(*by, "unit", "g", F.col("hit_").alias("top_t"))
    shown = first(control, Window.partitionBy(*by).orderBy(F.desc("m"), "g")).select(*by, "g", F.col("m").alias("m0"), F.col("hit_").alias("top_e"))
    return deltas.select(*by, "unit", "g", "delta").join(top, [*by, "unit", "g"]).join(shown, [*by, "g"])


def _largest(pred: DataFrame, of: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*of).orderBy(F.desc(F.abs("pred")), "g")
    return pred.withColumn("top_p", F.row_number().over(w) <= k)


def _metrics(rows: DataFrame, of: list[str]) -> DataFrame:
    """All metrics but the centroid accuracy; constant vectors have no correlation."""
    within = lambda hit, c: c if hit is None else F.when(F.col(hit), c)
    e = F.col("pred") - F.col("delta")

    def r(hit: str | None, a: Column, b: Column) -> Column:
        a, b = within(hit, a), within(hit, b)
        return F.when((F.stddev_pop(a) >= 1e-12) & (F.stddev_pop(b) >= 1e-12), S.pearson_or_null(a, b))

    pred, delta, m0 = F.col("pred"), F.col("delta"), F.col("m0")
    both, n = F.sum((F.col("top_p") & F.col("top_t")).cast("int")), F.least(F.sum(F.col("top_p").cast("int")), F.sum(F.col("top_t").cast("int")))
    return rows.groupBy(*of).agg(
        r("top_t", pred, delta).alias("pcc_top"), F.avg(within("top_t", e * e)).alias("mse_top"), F.when(n >= 2, both / n).alias("overlap_top"),
        F.sqrt(F.sum(within("top_e", e * e))).alias("l2_expr"), r("top_e", pred, delta).alias("pcc_expr"), r("top_e", m0 + pred, m0 + delta).alias("r_raw"),
        F.sqrt(F.sum(e * e)).alias("l2"), r(None, pred, delta).alias("pcc"),
    )


def mean_scores(sets: DataFrame, tests: DataFrame, facts: DataFrame, by: list[str], base: list[str], k: int) -> DataFrame:
    """The mean of each set's deltas against every test unit of its job.

    ``tests``: base, unit.  ``facts``: :func:`truth`.
    """
    pred = sets.join(facts.select(*by, "unit", "g", "delta"), [*by, "unit"]).groupBy(*base, "set", "g").agg(F.avg("delta").alias("pred"))
    pred = _largest(pred, [*base, "set"], k)
    rows = pred.join(tests.join(facts, [*by, "unit"]), [*base, "g"])
    out = _metrics(rows, [*base, "set", "unit"])
    # One prediction for all units: those farther from it than the own truth are those ranked before it.
    w = Window.partitionBy(*base, "set")
    n = F.count(F.lit(1)).over(w)
    return out.withColumn("centroid", F.when(n > 1, (F.rank().over(w.orderBy(F.desc("l2"))) - 1) / (n - 1)))


def additive_scores(sets: DataFrame, tests: DataFrame, facts: DataFrame, names: DataFrame, by: list[str], base: list[str], k: int) -> DataFrame:
    """The sum of single deltas against every test combination whose components are all
    in the set as single units.  ``names``: by, unit, name."""
    parts = K.components("name")
    singles = names.where(F.size(parts) == 1).select(*by, "unit", parts[0].alias("part"))
    combos = tests.join(names.where(F.size(parts) > 1), [*by, "unit"]).select(*base, F.col("unit").alias("combo"), F.explode(parts).alias("part"), F.size(parts).alias("need"))
    found = sets.join(singles, [*by, "unit"]).join(combos, [*base, "part"])
    whole = found.groupBy(*base, "set", "combo", "need").agg(F.collect_list("unit").alias("units")).where(F.size("units") == F.col("need"))
    parts_of = whole.select(*base, "set", "combo", F.explode("units").alias("unit"))
    pred = parts_of.join(facts.select(*by, "unit", "g", "delta"), [*by, "unit"]).groupBy(*base, "set", F.col("combo").alias("unit"), "g").agg(F.sum("delta").alias("pred"))
    out = _metrics(_largest(pred, [*base, "set", "unit"], k).join(facts, [*by, "unit", "g"]), [*base, "set", "unit"])
    own = whole.select(*base, "set", F.col("combo").alias("unit")).join(facts.select(*by, "unit", "g", "delta"), [*by, "unit"])
    near = centroid_accuracy(pred, own, [*base, "set"]).withColumnRenamed("accuracy", "centroid")
    return out.join(near, [*base, "set", "unit"])


def scores(arm_of: DataFrame, by_set: dict[str, DataFrame], tests: DataFrame, base: list[str], keys: list[str], metrics: list[str]) -> DataFrame:
    """Scores of the arms: (model, keys, arm, subset, unit, label, kind, n_train, metrics).

    ``by_set``: model -> scores of the distinct sets.  ``tests``: keys, unit, label, kind.
    """
    every = None
    for model, s in by_set.items():
        one = s.select(F.lit(model).alias("model"), *base, "set", "unit", *metrics)
        every = one if every is None else every.unionByName(one)
    rows = arm_of.join(every, [*base, "set"]).drop("set")
    return rows.join(tests, [*keys, "unit"]).select("model", *keys, "arm", "subset", "unit", "label", "kind", "n_train", *metrics)
