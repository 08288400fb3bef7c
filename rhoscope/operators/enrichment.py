"""Preranked gene-set enrichment with a permutation null, as windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sampling import repeats


def rankable(df: DataFrame, by: list[str], value: str, genes: int = 200, spread: float = 1e-12, mode_share: float = 0.5) -> DataFrame:
    """Rows of groups whose ranking means something: enough genes, some spread, no dominant value."""
    w = Window.partitionBy(*by)
    out = df.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy(*by, value)))
    out = out.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("s", F.stddev_samp(value).over(w)).withColumn("top", F.max("same").over(w))
    return out.where((F.col("n") >= genes) & (F.col("s") >= spread) & (F.col("top") / F.col("n") <= mode_share)).select(*df.columns)


def running_score(ranked: DataFrame, sets: DataFrame, by: list[str], value: str, order: list) -> DataFrame:
    """Largest deviation of the weighted hit minus miss sum, for each group and term.

    ``ranked``: by, g, value.  ``sets``: term, g.  The sum has its extremes right
    at or right before a hit, so genes are joined to the sets by equality and only
    hits become rows; terms without a gene in the ranking have none.
    """
    w = Window.partitionBy(*by)
    placed = ranked.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("pos", F.row_number().over(w.orderBy(*order)))
    hits = placed.join(sets.select("term", F.col("g").cast("int").alias("g")).distinct(), "g").withColumn("v", F.abs(value))
    keys = [*by, "term"]
    w = Window.partitionBy(*keys)
    upto = w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("size", F.count(F.lit(1)).over(w)).withColumn("all", F.sum("v").over(w)).withColumn("so_far", F.sum("v").over(upto)).withColumn("k", F.row_number().over(w.orderBy("pos")))
    share = lambda a, b: F.coalesce(F.try_divide(a, F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0))
    missed = share(F.col("pos") - F.col("k"), F.col("n") - F.col("size"))
    after, before = share(F.col("so_far"), F.col("all")) - missed, share(F.col("so_far") - F.col("v"), F.col("all")) - missed
    end = share(F.col("all"), F.col("all")) - share(F.col("n") - F.col("size"), F.col("n") - F.col("size"))
    top, low = F.max(F.greatest(after, end)), F.min(F.least(before, end))
    return hits.groupBy(*keys).agg(F.when(F.round(top, 9) >= F.round(-low, 9), top).otherwise(low).alias("es"), F.max("size").alias("set_size"))


def enrich(ranked: DataFrame, sets: DataFrame, by: list[str], value: str, permutations: int, smallest: int = 5, largest: int = 500, salt: str = "gsea", genes: int = 200) -> DataFrame:
    """ES, NES, p and FDR of each group and term; groups whose ranking means
    nothing (:func:`rankable`) have none.

    Null: genes in MD5 order, values kept in rank order.  NES is the score over
    the mean null score of the same term and sign; p counts null scores of that
    sign at least as extreme; FDR is the share of null NES of the group at least
    as extreme, over the same share of the group's own NES, sign by sign.
    """
    size = sets.groupBy("term").agg(F.countDistinct("g").alias("k")).where(F.col("k").between(smallest, largest))
    sets = sets.join(size.select("term"), "term", "left_semi")
    ranked = rankable(ranked, by, value, genes)
    real = running_score(ranked, sets, by, value, [F.desc(value), F.col("g")])
    placed = ranked.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), F.col("g"))))
    shuffled = repeats(placed.select(*by, "g"), permutations, "perm")
    w_perm = Window.partitionBy(*by, "perm").orderBy(F.md5(F.concat_ws(":", F.lit(salt), "perm", "g")), F.col("g"))
    null = shuffled.withColumn("place", F.row_number().over(w_perm)).join(placed.select(*by, "place", value), [*by, "place"])
    null = running_score(null, sets, [*by, "perm"], value, [F.col("place")])

    # Scores of both kinds in one table: the nulls of a term and sign scale them, and rank them.
    marked = real.select(*by, "term", "es", "set_size", F.lit(1).alias("own")).unionByName(null.select(*by, "term", "es", "set_size", F.lit(0).alias("own")))
    marked = marked.withColumn("up", F.col("es") >= 0).withColumn("a", F.round(F.abs("es"), 9))
    side = Window.partitionBy(*by, "term", "up")
    at_least = lambda c: side.orderBy(F.desc(c))
    marked = marked.withColumn("scale", F.avg(F.when(F.col("own") == 0, F.abs("es"))).over(side)).withColumn("same", F.sum(1 - F.col("own")).over(side)).withColumn("more", F.sum(1 - F.col("own")).over(at_least("a")))
    marked = marked.withColumn("nes", F.try_divide(F.col("es"), F.nullif("scale", F.lit(0.0)))).withColumn("x", F.round(F.abs("nes"), 9))
    group = Window.partitionBy(*by, "up")
    share = lambda c: F.sum(c).over(group.orderBy(F.desc_nulls_last("x"))) / F.sum(c).over(group)
    marked = marked.withColumn("fdr", F.least(F.lit(1.0), F.try_divide(share(1 - F.col("own")), share(F.col("own")))))
    fdr = F.coalesce(F.when(F.col("nes").isNotNull(), F.col("fdr")), F.lit(1.0)).alias("fdr")
    return marked.where("own = 1").select(*by, "term", "es", "nes", ((F.col("more") + 1) / (F.col("same") + 1)).alias("p"), fdr, "set_size")


def qualifying(reliable: DataFrame, result: DataFrame, by: list[str], units: int = 10, fdr: float = 0.05) -> DataFrame:
    """Contexts with at least ``units`` reliable units and one significant term:
    ``by``, ``n_reliable``, ``n_terms``."""
    n = reliable.groupBy(*by).agg(F.count("*").alias("n_reliable")).where(F.col("n_reliable") >= units)
    terms = result.where(F.col("fdr") < fdr).groupBy(*by).agg(F.countDistinct("term").alias("n_terms"))
    return n.join(terms, by)


def programs(result: DataFrame, side: str, fdr: float = 0.05) -> DataFrame:
    """Terms significant on each side with the number of units, and whether only there."""
    sig = result.where(F.col("fdr") < fdr)
    t = sig.groupBy("term").agg(F.countDistinct(F.when(F.col(side) == "shared", F.col("unit"))).alias("n_shared"), F.countDistinct(F.when(F.col(side) == "specific", F.col("unit"))).alias("n_specific"))
    return t.withColumn("specific_only", (F.col("n_specific") > 0) & (F.col("n_shared") == 0))


def symbols(genes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Genes with a known symbol; of several genes with one symbol the first stays."""
    j = genes.join(mapping, "gene_id")
    w = Window.partitionBy("symbol").orderBy("g")
    return j.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
