"""Views over the driver's tables that stand in for cell matrices and score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import table

GENES = 64
CONTROL = 0


def cells_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long cells: ``cell``, ``unit``, ``g``, ``x`` with a planted effect."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.col("label").alias("unit"), F.posexplode("embedding").alias("g", "x0"))
    shared = 0.01 * (F.col("unit") % 4) * (((5 * F.col("g")) % 7) - 3)
    own = 0.01 * (F.col("unit") % 3) * (((7 * F.col("unit") + 13 * F.col("g")) % 11) - 5)
    x = F.col("x0").cast("double") + F.when(F.col("unit") != CONTROL, shared + own).otherwise(0.0)
    return e.select("cell", "unit", "g", x.alias("x"))


#: Units of an experiment for each label of the table, the last of which is a combination.
PARTS = 5


def experiment_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets with ``PARTS`` units for each label: ``dataset``, ``cell``, ``unit``, ``g``, ``x``."""
    unit = F.when(F.col("unit") == CONTROL, CONTROL).otherwise(PARTS * F.col("unit") + F.expr(f"cell div 2 % {PARTS}"))
    return cells_planted(spark, sf_dir).select((F.col("cell") % 2).alias("dataset"), "cell", unit.cast("long").alias("unit"), "g", "x")


def experiment_name() -> Column:
    """What a unit perturbs: gene ``g<unit>``, a gene that the table lacks, or two genes."""
    label, k = F.floor(F.col("unit") / PARTS), F.col("unit") % PARTS
    name = lambda c, v: F.concat(F.lit(c), v.cast("string"))
    other = F.when(label % 3 == 0, name("x", label)).otherwise(name("g", PARTS * (label % 9 + 1) + 1))
    return F.when(k == 4, F.concat(name("g", PARTS * label), F.lit("+"), other)).when(k == 3, name("x", F.col("unit"))).otherwise(name("g", F.col("unit")))


def cell_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cell``, ``unit`` only: assignments are made on ids, not on vectors."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.col("label").alias("unit"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows: ``method``, ``dataset``, ``unit``, ``fold``, ``op``, ``score``, ``score2``."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_quantity")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("unit"))
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("dataset"))
    rows = line.join(part, "l_partkey").join(supp, "l_suppkey").join(nation, "n_nationkey").join(region, "r_regionkey")
    rows = rows.withColumn("method", F.concat(F.lit("m"), "l_linenumber")).withColumn("fold", F.col("l_suppkey") % 5)
    out = rows.groupBy("method", "dataset", "unit", "fold").agg(F.avg(1 - 10 * F.col("l_discount")).alias("score"), F.avg(F.col("l_quantity") / 50).alias("score2"))
    return out.withColumn("op", F.concat_ws("_", "unit", "fold"))


def unit_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``dataset``, ``unit``, ``rho``, ``cos`` (null where rho < 0.5)."""
    units = table(spark, sf_dir, "part").select(F.col("p_brand").alias("unit")).distinct()
    number = F.regexp_extract("unit", r"(\d+)$", 1).cast("long")
    rho = ((7 * number) % 11) / 10
    q = units.select("unit", rho.alias("rho"), F.when(rho >= 0.5, ((5 * number) % 9) / 8).alias("cos"))
    return table(spark, sf_dir, "region").select(F.col("r_name").alias("dataset")).crossJoin(F.broadcast(q))  # 5 x 25 rows


def gene_sets(spark: SparkSession) -> DataFrame:
    """16 synthetic terms over the genes: ``term``, ``g``."""
    t = spark.range(16).select(F.col("id").alias("k")).crossJoin(spark.range(GENES).select(F.col("id").cast("int").alias("g")))
    return t.where((F.col("g") * (F.col("k") + 3) + F.col("k")) % 8 == 0).select(F.concat(F.lit("T"), "k").alias("term"), "g")


def planted_sets(spark: SparkSession) -> DataFrame:
    """:func:`gene_sets`, a term of the genes that the shared effect raises, and terms of
    genes that one unit's own effect raises together."""
    genes = spark.range(GENES).select(F.col("id").cast("int").alias("g"))
    shared = genes.where((5 * F.col("g")) % 7 >= 5).select(F.lit("P").alias("term"), "g")
    own = genes.select(F.concat(F.lit("Q"), F.col("g") % 11).alias("term"), "g")
    return gene_sets(spark).unionByName(shared).unionByName(own)
