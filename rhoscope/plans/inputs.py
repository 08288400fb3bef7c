"""Queries over sources and sinks, dictionary and scope functions, and the tables that
report on units without a result; each with its SQL.

The ones on files write what they read in the session's shared folder first."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..operators import enrichment as G
from ..operators import reliability as R
from ..sources import fixtures as X
from ..sources import readers as IO
from .catalog import _WIDE, GRID, REL, REPS, SCORES, TOPK, _scored, query, r6, rounded


@query("SELECT s_suppkey, s_name || 'é' AS s_name, round(s_acctbal, 1) + 0.0 AS s_acctbal FROM supplier")
def csv_round_trip(spark, d):
    """Fractions with one digit, Latin-1, an index column that is dropped on reading."""
    path = IO.scratch(spark)
    t = IO.table(spark, d, "supplier").select(F.monotonically_increasing_id().alias("index"), "s_suppkey", F.concat("s_name", F.lit("é")).alias("s_name"), F.col("s_acctbal").cast("double").alias("s_acctbal"))
    IO.write_csv(t, path, decimals=1, encoding="ISO-8859-1")
    return rounded(IO.read_csv(spark, path, "index long, s_suppkey long, s_name string, s_acctbal double", index_column=True, encoding="ISO-8859-1"))


@query("SELECT c_nationkey::BIGINT AS c_nationkey, count(*) AS n, min(c_custkey) AS first_key, max(c_custkey) AS last_key FROM customer GROUP BY c_nationkey")
def json_documents(spark, d):
    """One nested document a nation, written and read again."""
    path = IO.scratch(spark)
    IO.write_json(IO.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("c_nationkey"), F.col("c_custkey").cast("long").alias("c_custkey")), path, by=["c_nationkey"])
    t = spark.read.schema("c_nationkey long, rows array<struct<c_custkey:long>>").json(path)
    keys = F.col("rows.c_custkey")
    return t.select("c_nationkey", F.size("rows").cast("long").alias("n"), F.array_min(keys).alias("first_key"), F.array_max(keys).alias("last_key"))


@query("""SELECT n_nationkey::BIGINT AS k, n_name AS name, NULL::BIGINT AS nation FROM nation
UNION ALL SELECT s_suppkey::BIGINT, s_name, s_nationkey::BIGINT FROM supplier""")
def combined_inputs(spark, d):
    """Stages built if missing, twice; a union over those that are there and a column that one lacks."""
    path = IO.scratch(spark)
    n = IO.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    s = IO.table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("long").alias("nation"))
    for name, df in (("a", n), ("b", s), ("a", s)):  # the last one is there already and is not built again
        IO.build_if_missing(spark, f"{path}/{name}", lambda df=df: df)
    return IO.union_present(spark, [f"{path}/{x}" for x in ("a", "missing", "b")])


_DESCRIBED = ["doc_id", "lang", "n_chars", "source", "text"]


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS name, (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) - count({c}) FROM documents) AS n_null, count(*) AS n_distinct, md5(string_agg(v, ',' ORDER BY v) FILTER (k <= 30)) AS sample "
    f"FROM (SELECT v, row_number() OVER (ORDER BY v) AS k FROM (SELECT DISTINCT {c}::VARCHAR AS v FROM documents WHERE {c} IS NOT NULL))" for c in _DESCRIBED))  # fmt: skip
def describe_documents(spark, d):
    """Every column of the documents, whole: rows, nulls, distinct values and (hashed) the 30 smallest."""
    out = IO.describe_source(IO.table(spark, d, "documents").select(*_DESCRIBED))
    return out.select("name", "n_rows", "n_null", "n_distinct", F.md5("sample").alias("sample"))


@query(r"""SELECT p_partkey::BIGINT AS p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'eleven' WHEN 'Brand#22' THEN 'twenty-two' ELSE p_brand END AS brand,
  CASE p_brand WHEN 'Brand#11' THEN 'eleven' WHEN 'Brand#22' THEN 'twenty-two' END AS known,
  CASE WHEN p_partkey % 3 = 0 THEN 'chemical' ELSE p_brand END AS scope, p_partkey % 4 < 2 AS is_guide FROM part""")
def mapped_keys(spark, d):
    """Column fall-back, dictionary with and without default, scope by prefix, guide labels."""
    t = IO.table(spark, d, "part")
    brand = F.col(K.first_present(t, ["brand_name", "p_brand", "p_type"]))
    names = {"Brand#11": "eleven", "Brand#22": "twenty-two"}
    k = F.col("p_partkey")
    dataset = F.when(k % 3 == 0, F.concat(F.lit("SciPlex"), k.cast("string"))).otherwise("other")
    guide = F.when(k % 4 == 0, F.concat(F.lit("NegCtrl"), k.cast("string"))).when(k % 4 == 1, "GENE1_posA").otherwise("GENE1")
    return t.select(k.cast("long").alias("p_partkey"), K.vocabulary(brand, names, "same").alias("brand"), K.vocabulary(brand, names).alias("known"), K.scope(dataset, brand).alias("scope"), K.is_guide_label(guide).alias("is_guide"))


@query("""WITH m AS (SELECT DISTINCT p_size AS size, min(p_brand) AS symbol FROM part GROUP BY p_size)
SELECT symbol, min(p_partkey)::BIGINT AS g FROM part JOIN m ON p_size = size GROUP BY symbol""")
def gene_symbols(spark, d):
    """Ids mapped to symbols; of several with one symbol the first stays."""
    t = IO.table(spark, d, "part")
    mapping = t.groupBy(F.col("p_size").alias("gene_id")).agg(F.min("p_brand").alias("symbol"))
    return G.symbols(t.select(F.col("p_partkey").cast("long").alias("g"), F.col("p_size").alias("gene_id")), mapping).select("symbol", "g")


@query(f"WITH {SCORES} SELECT dataset, unit, " + ", ".join(f"round(avg(score) FILTER (method = 'm{k}'), 6) + 0.0 AS m{k}" for k in range(1, 8)) + " FROM sq GROUP BY ALL")
def unit_by_method(spark, d):
    """Mean score of each unit, a column for each method."""
    return rounded(_scored(spark, d).groupBy("dataset", "unit").pivot("method", [f"m{k}" for k in range(1, 8)]).agg(F.avg("score")))


@query(f"""WITH {SCORES}, me AS (SELECT dataset, method, quantile_cont(score, 0.5) AS median FROM sq GROUP BY ALL)
SELECT dataset, method, {r6('median')}, row_number() OVER (PARTITION BY dataset ORDER BY round(median, 9) DESC, method) AS place FROM me""")
def methods_by_median(spark, d):
    """Methods of each dataset in the order of their median score."""
    m = _scored(spark, d).groupBy("dataset", "method").agg(F.percentile("score", F.lit(0.5)).alias("median"))
    w = Window.partitionBy("dataset").orderBy(F.desc(F.round("median", 9)), "method")  # methods: few
    return rounded(m.withColumn("place", F.row_number().over(w).cast("long")))


_PART = "CASE WHEN vec_id % 10 = 0 THEN 1 ELSE 0 END"


@query(" UNION ALL ".join(
    f"""SELECT {k}::BIGINT AS context, q.* FROM (WITH {REL.replace('FROM embeddings', f'FROM (SELECT * FROM embeddings WHERE {_PART} = {k})')}, w AS (SELECT unit::BIGINT AS unit, {_WIDE} FROM rl GROUP BY unit)
SELECT z.unit::BIGINT AS unit, z.cells, coalesce((SELECT cells FROM sizes WHERE unit = 0), 0) AS ctrl_cells,
  CASE WHEN w.unit IS NOT NULL THEN 'OK' WHEN z.cells < 8 THEN 'ERROR: fewer than 8 cells' ELSE 'ERROR: fewer than 8 control cells' END AS status, w.median_r_all_genes
FROM sizes z LEFT JOIN w ON z.unit = w.unit WHERE z.unit <> 0) q""" for k in (0, 1)))  # fmt: skip
def reliability_status(spark, d):
    """Every unit of every context, also those without a result, with the reason."""
    part = F.when(F.col("cell") % 10 == 0, 1).otherwise(0).cast("long")
    c, u, by = X.cells_planted(spark, d).withColumn("context", part), X.cell_units(spark, d).withColumn("context", part), ["context"]
    wide = R.reliability_wide(R.reliability_long(R.split_half_r(c, u, REPS, GRID, TOPK, by=by), by), by=by)
    out = R.with_failures(wide, u, by=by)
    return rounded(out.select("context", "unit", "cells", "ctrl_cells", "status", "median_r_all_genes"))
