"""Scans and sinks: Parquet, CSV, JSON; provenance, missing inputs, upserts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, index_column: bool = False, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header.  ``index_column`` drops an unnamed first column;
    latin-1 files take ``encoding='ISO-8859-1'``."""
    reader = spark.read.option("header", True).option("encoding", encoding)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return df.drop(df.columns[0]) if index_column else df


def read_stems(spark: SparkSession, pattern: str, schema: StructType | str | None = None, skip: str = "(summary|metadata)") -> DataFrame:
    """Union of all CSV files of a glob with the file's stem as ``dataset``; a folder
    ``stem.csv`` of parts, as Spark writes it, is one file."""
    df = read_csv(spark, pattern, schema)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv(?:/part-[^/]+)?$", 1)
    return df.select("*", stem.alias("dataset")).where(~F.col("dataset").rlike(skip))


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob names at least one file or folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_or(spark: SparkSession, path: str, fmt: str = "parquet", on_missing: str = "error", schema: StructType | str | None = None) -> DataFrame | None:
    """A missing input is an error, or None with ``on_missing='skip'``; an input that
    is there but can't be read is an error always."""
    if on_missing == "skip" and not exists(spark, path):
        return None
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def union_present(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> DataFrame | None:
    """Union by name of those inputs that are there; null for columns one lacks."""
    found = [df for p in paths if (df := read_or(spark, p, fmt, "skip")) is not None]
    out = None
    for df in found:
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def describe_source(df: DataFrame, show: int = 30) -> DataFrame:
    """Per column: type, rows, nulls, distinct values and the first ones of them."""
    kinds = dict(df.dtypes)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(kinds[c]).alias("type"), F.col(c).cast("string").alias("value")) for c in df.columns])).alias("v")).select("v.*")
    counted = long.groupBy("name", "type", "value").agg(F.count("*").alias("n"))
    totals = counted.groupBy("name", "type").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.count("value").alias("n_distinct"),
    )
    # A limit on the row number is applied in each task before the exchange: what meets in one task is bounded.
    w = Window.partitionBy("name").orderBy("value")
    first = counted.where("value is not null").select("name", "value").withColumn("k", F.row_number().over(w)).where(F.col("k") <= show)
    shown = first.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("sample"))
    return totals.join(shown, "name", "left").withColumn("sample", F.coalesce("sample", F.lit("")))


def write_csv(df: DataFrame, path: str, decimals: int | None = None, encoding: str = "UTF-8") -> None:
    """CSV with a header; ``decimals``: fractions are written with so many digits."""
    if decimals is not None:
        shown = lambda c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals}f", F.col(c).cast("double"))).alias(c)
        df = df.select(*[shown(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    df.write.mode("overwrite").option("header", True).option("encoding", encoding).csv(path)


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines; with ``by`` one nested document for each key: the key's columns
    and, under ``rows``, an array of the other columns."""
    if by:
        rest = [c for c in df.columns if c not in by]
        df = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("rows"))
    df.write.mode("overwrite").json(path)


def upsert(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``base`` whose key ``new`` does not have, and all of ``new``."""
    return base.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def build_if_missing(spark: SparkSession, path: str, build) -> DataFrame:
    """Read a Parquet stage; make it first if it is not there."""
    df = read_or(spark, path, on_missing="skip")
    if df is None:
        build().write.mode("overwrite").parquet(path)
        df = spark.read.parquet(path)
    return df


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``); in
    local mode, where that is unset, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rhoscope-")
    return f"{base}/rhoscope-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute now what several branches of a plan read: checkpointed in the session's
    shared folder where it has one, else kept (and computed again where lost)."""
    sc = df.sparkSession.sparkContext
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named:
            return df.persist()
        sc.setCheckpointDir(named)
    return df.checkpoint()
