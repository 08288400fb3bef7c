"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of one bitmap row (fixed by Spark's ``bitmap_construct_agg``).
BITMAP_ROW_BITS = 32768


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    while stem.lower() in {c.lower() for c in df.columns}:
        stem += "_"
    return stem


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or, in
    local mode only, one of our own where the session (a test) has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        jsc = spark.sparkContext._jsc.sc()
        found = jsc.getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rhoscope-checkpoint-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage: a lost executor makes Spark read files again, not recompute.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/rhoscope-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._cut_path = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete tables of :func:`cut` that nothing will read again."""
    for df in cuts:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let the driver notice which shuffles are done with: Spark deletes their
    files when their handles are collected, otherwise after half an hour."""
    gc.collect()
    spark._jvm.System.gc()


#: Caches of Python workers that :func:`tenant` empties, and the module that uses them now.
_CACHES: list = []
_tenant = ""


def forgettable(cached):
    """Register a function with ``cache_clear`` whose values may outlive a task, but
    not the operator that made them."""
    _CACHES.append(cached)
    return cached


def tenant(module: str) -> None:
    """Called in a Python worker when a task of an operator begins: Spark reuses
    workers, so what another operator remembered there goes."""
    global _tenant
    if module != _tenant:
        for c in _CACHES:
            c.cache_clear()
        _tenant = module
        tidy()


def tidy() -> None:
    """Give free memory of this worker back to the system: Arrow's pool and the C
    heap keep it otherwise, and many idle workers share an executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` between :func:`tenant` and :func:`tidy`, for ``mapInArrow`` and ``mapInPandas``."""
    module = run.__module__

    def around(batches: Iterator) -> Iterator:
        tenant(module)
        yield from run(batches)
        tidy()

    return around


_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
}


def arrow_type(kind: T.DataType) -> pa.DataType:
    """Arrow type of a result column."""
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in kind.fields])
    return _ARROW[kind.simpleString()]


def append_columns(df: DataFrame, inputs: list[str], start: Callable[[], Callable[..., list[list]]], extra: str, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``df`` (all by default) and the columns ``extra`` (DDL).

    ``start()`` is called once a task and gives a function of the lists of
    values of ``inputs`` (strings as UTF-8 bytes) to the lists of the new
    columns.  The kept columns stay Arrow arrays: nulls, long integers and types
    Python lacks come out as they went in.
    """
    made = T.StructType.fromDDL(extra)
    names = df.columns if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in names), *made.fields])
    reads, keeps = [df.columns.index(c) for c in inputs], [df.columns.index(c) for c in names]
    types, titles = [arrow_type(f.dataType) for f in made.fields], [*names, *made.names]
    text = [isinstance(df.schema[c].dataType, T.StringType) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tenant(start.__module__)
        f = start()
        for batch in batches:
            values = [(c.cast(pa.binary()) if t else c).to_pylist() for c, t in zip((batch.column(i) for i in reads), text, strict=True)]
            new = [pa.array(v, type=t) for v, t in zip(f(*values), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keeps), *new], names=titles)
        tidy()

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Bound the rows of an Arrow batch: texts are long, and a task of several
    Python steps holds a batch in each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def bitmap_of(df: DataFrame, key: Column, rows: int = 1024) -> DataFrame:
    """Bitmap of the hashes of ``key``: at most ``rows`` rows of 4 KB each.

    The size is a constant (4 MB by default), whatever the input, so it may be
    broadcast.  With more keys than bits it fills up and filters less; it never
    loses a key.
    """
    h = F.pmod(key, F.lit(rows * BITMAP_ROW_BITS))
    return (
        df.select(F.floor(h / BITMAP_ROW_BITS).cast("long").alias("bm_row"), (h % BITMAP_ROW_BITS).cast("long").alias("bm_bit"))
        .groupBy("bm_row")
        .agg(F.bitmap_construct_agg("bm_bit").alias("bm_bits"))
    )


def flag_by_bitmap(df: DataFrame, key: Column, bitmap: DataFrame, flag: str, rows: int = 1024) -> DataFrame:
    """Add boolean ``flag``: false only if ``key`` is surely not in ``bitmap``.

    A superset test without a shuffle of ``df``: the bitmap has a fixed size.
    """
    row, at, mask, bits = (fresh(df, c) for c in ("bm_row", "bm_at", "bm_mask", "bm_bits"))
    h = F.pmod(key, F.lit(rows * BITMAP_ROW_BITS))
    bit = (h % BITMAP_ROW_BITS).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.col(at) + 1, F.lit(1))), 16, 10).cast("int")
    return (
        df.withColumn(row, F.floor(h / BITMAP_ROW_BITS).cast("long"))
        .withColumn(at, F.floor(bit / 8).cast("int"))
        .withColumn(mask, F.pow(F.lit(2), bit % 8).cast("int"))
        .join(F.broadcast(bitmap.select(F.col("bm_row").alias(row), F.col("bm_bits").alias(bits))), row, "left")
        .withColumn(flag, F.coalesce(byte.bitwiseAND(F.col(mask)) != 0, F.lit(False)))
        .drop(row, at, mask, bits)
    )


def hash_below(h: Column, share: float) -> Column:
    """Whether a 64-bit hash lies in the first ``share`` of its range; fine enough for
    any number of rows that a table can have."""
    return h <= F.lit(min(2**63 - 1, -(2**63) + int(min(1.0, share) * 2**64)))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def without_rows(df: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` without the rows that ``gone`` names by ``gone_id`` and ``gone_key``
    (:func:`text_key`).  Only rows that a bitmap can't rule out are shuffled."""
    gone = cut(gone)
    flag = fresh(df, "maybe_gone")
    key = F.xxhash64(F.col(id_col), text_key(F.col(text_col)))
    marked = flag_by_bitmap(df, key, bitmap_of(gone, F.xxhash64("gone_id", "gone_key")), flag)
    doubtful = marked.where(flag).drop(flag)
    left = doubtful.join(gone, (doubtful[id_col] == gone["gone_id"]) & (text_key(doubtful[text_col]) == gone["gone_key"]), "left_anti")
    return marked.where(~F.col(flag)).drop(flag).unionByName(left)
