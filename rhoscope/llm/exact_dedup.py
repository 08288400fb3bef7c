"""Exact deduplication by progressive refinement, DataFrame functions only.

Rows are grouped by text length, then by the hash of a prefix, then by the full
hash.  A group of one is finished at the level where it becomes alone; only
rows whose (length, prefix hash) occurs again have their full text hashed.

The surviving keys travel back to the texts as a bitmap of constant size, so no
text is ever shuffled.  The bitmap may let rows through that need no full hash;
they end up in groups of one, so the result is exact.

Defined results: a null text counts as empty; equal ids and repeated rows are
separate rows of one group and share its result; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap_of, cut, flag_by_bitmap, text_key, without_rows

#: Characters of the normalised text that the prefix hash covers.
PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: str | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size`` and, as column
    ``digest``, the SHA-256 of the normalised text (which then is hashed in every row).

    ``keep_id`` is the smallest id among equal normalised texts.
    """
    out = _grouped(df, id_col, text_col, every=digest is not None)
    out = out.drop("key").withColumnRenamed("id", id_col)
    return out.withColumnRenamed("full", digest) if digest else out.drop("full")


def _grouped(df: DataFrame, id_col: str, text_col: str, every: bool = False) -> DataFrame:
    norm = normalised(F.col(text_col))
    # Level 1 and 2 in one narrow scan: length and prefix hash.
    sketch = df.select(F.octet_length(norm).alias("len"), F.xxhash64(F.substring(norm, 1, PREFIX_CHARS)).alias("pre"))
    by_prefix = sketch.groupBy("len", "pre").agg(F.count("*").alias("n"))
    by_length = by_prefix.groupBy("len").agg(F.sum("n").alias("n_len")).where("n_len > 1").select("len")
    again = by_prefix.where("n > 1").join(by_length, "len", "left_semi")
    key = F.xxhash64("len", "pre")
    bitmap = bitmap_of(again, key)
    # Level 3: the full hash, only where (length, prefix) may occur again.
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", "text", text_key(F.col("text")).alias("key"), F.octet_length(normalised(F.col("text"))).alias("len"), F.xxhash64(F.substring(normalised(F.col("text")), 1, PREFIX_CHARS)).alias("pre"))
    rows = flag_by_bitmap(rows, key, bitmap, "again")
    # Written out (ids and hashes, no texts): two readers follow, and the texts are read once for both.
    rows = cut(rows.select("id", "key", "again", "len", F.when(F.col("again") | F.lit(every), F.sha2(normalised(F.col("text")), 256)).alias("full")))
    alone = rows.where(~F.col("again")).select("id", "key", "full", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    alike = rows.where("again").select("id", "key", "len", "full")
    # Written out, so that the join is one of two plain shuffles, whose large partitions Spark can split.
    groups = cut(alike.groupBy("len", "full").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")))
    alike = alike.join(groups, ["len", "full"]).select("id", "key", "full", "keep_id", "group_size")
    return alone.unionByName(alike)


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the later copies: of equal texts the smallest id stays (rows
    that repeat it and rows without an id stay too)."""
    gone = _grouped(df, id_col, text_col).where(F.col("id") > F.col("keep_id"))
    return without_rows(df, gone.select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key")), id_col, text_col)
