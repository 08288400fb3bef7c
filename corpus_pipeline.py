"""Cleaning a corpus in stages, each one operator of ``rhoscope.llm``.

Every stage gets the rows its predecessor kept and returns the columns of
``documents``; the last one returns token ids per document.  :func:`run` writes
each stage as Parquet in the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhoscope.llm import bpe, decontam, exact_dedup, jaccard, quality
from rhoscope.llm.common import cut, read
from rhoscope.llm.queries import contaminated, quality_model, tokenizer_path


def filtered(docs: DataFrame, step: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of ``docs`` that ``keep`` leaves of ``step(docs)``, with their own
    columns: those but for id and text have other names meanwhile, so that none of
    them meets a column that the step makes."""
    away = {c: c if c in ("doc_id", "text") else f"document_{k}_" for k, c in enumerate(docs.columns)}
    out = keep(step(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in away.items()])))
    return out.select(*[F.col(a).alias(c) for c, a in away.items()])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being good and clean is too small go."""
    model = quality_model(spark, sf_dir)
    return filtered(docs, lambda d: quality.classify(d, model), lambda d: d.where("kept"))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.keep_first(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.75 or more, the smallest doc_id stays."""
    return jaccard.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    items = read(spark, sf_dir, "benchmark")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end_word"] - h["first_word"])
    return filtered(docs, lambda d: decontam.scan_benchmark(d, items).withColumn("n_hit", n_hit), lambda d: d.where(~contaminated()))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left."""
    out = bpe.encode_documents(docs, tokenizer_path())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", dedup_exact),
    ("n-gram Jaccard join", dedup_near),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding", encode),
]

#: The classifier is trained, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
