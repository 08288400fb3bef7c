"""Mixing sources to target weights by systematic sampling.

Every source is to give ``target`` words: its weight's share of all words, but
at most ``most`` times its own; what is over is shared among the others by
weight until none is above.  The expected copies of a document are its source's
``target / source_size``.  Documents of a source are put in order of size, the
expected copies are summed up along that order, one random offset is added, and
a document is emitted once for each integer that its part of the sum crosses.

As the order is by size, the words taken differ from the target by no more than
the source's longest document, whatever the offset.  Where a source has few
documents that is still much, so ``draws`` offsets are drawn and the one kept
whose words come nearest to the target (with ``draws=1`` it is the plain scheme,
every document having exactly its expected copies on average; more draws favour
documents that fit).  Offsets are hashes of the seed, the draw and the source,
and the place in the order is that of (size, id, tie), so reruns agree and
nothing depends on partitions.  Places come from global row numbers
(:func:`shards.row_numbers`): a source that holds a third of all rows is dealt
over as many ranges as any other rows.

Defined results: a null text has size 0; a null source is a source of its own,
the last one; sources without words have target 0 and give nothing, documents
of size 0 may be emitted (at no words); rows with equal id and size are ordered
by the tie, equal ones are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh
from .shards import row_numbers

WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weight: Column, most: int = 3) -> DataFrame:
    """``sources`` (with long ``source_size``) and ``target`` double.

    ``weight``: positive integers.  Each round fixes the sources whose share of
    what is left would be above their limit, then shares again; one round is one
    aggregate, and the rounds end when none is fixed.
    """
    limit = F.col("source_size") * most
    table = cut(sources.withColumn("weight", weight.cast("long")))
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    left, weights = total, table.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    while True:
        # share above the limit, without division: left * weight / weights > limit
        above = (F.lit(left).cast("decimal(19,0)") * F.col("weight").cast("decimal(18,0)")) > (limit.cast("decimal(19,0)") * F.lit(weights).cast("decimal(18,0)"))
        fixed, heavy = table.where(above).agg(F.coalesce(F.sum(limit), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if total - fixed == left or not weights:
            break
        left, weights = total - fixed, table.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0] - heavy
    share = (F.lit(left) * F.col("weight")).cast("double") / F.lit(max(weights, 1)).cast("double")
    return table.withColumn("target", F.when(above, limit.cast("double")).otherwise(share)).drop("weight")


def offset(source: Column, seed: int, draw: int) -> Column:
    """In [0, 1), from the first 32 bits of an MD5; null and text never meet."""
    name = F.concat(F.lit(f"{seed}:{draw}:"), F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def mix(df: DataFrame, source: str = "source", size: str = "size", id_col: str = "doc_id", tie: Column | None = None, weights: Sequence[int] = WEIGHTS, most: int = 3, seed: int = 12, draws: int = 16) -> DataFrame:
    """``df`` with ``source_size`` long, ``target`` double and ``copies`` int.

    Sources in code point order, null last, have ``weights`` in turn.  Every
    column of ``df`` is moved with its row once: leave long texts out.
    """
    df = df.drop("source_size", "target", "copies")
    spot, number, first, rank = (fresh(df, c) for c in ("spot", "number", "first_number", "rank"))
    least = F.lit(0) if tie is None else tie
    order = F.struct(F.col(source).isNull(), F.col(source))
    placed = df.withColumn(spot, F.struct(order.alias("source"), F.col(size).alias("size"), F.col(id_col).alias("id"), least.alias("tie")))
    constant = fresh(placed, "constant")
    numbered, _ = row_numbers(placed.withColumn(constant, F.lit(0)), spot, constant, number)
    numbered = numbered.drop(constant, spot)
    sizes = numbered.groupBy(source).agg(F.sum(size).cast("long").alias("source_size"), F.min(number).alias(first))
    ranked, _ = row_numbers(cut(sizes), first, "source_size", rank)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col(rank) % len(weights) + 1).cast("int"))
    table = targets(ranked.select(F.col(source).alias("of"), "source_size", F.col(first), F.col(rank)), weight, most).drop(rank)
    table = cut(table.withColumn("offsets", F.array(*[offset(F.col("of"), seed, k) for k in range(draws)])))
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    whole, place = F.floor(rate), (F.col(number) - F.col(first)).cast("double")

    def copies(at: Column) -> Column:
        crossed = lambda k: F.floor(k * (rate - whole) + at)
        return whole + F.least(crossed(place + 1) - crossed(place), F.lit(1))

    joined = numbered.join(table, F.col(source).eqNullSafe(F.col("of")))
    taken = joined.groupBy("of").agg(F.first("target").alias("target"), F.first("offsets").alias("offsets"), F.array(*[F.sum(F.col(size) * copies(F.col("offsets")[k])) for k in range(draws)]).alias("taken"))
    off = F.transform("taken", lambda t, k: F.struct(F.abs(t - F.col("target")).alias("by"), k.alias("k")))
    kept = taken.select("of", F.col("offsets")[F.array_min(off)["k"]].alias("at"))
    chosen = table.drop("offsets").join(kept.withColumnRenamed("of", "of_"), F.col("of").eqNullSafe(F.col("of_"))).drop("of_")
    out = numbered.join(chosen, F.col(source).eqNullSafe(F.col("of")))
    return out.withColumn("copies", copies(F.col("at")).cast("int")).drop(number, first, "of", "at")


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it was drawn, with ``copy`` from 0."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
