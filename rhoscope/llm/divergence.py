"""Divergence between the sources of a language, exact in integers.

Within each language, terms that occur in at least ``least_docs`` of its
documents are kept: V terms.  A group (language, source) gives each of them
``p = 1 + floor(scale * (count + 1) / (N + V))``; the divergence of p from q is
``f = floor((p - q) * (p - q) / q)``, summed over all V terms for a pair of groups.

A baseline-correction inverted index: almost all counts are zero, so the sum of
a pair starts at V times f of two zero counts.  A term in one group only
corrects it by an amount that depends on the count alone; these are added up
from each group's histogram of counts.  Only terms that both groups have are met
in the postings, once for each unordered pair of a term's groups, and only
corrections other than zero go on to the sum.  So the work grows with the
postings of shared terms, not with V times the pairs.

Counting is done where the texts lie, in bounded dictionaries; what moves are
partial counts of terms, dealt out by (language, term).  A posting list has a
row for each source at most, whatever the share of one source.  Ranks of terms
are windows over rows that Spark has cut down to the first ``top`` of each group
in every partition before the shuffle.

Defined results: null text, language and source count as empty strings, each a
value like others; texts without terms still make their group; V = 0 gives pairs
of value 0 and no terms; one source gives no pairs; an empty table gives no rows;
ties of value are ordered by item; repeated rows are documents; other columns
are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

SCALE = 1_000_000_000
#: Entries of one task's dictionaries; they are emptied into rows beyond it.
HELD = 300_000
#: ASCII letters in lower case, other ASCII as blanks, all bytes from 0x80 on as they are.
_TERM_BYTES = bytes(c | 32 if chr(c).isascii() and chr(c).isalpha() else c if c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters A-Z, a-z and non-ASCII characters, A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts: lang, source, term, count, docs; a null term names a group."""
    counts: dict[tuple[bytes, bytes], Counter] = {}
    docs: dict[tuple[bytes, bytes], Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for key, of in counts.items():
            lang, source = (k.decode() for k in key)
            terms, n, per = list(of), list(of.values()), docs[key]
            for i in range(0, len(terms) + 1, 50_000):
                part = terms[i : i + 50_000]
                found = [per[t] for t in part]
                if i == 0:
                    part, found = [None, *part], [0, *found]
                k = len(part)
                held = n[i : i + 50_000] if i else [0, *n[:50_000]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * k), pa.array([source] * k), pa.array(part, pa.binary()).cast(pa.string()), pa.array(held, pa.int64()), pa.array(found, pa.int64())], names=["lang", "source", "term", "n", "docs"]
                )

    size = 0
    for batch in batches:
        lang, source, text = ([v or b"" for v in c.cast(pa.binary()).to_pylist()] for c in batch.columns)
        for key, words in zip(zip(lang, source, strict=True), map(terms_of, text), strict=True):
            if key not in counts:
                counts[key], docs[key] = Counter(), Counter()
            before = len(counts[key])
            counts[key].update(words)
            docs[key].update(set(words))
            size += len(counts[key]) - before + 1
            if size > HELD:
                yield from rows()
                counts, docs, size = {}, {}, 0
    yield from rows()


def probability(count: Column, total: Column, vocabulary: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + vocabulary))``, exact beyond 64 bits."""
    wide = (count + 1).cast("decimal(18,0)") * F.lit(SCALE).cast("decimal(10,0)")
    narrow = (count + 1) * SCALE
    over = total + vocabulary
    fits = count < (1 << 62) // SCALE
    return 1 + F.when(fits, _div(F.when(fits, narrow).otherwise(0), over)).otherwise(_div(wide, over.cast("decimal(19,0)")))


def _div(a: Column, b: Column) -> Column:
    """Integral division of columns that are not negative."""
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def postings(docs: DataFrame, least_docs: int = 3, lang: str = "lang", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, source, term, n, lang_n, lead: the term's first row) and
    the groups (lang, source), both written out."""
    small_batches(docs.sparkSession)
    texts = docs.select(*[F.col(c).cast("string").alias(k) for k, c in (("lang", lang), ("source", source), ("text", text))])
    partial = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counts = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    first = F.row_number().over(of_term.orderBy("source")) == 1
    marked = counts.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("in_docs"), F.sum("n").over(of_term).alias("lang_n"), first.alias("lead"))
    table = cut(marked.where((F.col("in_docs") >= least_docs) | F.col("term").isNull()).drop("in_docs"))
    return table.where("term is not null"), table.where("term is null").select("lang", "source")


def audit_sources(docs: DataFrame, least_docs: int = 3, top: int = 200, **columns: str) -> DataFrame:
    """Rows (lang, source, part, item, value, rank), see the module."""
    post, groups = postings(docs, least_docs, **columns)
    zero = F.lit(0).cast("long")
    kept = post.groupBy("lang").agg(F.sum(F.col("lead").cast("long")).alias("v"), F.sum("n").alias("lang_total"))
    totals = post.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    fill = lambda c: F.coalesce(c, zero).alias(c)
    groups = groups.join(totals, ["lang", "source"], "left").join(kept, "lang", "left").select("lang", "source", fill("total"), fill("v"), fill("lang_total"))
    some = F.when(F.col("v") > 0, probability(zero, F.col("total"), F.col("v"))).otherwise(1)
    groups = cut(groups.withColumn("p0", some))
    known = cut(post.join(groups, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("total"), F.col("v"))))

    # Pairs: the baseline and what the histograms of counts add to it.
    a, b = (groups.select("lang", F.col("source").alias(f"{k}_source"), F.col("p0").alias(f"{k}_p0"), "v") for k in "ab")
    pairs = a.join(b.drop("v"), "lang").where("a_source != b_source")
    base = pairs.select("lang", "a_source", "b_source", (F.col("v") * divergence(F.col("a_p0"), F.col("b_p0"))).alias("value"))
    alike = cut(known.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms")))
    other = groups.select("lang", F.col("source").alias("b_source"), F.col("p0").alias("b_p0"))
    met = alike.withColumnRenamed("source", "a_source").join(other, "lang").where("a_source != b_source")
    zeros = lambda p, q: divergence(F.col(p), F.col(q))
    forth = met.select("lang", "a_source", "b_source", (F.col("terms") * (zeros("p", "b_p0") - zeros("p0", "b_p0"))).alias("value"))
    back = met.select("lang", F.col("b_source").alias("a_source"), F.col("a_source").alias("b_source"), (F.col("terms") * (zeros("b_p0", "p") - zeros("b_p0", "p0"))).alias("value"))

    # Terms that both groups have, each unordered pair once.
    x, y = (known.select("lang", "term", F.col("source").alias(f"{k}_source"), F.col("p").alias(f"{k}_p"), F.col("p0").alias(f"{k}_p0")) for k in "xy")
    both = x.join(y, ["lang", "term"]).where("x_source < y_source")
    correct = lambda g, h: zeros(f"{g}_p", f"{h}_p") - zeros(f"{g}_p", f"{h}_p0") - zeros(f"{g}_p0", f"{h}_p") + zeros(f"{g}_p0", f"{h}_p0")
    both = both.select("lang", "x_source", "y_source", correct("x", "y").alias("xy"), correct("y", "x").alias("yx")).where("xy != 0 or yx != 0")
    both = both.groupBy("lang", "x_source", "y_source").agg(F.sum("xy").alias("xy"), F.sum("yx").alias("yx"))
    ways = F.array(F.struct(F.col("x_source").alias("a"), F.col("y_source").alias("b"), F.col("xy").alias("value")), F.struct(F.col("y_source").alias("a"), F.col("x_source").alias("b"), F.col("yx").alias("value")))
    shared = both.select("lang", F.explode(ways).alias("w")).select("lang", F.col("w.a").alias("a_source"), F.col("w.b").alias("b_source"), F.col("w.value").alias("value"))
    value = base.unionByName(forth).unionByName(back).unionByName(shared).groupBy("lang", "a_source", "b_source").agg(F.sum("value").alias("value"))
    pair = value.select("lang", F.col("a_source").alias("source"), F.lit("pair").alias("part"), F.col("b_source").alias("item"), "value")

    whole = probability(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    term = known.withColumn("q", whole).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(ranks))
    return ranked(pair).unionByName(ranked(term).where(F.col("rank") <= top))
