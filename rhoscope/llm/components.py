"""Connected components by alternating large and small stars (public method of
Kiveris et al., 2014), as DataFrame joins and aggregates.

Each round rewires every edge to a smaller node; a hub's edges are spread by the
join, never gathered.  Lineage is cut after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) for every node of an edge,
    as a table of :func:`cut`.

    Self loops, nulls and repeated edges are ignored; no edges give no rows.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()  # u > v
    now = cut(now)
    before = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(low.select("u", F.col("m").alias("v")))
        last, now = now, cut(small.distinct())
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    out = cut(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
    discard(now)
    return out
