"""The registered permutations and cut find a planted term and leave the others out."""

from __future__ import annotations

from rhoscope.operators import enrichment as G
from rhoscope.plans import catalog


def test_planted_term_is_significant(spark):
    ranked = spark.createDataFrame([(1, "specific", g, (32 - g) / 10) for g in range(64)], "unit int, side string, g int, v double")
    terms = {"top": range(8), **{f"T{k}": range(k, 64, 8) for k in range(7)}}
    sets = spark.createDataFrame([(t, g) for t, gs in terms.items() for g in gs], "term string, g int")
    got = {r["term"]: r for r in G.enrich(ranked, sets, ["unit", "side"], "v", catalog.PERMS, genes=catalog.LEAST_GENES).collect()}
    assert got["top"]["fdr"] < catalog.FDR <= 0.05
    assert all(got[t]["fdr"] >= catalog.FDR for t in terms if t != "top")
    found = G.programs(G.enrich(ranked, sets, ["unit", "side"], "v", catalog.PERMS, genes=catalog.LEAST_GENES), "side", catalog.FDR).collect()
    assert [(r["term"], r["n_specific"], r["specific_only"]) for r in found] == [("top", 1, True)]
