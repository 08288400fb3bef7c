"""op5 gives one row for each input row, also where ids repeat or are missing."""

from __future__ import annotations

import hashlib
import re

from rhoscope.llm.queries import op5_exact_dedup

ROWS = [(1, "a  b"), (1, "c"), (1, "a b"), (None, "a\tb"), (None, "alone"), (2, "c"), (3, None), (4, ""), (5, "only here")]


def test_repeated_and_null_ids(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    want = []
    for i, t in ROWS:
        ids = [j for j, u in ROWS if norm(u) == norm(t)]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), None if i is None else i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = op5_exact_dedup(spark, str(tmp_path)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
