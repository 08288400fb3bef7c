"""Sizes at which earlier versions lost rows, refused or grew with the square."""

from __future__ import annotations

import random
import time
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rhoscope.llm import bpe, chat, common, decontam, langid, quality
from rhoscope.llm.common import hash_below


def test_shares_do_not_vanish(spark):
    """A language of 10^9 documents and more is still sampled, at its share."""
    df = spark.range(200_000).select(F.xxhash64("id").alias("h"), F.when(F.col("id") % 2 == 0, "big").otherwise("small").alias("lang"))
    for n in (10**9, 10**12):
        hit = df.where(langid.sampled(F.col("h"), F.col("lang"), {"big": n, "small": 100_000}, n // 1000)).groupBy("lang").count().collect()
        counts = {r[0]: r[1] for r in hit}
        assert 50 < counts["big"] < 160 and counts["small"] == 100_000
    # A share far below one millionth is a threshold of its own, neither none nor all.
    edge = spark.createDataFrame([(-(2**63),), (-(2**63) + 2**20,), (-(2**63) + 2**44,), (0,), (2**63 - 1,)], "h long")
    assert [r[0] for r in edge.select(hash_below(F.col("h"), 1e-12)).collect()] == [True, True, False, False, False]
    assert edge.where(hash_below(F.col("h"), 1.0)).count() == 5 == edge.where(hash_below(F.col("h"), 7.0)).count()


def test_large_benchmark_and_null_item_ids(spark):
    """Items beyond ``most_bytes`` go to several automata, with the same result."""
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(90)}" for _ in range(n))
    items = [(None if k % 9 == 0 else f"q{k}", say(rng.choice([0, 3, 13, 40]))) for k in range(60)]
    docs = [(k, f"{say(40)} Été {items[k % 60][1].upper()}. {say(20)} {items[(k + 7) % 60][1]}") for k in range(50)] + [(77, None), (78, "")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    show = lambda df: sorted(map(repr, df.select("doc_id", "n_words", "hits", "items").collect()))
    one = decontam.scan_benchmark(d, i)
    assert show(one) == show(decontam.scan_benchmark(d, i, most_bytes=700))
    found = {r["doc_id"]: r for r in one.collect()}
    assert any(None in r["items"] for r in found.values()) and not any("None" in r["items"] for r in found.values())
    for r in found.values():
        named = [x for x in r["items"] if x is not None]
        assert r["items"] == sorted(named) + [None] * (None in r["items"])
        for h in r["hits"]:  # offsets of the original text
            assert decontam.words_of(r["text"][h["start"] : h["end"]]) == decontam.words_of(r["text"])[h["first_word"] : h["end_word"]]


@pytest.mark.parametrize("turns", [30_000])
def test_very_long_conversation(spark, turns):
    """Tens of thousands of turns in one conversation, in time that grows with the turns."""
    rng = random.Random(4)
    said = [(7, k, rng.choice(["user", "assistant"]), f"turn {k} [INST] é{'x' * rng.randrange(40)} \U0001f600") for k in range(turns)]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    began = time.time()
    out = chat.read_back(chat.format_conversations(df)).withColumn("loss", chat.loss_text()).first()
    assert time.time() - began < 60
    assert [(t["role"], t["text"]) for t in out["turns"]] == [(r, t) for _, _, r, t in said]
    assert out["loss"] == "".join(t for _, _, r, t in said if r == "assistant")


def test_stages_keep_columns_named_like_theirs(spark, tmp_path, monkeypatch):
    """A caller's ``kept``, ``n_words``, ``hits`` and so on come out as they went in."""
    names = ["kept", "tail_prob", "expected_grade", "n_words", "hits", "items", "n_hit"]
    rows = [(k, f"good words {k} " * 9, *[f"{c}{k}" for c in names]) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    spark.createDataFrame([("q", "nothing of this")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    monkeypatch.setattr(corpus_pipeline, "quality_model", lambda *_: quality.OrdinalModel(quality.np.zeros(quality.BUCKETS, "f4"), quality.np.array([-9.0, -5.0])))
    for stage in (corpus_pipeline.quality_classifier, corpus_pipeline.decontaminate):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == rows


def test_workers_forget_other_operators():
    """A reused worker keeps an operator's caches for its own next task only."""
    made = []

    @common.forgettable
    @lru_cache(maxsize=1)
    def costly():
        made.append(1)
        return 1

    for module in ("one", "one", "two"):
        common.tenant(module)
        costly()
    assert len(made) == 2
    assert bpe.encoder in common._CACHES and bpe.vocabulary in common._CACHES
    common._CACHES.remove(costly)


def test_index_entries_of_four_bytes():
    """What a bucket receives of a subset is four bytes of its hash."""
    import numpy as np

    from rhoscope.llm import jaccard

    h = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 400).astype(np.uint64))
    rows = list(jaccard._packed([(7, h)], 0, 2, frozenset()))
    assert rows and all(len(sigs) == 4 * np.frombuffer(counts, "<u4").sum() for _, _, _, counts, sigs in rows)


def test_index_counts_of_a_byte():
    """A record's number of entries in a bucket travels as a byte, also where it has more than 255."""
    import numpy as np

    from rhoscope.llm import jaccard

    h = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 3000).astype(np.uint64))
    for row in jaccard._packed([(7, h), (9, h[:40])], 0, 1, frozenset()):
        _, _, rids, counts, sigs = row
        _, _, narrow_rids, each, same = jaccard._narrow(row)
        want = np.repeat(np.frombuffer(rids, "<i8"), np.frombuffer(counts, "<u4"))
        assert same == sigs and len(each) == len(narrow_rids) // 8
        assert np.array_equal(np.repeat(np.frombuffer(narrow_rids, "<i8"), np.frombuffer(each, np.uint8)), want)
