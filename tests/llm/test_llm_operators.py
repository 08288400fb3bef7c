"""Brute-force comparisons and edge cases of the training-data operators."""

from __future__ import annotations

import math
import random
import re
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rhoscope.llm import bpe, chat, components, decontam, exact_dedup, jaccard, langid, licenses, quality, shards, suffixes
from rhoscope.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, n_words long, hits int, score string, kept int, r int, k1 int, bucket int, spans int, id int, tie int"


def frame(spark, rows):
    """Rows (doc_id, text) with further columns whose names operators use too."""
    return spark.createDataFrame([(i, t, 0, 1, "x", 2, 3, 4, 5, 6, 7, 8) for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, long, blank and null texts, repeated rows."""
    rng = random.Random(4)
    passage = words(rng, 80)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "two three"), (5, "one"), (6, "ab " * 400), (7, "x" * 3000)]
    base = words(rng, 150).split()
    for k in range(6):  # near copies that differ in a few words
        near = list(base)
        for _ in range(k):
            near[rng.randrange(len(near))] = f"z{k}"
        rows.append((10 + k, " ".join(near)))
    for k in range(5):  # one passage in different documents
        rows.append((20 + k, f"{words(rng, 30 + k)} {passage} {words(rng, 40)}"))
    rows += [(30, rows[8][1]), (31, rows[8][1].replace(" ", "  ")), (32, words(rng, 4000)), (33, "É " + rows[8][1].upper())]
    rows += [(20, rows[14][1]), (20, rows[14][1]), (40, "<|endoftext|> it's 12 ümläut 漢字 " * 50), (41, "Kİ MIT License. under the Apache License")]
    return rows


# --- 1 -------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "", None, "a<\\/s>b <\\\\/s>", "<|end|><|turn|>", "plain \\ text"]
    rows = [(1, k, "user" if k % 4 < 2 else "assistant", t) for k, t in enumerate(texts)] + [(2, 0, None, "x"), (2, 0, None, "x"), (None, None, "assistant", "y"), (3, 1, "<|role|>", "q")]
    df = spark.createDataFrame([(*r, "formatted", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, ts int")
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).withColumn("loss", chat.loss_text()).collect()}
    for conv in (1, 2, 3, None):
        want = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert [(t["role"], t["text"]) for t in out[conv].turns] == [(r, x) for _, r, x in want]
        assert out[conv].loss == "".join(x for _, r, x in want if r == "assistant")
        for text in texts:
            if text and any(c in text for c in chat.CONTROL):
                assert text not in out[conv].formatted or text in chat.CONTROL
    assert chat.format_conversations(df.limit(0)).count() == 0


# --- 2 -------------------------------------------------------------------------------------------


def library(text):
    from tokenizers import Tokenizer

    t = test_bpe_matches_library.__dict__.setdefault("t", None) or Tokenizer.from_file(tokenizer_path())
    test_bpe_matches_library.t = t
    ids = t.encode(text or "", add_special_tokens=False).ids
    return struct.pack(f"<{len(ids)}I", *ids), t.decode(ids, skip_special_tokens=False)


def test_bpe_matches_library(spark, corpus):
    out = bpe.encode_documents(frame(spark, corpus), tokenizer_path()).collect()
    assert len(out) == len(corpus)
    assert sorted((r.doc_id, bytes(r.ids)) for r in out) == sorted((i, library(t)[0]) for i, t in corpus)
    for r in out:
        assert bpe.decode(bytes(r.ids), tokenizer_path()) in {library(t)[1] for i, t in corpus if i == r.doc_id}
    assert bpe.encode_documents(frame(spark, corpus).limit(0), tokenizer_path()).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abZ09'sStvelL éÉßÿΣİ漢́\n\t-!<|>", max_size=60), st.lists(st.integers(1, 30), max_size=6))
def test_bpe_joins_agree(text, sizes):
    """Any cuts between characters, repaired, give the ids of the whole text."""
    enc, parts, at = bpe.encoder(tokenizer_path()), [], 0
    for n in [*sizes, len(text) + 1]:
        parts.append(bpe.piece(text[at : at + n].encode(), enc))
        at += n
    assert bpe.repair(parts, enc) == library(text)[0]


# --- 3 -------------------------------------------------------------------------------------------


def test_license_scan(spark, corpus):
    rows = [*corpus, (50, "Licensed under the Apache License, Version 2.0. mit-license MIT"), (51, "general public general public license gnu"), (52, "Released under the MIT License. " * 3)]
    # More licence words than the twelve that a file looks up: whole notices one after the other.
    rows.append((53, " and ".join(" ".join(t.words) for t in licenses.TEMPLATES)))
    rows.append((54, " ".join(w for t in licenses.TEMPLATES for w in t.words[::-1]) + " licensed under cc by 4 0 and the mozilla public license"))
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    out = licenses.scan_licenses(frame(spark, rows)).select("doc_id", "n_words", "matches").collect()
    for r, (i, t) in zip(sorted(out, key=lambda r: r.doc_id), sorted(rows, key=lambda r: r[0]), strict=True):
        low = (t or "").translate({c: c + 32 for c in range(65, 91)})
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        want = sorted((k, n) for n, p in phrases.items() for k in range(len(w)) if w[k : k + len(p)] == p)
        assert (i, len(w), want) == (r.doc_id, r.n_words, sorted((m.start, m.label) for m in r.matches if m.base))
    labels = {r.doc_id: {m.label for m in r.matches} for r in out}
    assert {"apache", "apache-2.0", "mit"} <= labels[50] and labels[51] == {"gpl"} and "mit-notice" in labels[52]
    assert licenses.scan_licenses(frame(spark, []), "text").count() == 0
    # All labels against the full template scan: every alignment that holds the mandatory phrases.
    idf = licenses.licence_idf(frame(spark, rows), "text")
    lists = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for _, t in rows]
    assert all(abs(v - math.log((1 + len(rows)) / (1 + sum(w in x for x in lists)))) < 1e-12 for w, v in idf.items())
    for r, w in zip(sorted(out, key=lambda r: r.doc_id), [x for _, x in sorted(zip([i for i, _ in rows], lists, strict=True), key=lambda p: p[0])], strict=True):
        want = []
        for t in licenses.TEMPLATES:
            for at in range(-len(t.words), len(w)):
                fits = [0 <= at + p < len(w) and w[at + p] == x for p, x in enumerate(t.words)]
                if all(fits[p] for k, n in t.keys for p in range(k, k + n)):
                    want.append((t.label, at, round(sum(fits) / len(fits), 9)))
        assert sorted(want) == sorted((m.label, m.start, round(m.fraction, 9)) for m in r.matches)


# --- 4 -------------------------------------------------------------------------------------------


def hit_words(w, items, window=13):
    hit, found = set(), set()
    for i, t in items:
        b = decontam.words_of(t)
        n = min(window, len(b))
        for k in range(len(b) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[k : k + n]:
                    hit.update(range(j, j + n))
                    found.add(str(i))
    return hit, sorted(found)


@pytest.mark.parametrize("blocks", [1, 3])
def test_decontamination(spark, blocks):
    rng = random.Random(1)
    items = [(k, words(rng, 30, 50)) for k in range(6)] + [(7, "w1 w2"), (10, ""), (11, None), (12, "w1 w2")]
    docs = [(0, None), (1, "..."), (2, words(rng, 500, 60)), (2, words(rng, 5, 60))]
    docs += [(3 + k, f"{words(rng, 20)} {items[k][1].upper()} {items[(k + 1) % 6][1]}, É {words(rng, 9)}") for k in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.scan_benchmark(frame(spark, docs), bench, blocks=blocks).select("doc_id", "text", "n_words", "hits", "items").collect()
    assert len(out) == len(docs)
    for r in out:
        w = decontam.words_of(r.text)
        hit, found = hit_words(w, items)
        assert {x for h in r.hits for x in range(h.first_word, h.end_word)} == hit and list(r.items) == found and r.n_words == len(w)
        for h in r.hits:  # offsets lead back to the original text
            assert decontam.words_of(r.text[h.start : h.end]) == w[h.first_word : h.end_word]
    assert [r.hits for r in decontam.scan_benchmark(frame(spark, docs[2:3]), bench.limit(0)).collect()] == [[]]


# --- 5 -------------------------------------------------------------------------------------------


def test_exact_dedup(spark, corpus):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    out = sorted(map(tuple, exact_dedup.exact_groups(frame(spark, corpus)).collect()))
    groups = {}
    for i, t in corpus:
        groups.setdefault(norm(t), []).append(i)
    assert out == sorted((i, min(groups[norm(t)]), len(groups[norm(t)])) for i, t in corpus)
    kept = exact_dedup.keep_first(frame(spark, corpus))
    assert {r.doc_id for r in kept.collect()} == {min(g) for g in groups.values()}
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0


# --- 6 -------------------------------------------------------------------------------------------


def test_quality_classifier(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    df = docs.select("doc_id", "text").join(labels.select("doc_id", quality.grade().alias("grade")), "doc_id")
    model = quality.train(df.where("doc_id % 4 > 0"), 3)
    assert list(model.thresholds) == sorted(model.thresholds)
    out = quality.classify(df.where("doc_id % 4 = 0"), model).collect()  # held out
    kept = {g: np.mean([r.kept for r in out if r.grade == g]) for g in (0, 1, 2)}
    assert kept[2] > 0.98 and kept[1] < 0.2 and kept[0] < 0.5, kept
    assert all(0 <= r.tail_prob <= 1 and 0 <= r.expected_grade <= 2 for r in out)
    odd = quality.classify(frame(spark, [(1, None), (2, ""), (3, "..." * 9999), (3, "  ")]), model).collect()
    assert len(odd) == 4 and all(r.tail_prob is not None for r in odd)
    empty = quality.train(df.limit(0), 3)
    assert len(quality.classify(df.limit(3), empty).collect()) == 3


# --- 7 -------------------------------------------------------------------------------------------


def removed(texts, n):
    count = {}
    for t in texts:
        for i in range(len(t) - n + 1):
            count[t[i : i + n]] = count.get(t[i : i + n], 0) + 1
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                hit[i : i + n] = b"\1" * n
        out.append(bytes(hit))
    return out


def test_suffix_dedup(spark, corpus):
    out = suffixes.repeated_spans(frame(spark, corpus)).collect()
    raws = [(t or "").encode() for _, t in corpus]
    want = sorted((i, t, h) for (i, _), t, h in zip(corpus, raws, removed(raws, suffixes.LENGTH), strict=True))
    got = []
    for r in out:
        hit = bytearray(len(r.text))
        for s in r.spans:
            assert s.end > s.start
            hit[s.start : s.end] = b"\1" * (s.end - s.start)
        assert suffixes.kept_bytes(bytes(r.text), r.spans) == bytes(b for b, h in zip(bytes(r.text), hit, strict=True) if not h)
        got.append((r.doc_id, bytes(r.text), bytes(hit)))
    assert sorted(got) == want
    assert suffixes.repeated_spans(frame(spark, [])).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=8).map(lambda b: bytes(x % 3 for x in b)), max_size=8), max_size=6))
def test_merge_of_runs(runs):
    coded = [sorted((r, b"", 0, 0) for r in run) for run in runs]
    back = [suffixes.read_run(suffixes.front_code(run)) for run in coded]
    assert [r[0] for r in back] == [[x[0] for x in run] for run in coded]
    order, lcp = suffixes.merge_runs([(r[0], r[1]) for r in back])
    merged = [back[i][0][p] for i, p in order]
    assert merged == sorted(r for run in runs for r in run)
    assert lcp[1:] == [suffixes.shared_prefix(a, b) for a, b in zip(merged, merged[1:], strict=False)]


# --- 8 -------------------------------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(3)
    sound = {"aa": "bakadafa", "ii": "simitini", "ou": "poutougou"}
    rows = [(k, " ".join("".join(rng.choices(sound[g], k=6)) for _ in range(40)), g) for k in range(240) for g in [list(sound)[k % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train_network(langid.sample_segments(df.where("doc_id < 180"), "doc_id", "text", "lang"), steps=250)
    out = langid.identify(df.where("doc_id >= 180"), net).collect()
    assert np.mean([r.lang_pred == r.lang for r in out]) >= 0.95 and all(0 < r.score <= 1 for r in out)
    odd = langid.identify(frame(spark, [(1, None), (2, ""), (3, "123 ..."), (4, "é"), (4, "é")]), net).collect()
    assert [r.lang_pred == "und" for r in sorted(odd, key=lambda r: r.doc_id)] == [True, True, True, False, False]
    assert langid.sample_segments(df.limit(0), "doc_id", "text", "lang") == []
    assert {r.lang_pred for r in langid.identify(df.limit(2), None).collect()} == {"und"}


def test_backpropagation():
    """Gradients against finite differences."""
    rng = np.random.default_rng(0)
    net = langid.train_network([("a", b"xyz"), ("b", b"uvw")], steps=1)
    for name in ("table", "state", "head", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    seg, mask, y = rng.integers(97, 123, (langid.SEGMENT, 3)), np.ones((langid.SEGMENT, 3)), np.array([0, 1, 1])

    def loss():
        p = net.probabilities(seg)
        return -np.log(p[:, np.arange(3), y]).mean()

    grads = langid._gradients(net, seg, mask, y)
    for part, g in zip((net.table, net.state, net.head, net.bias), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = part[at]
        part[at] = old + 1e-2
        up = loss()
        part[at] = old - 1e-2
        down = loss()
        part[at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 2e-3 + 0.05 * abs(g[at])


# --- 9 -------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 99))
def test_permutation(n, seed):
    assert sorted(shards.permute(np.arange(n), n, seed).tolist()) == list(range(n))


def test_sharding(spark):
    rows = [(k % 700, "t") for k in range(1003)] + [(None, None)]
    df = frame(spark, rows)
    numbered, n = shards.row_numbers(df, "doc_id", "tie", "number")
    by_number = [r.doc_id for r in sorted(numbered.collect(), key=lambda r: r.number)]
    assert by_number == [None, *sorted(i for i, _ in rows[:-1])]
    assert n == 1004 and sorted(r.number for r in numbered.collect()) == list(range(1004))
    out = shards.feistel_shards(df, shards=40).collect()
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(slots) == 40 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert shards.feistel_shards(frame(spark, [])).count() == 0


# --- 10 ------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(jaccard._LOWER).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def test_ngram_jaccard(spark, corpus):
    rng = random.Random(9)
    rows = list(corpus)
    for k in range(12):  # chains: neighbours are similar, ends are not
        rows.append((100 + k, " ".join(f"c{x}" for x in range(6 * k, 6 * k + 60))))
    small = [" ".join(f"s{rng.randrange(3)}" for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    rows += [(200 + k, t) for k, t in enumerate(small)]
    assert sorted(map(tuple, jaccard.similar_components(frame(spark, rows)).collect())) == brute_components(rows)


def test_ngram_jaccard_empty(spark):
    assert jaccard.similar_components(frame(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**62), min_size=1, max_size=120), st.integers(0, 12), st.integers(0, 12), st.integers(0, 3))
def test_pigeonhole(elements, drop, add, seed):
    """Every similar pair shares a subset on the segments the larger set must match."""
    rng = random.Random(seed)
    a = np.array(sorted(elements), np.uint64)
    gone = set(rng.sample(sorted(elements), min(drop, len(elements) - 1)))
    b = np.array(sorted((elements - gone) | {2**63 + rng.randrange(2**40) for _ in range(add)}), np.uint64)
    a, b = jaccard._mix(a), jaccard._mix(b)
    a.sort(), b.sort()
    assert jaccard.difference_bound(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))
    if not jaccard.similar(a, b):
        return
    small, large = sorted((a, b), key=len)
    zone = jaccard.band(len(large))
    assert jaccard.band(len(small)) in (zone, zone - 1)
    k, double = jaccard.filled(large, seed)
    mine, other = jaccard.subset_signatures(large, zone, seed), jaccard.subset_signatures(small, zone, seed)
    if k >= jaccard.need(len(large)):
        assert len(np.intersect1d(mine, other)) > k - jaccard.need(len(large))
    elif k + double >= jaccard.need(len(large)):
        mine = np.concatenate([mine, jaccard.deletion_signatures(large, zone, seed)])
        other = np.concatenate([other, jaccard.deletion_signatures(small, zone, seed)])
        assert len(np.intersect1d(mine, other))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(0, k) for k in range(300, 340)] + [(k, k + 1) for k in range(500, 530)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    out = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    want = {x: find(x) for x in root}
    got = {r.node: r.root for r in out.collect()}
    assert got == {x: r for x, r in want.items() if sum(v == r for v in want.values()) > 1}



# --- the pipeline --------------------------------------------------------------------------------


def test_stages_keep_the_right_rows(spark, corpus):
    """Each dedup stage against brute force, with ids that repeat on other texts."""
    rows = [*corpus, (3, "another text under an id that repeats " * 3), (60, "one"), (None, "one")]
    df = frame(spark, rows)
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    least = {}
    for i, t in rows:
        if i is not None:
            least[norm(t)] = min(least.get(norm(t), i), i)
    out = exact_dedup.keep_first(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == sorted((str(i), t or "") for i, t in rows if i is None or i == least[norm(t)])
    known = [r for r in rows if r[0] is not None]
    near = jaccard.keep_one_of_each(frame(spark, known))
    want = [(d, t or "") for (d, t), (_, _, c) in zip(sorted(known, key=lambda r: (r[0], r[1] or "")), brute_in_order(sorted(known, key=lambda r: (r[0], r[1] or ""))), strict=True) if d == c]
    assert sorted((r.doc_id, r.text or "") for r in near.collect()) == sorted(want)


def brute_in_order(rows):
    """Components of ``rows`` in their order."""
    marked = [(k, t) for k, (_, t) in enumerate(rows)]
    reach = {k: c for k, _, c in brute_components(marked)}
    least = {}
    for k, (d, _) in enumerate(rows):
        least[reach[k]] = min(least.get(reach[k], d), d)
    return [(d, 0, least[reach[k]]) for k, (d, _) in enumerate(rows)]
