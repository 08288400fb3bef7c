"""The registered queries and the pipeline on a small fixture, against brute force.

The ids hold nulls, repeats and numbers that a double can't hold, in one batch.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

import corpus_pipeline
from rhoscope.llm import jaccard, langid, quality, queries, shards, suffixes

BIG = 1 << 60
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(b):
    return hashlib.sha256(b).hexdigest()


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def build():
    rng = random.Random(8)
    say = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    base, item = say(120), say(30)
    passage = say(70)
    docs = [(BIG + 1, base), (None, say(60)), (BIG + 3, base.replace(" ", "  ")), (5, base + " w1"), (5, say(40)), (6, None), (7, ""), (None, None), (8, f"{say(50)} {passage}")]
    docs += [(9, f"{passage} {say(44)}"), (10, f"{say(9)} {item.upper()}"), (11, say(3000)), (12, "MIT License. " + say(8)), (13, "\u00e9t\u00e9 " * 90), (13, "\u00e9t\u00e9 " * 90)]
    docs += [(100 + k, f"{'good fine clear' if k % 3 else 'bad awful junk'} {say(30)}") for k in range(60)]
    langs = [None if i is None else ("aa" if i % 2 else "bb") for i, _ in docs]
    labels = [(100 + k, int(k % 3 > 0), 0) for k in range(60)] + [(101, None, None), (None, 1, 0), (6, 1, 1)]
    bench = [("q1", item), (None, None), ("q2", "w1 w2 nowhere"), ("q3", "")]
    talk = [(1, 0, "user", "a"), (1, 1, "assistant", None), (None, 0, "user", "b")]
    return docs, langs, labels, bench, talk


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    docs, langs, labels, bench, talk = build()
    rows = [(i, t, x, "s", None if t is None else len(t)) for (i, t), x in zip(docs, langs, strict=True)]
    for name, data, schema in (
        ("documents", rows, "doc_id long, text string, lang string, source string, n_chars int"), ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", bench, "item_id string, text string"), ("conversations", talk, "conv_id long, turn long, role string, text string"),
    ):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(d / f"{name}.parquet"))
    return str(d)


def library(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    ids = t.encode(text or "", add_special_tokens=False).ids
    return b"".join(i.to_bytes(4, "little") for i in ids), t.decode(ids, skip_special_tokens=False)


def expected_spans(raws):
    """Bytes covered by a 200-byte string that starts twice anywhere."""
    seen = {}
    for k, raw in enumerate(raws):
        for i in range(len(raw) - 199):
            seen.setdefault(raw[i : i + 200], []).append((k, i))
    hit = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                hit[k][i : i + 200] = b"\x01" * 200
    return hit


def decontaminated(docs, bench):
    """n_words, n_hit, items found of each text."""
    out = []
    for _, t in docs:
        w, hit, found = words_of(t), set(), set()
        for item, text in bench:
            x = words_of(text)
            n = min(13, len(x))
            for win in {tuple(x[i : i + n]) for i in range(len(x) - n + 1)} if n else ():
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) == win:
                        hit.update(range(i, i + n))
                        found.add(str(item))
        out.append((len(w), len(hit), sorted(found)))
    return out


def linked(docs):
    sets = []
    for _, t in docs:
        w = (t or "").translate(LOWER).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    least = {}
    for (i, _), r in zip(docs, root, strict=True):
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return [(i, len(s), least[r]) for (i, _), s, r in zip(docs, sets, root, strict=True)]


def rows_of(df, *columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.select(*columns).collect())))


def same(got, want):
    assert got == sorted(map(repr, want))


def test_bpe(spark, tables):
    want = []
    for i, t in build()[0]:
        ids, text = library(t)
        want.append((i, len(ids) // 4, sha(ids), sha(text.encode())))
    same(rows_of(queries.op2_bpe(spark, tables), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), want)


def test_licenses(spark, tables):
    got = queries.op3_license_scan(spark, tables)
    same(rows_of(got, "doc_id", "n_words", "n_base"), [(i, len(words_of(t)), int(i == 12)) for i, t in build()[0]])
    assert rows_of(got.where("n_base > 0"), "first_word", "last_word", "base_labels", "labels", "score") == ["(0, 0, 'mit', 'mit', 0.5)"]


def test_decontamination(spark, tables):
    docs, _, _, bench, _ = build()
    want = [(i, n, h, len(f), sha(",".join(f).encode()), h > 0 and 20 * h >= n) for (i, _), (n, h, f) in zip(docs, decontaminated(docs, bench), strict=True)]
    same(rows_of(queries.op4_decontaminate(spark, tables), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), want)


def test_quality(spark, tables):
    model = queries.quality_model(spark, tables)
    got = queries.op6_quality(spark, tables)
    tails = [model.tails(quality.np.array([model.score(t)]))[0] for _, t in build()[0]]
    same(rows_of(got, "doc_id", "kept"), [(i, bool(x[1] >= 0.5)) for (i, _), x in zip(build()[0], tails, strict=True)])
    good = {r.doc_id: r.kept for r in got.where("doc_id >= 100 and doc_id < 200").collect()}
    assert sum(good[100 + k] == (k % 3 > 0) for k in range(60)) >= 57


def test_suffixes(spark, tables):
    docs = build()[0]
    raws = [(t or "").encode() for _, t in docs]
    want = []
    for (i, _), raw, hit in zip(docs, raws, expected_spans(raws), strict=True):
        kept = bytes(b for b, h in zip(raw, hit, strict=True) if not h)
        want.append((i, len(raw), sum(hit), len(re.findall(b"\x01+", bytes(hit))), sha(kept)))
    assert any(w[2] for w in want) and suffixes.LENGTH == 200
    same(rows_of(queries.op7_suffix_dedup(spark, tables), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), want)


def test_language(spark, tables):
    docs, langs, *_ = build()
    held = [zlib.crc32(str(i).encode()) % 5 == 0 if i is not None else None for i, _ in docs]
    got = queries.op8_language_id(spark, tables)
    same(rows_of(got, "doc_id", "held_out"), [(i, h) for (i, _), h in zip(docs, held, strict=True)])
    for r in got.collect():
        assert r.lang_pred in {"aa", "bb", langid.UND} and 0 <= r.score <= 1
    same(rows_of(got.where("lang_pred = 'und'"), "doc_id"), [(i,) for i, t in docs if not t])


def test_sharding(spark, tables):
    """The permutation in plain integers."""
    docs = build()[0]
    rows = sorted((((i is not None, i or 0), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs))
    n, half, seed = len(rows), 1, 7
    while 1 << 2 * half < n:
        half += 1
    mask, whole = (1 << half) - 1, (1 << 64) - 1

    def mix(x, key):
        x = (x + key) * 0x9E3779B97F4A7C15 & whole
        x ^= x >> 29
        x = x * 0xBF58476D1CE4E5B9 & whole
        return x ^ (x >> 32)

    def once(x):
        left, right = x >> half, x & mask
        for r in range(shards.ROUNDS):
            left, right = right, left ^ (mix(right, (seed * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & whole) & mask)
        return left << half | right

    want = []
    for k, ((_, i), size, crc) in enumerate(rows):
        at = once(k)
        while at >= n:
            at = once(at)
        want.append((i if rows[k][0][0] else None, size, crc, "rows", at % 40, at // 40, None))
    same(rows_of(queries.op9_sharding(spark, tables), "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"), want)


def test_jaccard(spark, tables):
    docs = build()[0]
    same(rows_of(queries.op10_ngram_jaccard(spark, tables), "doc_id", "n_shingles", "component_id"), linked(docs))


def test_hot_subsets_meet_outside_their_bucket(spark, monkeypatch):
    """Many records with one passage, with limits so small that groups are split."""
    monkeypatch.setattr(jaccard, "CROWD", 4)
    rng = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(40))
    docs = []
    for k in range(60):
        own = " ".join(f"v{rng.randrange(9)}" for _ in range(6 + k % 9))
        docs.append((k, f"{passage} {own}"))
    got = jaccard.similar_components(spark.createDataFrame(docs, "doc_id long, text string"), hot_from=3, entries_per_bucket=500)
    same(rows_of(got, "doc_id", "n_shingles", "component_id"), linked(docs))


def test_pipeline(spark, tables):
    docs, _, _, bench, _ = build()
    model = queries.quality_model(spark, tables)
    kept = [d for d in docs if model.tails(quality.np.array([model.score(d[1])]))[0][1] >= 0.5]
    least = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    for i, t in kept:
        if i is not None:
            least[norm(t)] = min(i, least.get(norm(t), i))
    kept = [(i, t) for i, t in kept if i is None or i == least[norm(t)]]
    kept = [(i, t) for (i, t), (_, _, c) in zip(kept, linked(kept), strict=True) if i is None or i == c]
    kept = [d for d, (n, h, _) in zip(kept, decontaminated(kept, bench), strict=True) if not (h and 20 * h >= n)]
    want = [(i, len(library(t)[0]) // 4, library(t)[0]) for i, t in kept]
    got = corpus_pipeline.run(spark, tables)
    assert len(want) > 20 and sorted(repr((r.doc_id, r.n_tokens, bytes(r.ids))) for r in got.collect()) == sorted(map(repr, want))
