"""Operators 11 to 13 against brute force and their SQL, on small and awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from rhoscope.llm import divergence, mixing, queries, repair

WS = " \t\n\x0b\f\r"
BIG = 1 << 60


def same_as_sql(df, name, **tables):
    c = duckdb.connect()
    for t, path in tables.items():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    cols = df.columns
    ours = sorted(map(repr, (tuple(r[k] for k in cols) for r in df.collect())))
    want = sorted(map(repr, c.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()))
    assert ours == want
    return ours


# --- 11 ------------------------------------------------------------------------------------------


def shortest(rows):
    """(cost, audit, repaired) by dynamic programming over (turn, state), inserts as edges."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    best = {0: (0, "", ())}

    def inserts(at):
        for _ in range(3):
            for i, (c, a, r) in list(at.items()):
                for name in ("user", "assistant"):
                    j = step.get((i, name[0]))
                    if j is not None:
                        new = (c + 3, a + "I", (*r, (name, "")))
                        at[j] = min(at.get(j, new), new)
        return at

    best = inserts(best)
    for role, text, fault in rows:
        after = {}

        def offer(j, new, after=after):
            after[j] = min(after.get(j, new), new)

        for i, (c, a, r) in best.items():
            offer(i, (c + 4, a + "D", r))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            j = step.get((i, role[:1]))
            if j is not None:
                offer(j, (c + more, a + "K", (*r, (role, text))))
            for name in ("user", "assistant"):
                j = step.get((i, name[0]))
                if j is not None:
                    offer(j, (c + 3 + more, a + "R", (*r, (name, text))))
        best = inserts(after)
    return min(best[i] for i in (0, 3) if i in best)


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))


def expected_audit(rows):
    """rows: (turn, role, text) after damage."""
    rows, seen, faults = ordered(rows), set(), []
    for _, role, text in rows:
        bare = text.rstrip(WS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, said = shortest([(r, t, f) for (_, r, t), f in zip(rows, faults, strict=True)]) if rows else (0, "", ())
    n = Counter(faults)
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, said


def talk(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "no", "Why?", "", "  \t", "Well!\n", "a long. sentence", None, "été.", "x\x85", "end. "]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = []
    for conv in [*range(60), None, BIG + 1]:
        n = rng.choice([1, 2, 3, 5, 9])
        for k in range(n):
            turn = rng.choice([k, k, k, 2 * k, None, 0])
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.6 else rng.choice(roles)
            rows.append((conv, turn, role, rng.choice(texts)))
    return rows


def damage(rows):
    out = {}
    text = lambda v: " " if v is None else str(v)
    for conv, turn, role, said in rows:
        k = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, said = text(role), text(said)
        said = "" if k == 1 else re.sub("[.!?]", "", said) if k == 2 else said
        out.setdefault(conv, []).extend([(turn, "user" if k == 4 else role, said)] * (0 if k == 0 else 2 if k == 3 else 1))
    return out


def test_repair_query_against_brute_force_and_sql(spark, tmp_path):
    rows = talk(3)
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    table.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    want = {}
    for conv, of in damage(rows).items():
        *figures, said = expected_audit(of)
        want[conv] = (*figures, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())
    assert got == want
    same_as_sql(queries.op11_conversation_repair(spark, str(tmp_path)), "op11_conversation_repair", conversations=tmp_path / "conversations.parquet")


def test_repaired_turns_and_long_conversations(spark):
    """Runs that meet across many blocks give what one pass gives."""
    rng = random.Random(5)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), rng.choice(["Fine.", f"no {k}", f"Ok {k}.", ""])) for k in range(9000)]
    rows += [(8, 0, "user", "a."), (8, 1, "assistant", "b."), (9, 5, "system", "only.")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    audits = repair.audit_conversations(turns)
    got = {r["conv_id"]: tuple(r)[1:] for r in audits.collect()}
    want = {c: expected_audit([r[1:] for r in rows if r[0] == c]) for c in (7, 8, 9)}
    assert got == {c: w[:-1] for c, w in want.items()}
    fixed = {}
    for r in sorted(repair.repaired_turns(turns, audits).collect()):
        fixed.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert fixed == {c: list(w[-1]) for c, w in want.items() if w[-1]}
    for said in fixed.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in said))


def test_product_is_associative():
    rng = random.Random(1)
    ms = [repair.turn_matrix(rng.choice("sua-"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(12)]
    left = ms[0]
    for m in ms[1:]:
        left = repair.times(left, m)
    right = ms[-1]
    for m in ms[-2::-1]:
        right = repair.times(m, right)
    assert left == right and repair.times(repair.CLOSURE, repair.CLOSURE) == repair.CLOSURE


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.audit_conversations(none).count() == 0
    gone = spark.createDataFrame([(1,), (None,), (1,)], "conv_id long")
    out = repair.audit_conversations(none, ids=gone)
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(map(repr, [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]))
    text = spark.createDataFrame([("k", None, None, None)], "conv_id string, turn long, role string, text string")
    assert [tuple(r) for r in repair.audit_conversations(text).collect()] == [("k", 0, 1, 0, 0, 0, 4, "D")]


# --- 12 ------------------------------------------------------------------------------------------


def expected_targets(sizes, weights, most=3):
    """Shares of the whole by weight, limits applied round by round, in fractions."""
    left, free, out = Fraction(sum(sizes)), set(range(len(sizes))), {}
    while free:
        total = sum(weights[i] for i in free)
        above = {i for i in free if left * weights[i] > most * sizes[i] * total}
        if not above:
            return [out.get(i, left * weights[i] / total) for i in range(len(sizes))]
        for i in above:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        free -= above
    return [out[i] for i in range(len(sizes))]


def texts(seed, n):
    rng = random.Random(seed)
    sources = ["a", "b", "é", "", None, "Z", "tiny", "\U0001f600", "￿"]
    return [(None if i % 41 == 0 else i, None if i % 17 == 0 else " \x85w" * rng.choice([0, 1, 3, 8, 40]), "en", "tiny" if i == 5 else rng.choice(sources[:6] + sources[7:]), 1) for i in range(n)] + [(5, "same text", "en", "a", 1)] * 3


DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def test_mix_query_against_fractions_and_sql(spark, tmp_path):
    rows = texts(2, 400)
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op12_source_mix(spark, str(tmp_path))
    same_as_sql(out, "op12_source_mix", documents=tmp_path / "documents.parquet")
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    n_words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = [sum(n_words(t) for _, t, _, s, _ in rows if s == name) for name in names]
    want = dict(zip(sizes, map(float, expected_targets(sizes, [(5, 2, 1)[k % 3] for k in range(len(names))])), strict=True))
    assert len(want) == len(names)  # the sizes tell the sources apart here
    longest = {sum_: max(n_words(t) for _, t, _, s, _ in rows if s == name) for name, sum_ in zip(names, sizes, strict=True)}
    taken = Counter()
    for r in out.collect():
        assert r["target"] == pytest.approx(want[r["source_size"]], rel=1e-12) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source_size"]] += r["taken"]
    assert all(abs(taken[s] - t) <= longest[s] for s, t in want.items())


def test_mix_keeps_columns_and_ignores_partitions(spark):
    df = spark.createDataFrame([(i, i % 7, "ab"[i % 2], f"x{i}") for i in range(200)], "doc_id long, size long, source string, number string")
    key = lambda d: sorted(tuple(r) for r in d.collect())
    one, two = mixing.mix(df.coalesce(1)), mixing.mix(df.repartition(9))
    assert key(one) == key(two) and one.columns[:4] == df.columns
    copies = mixing.emitted(one)
    assert copies.count() == one.agg({"copies": "sum"}).first()[0]
    assert mixing.mix(df.limit(0)).count() == 0
    empty = df.withColumn("size", df["size"] * 0)
    assert {r["target"] for r in mixing.mix(empty).collect()} == {0.0}


def test_mix_of_one_source_takes_it_once(spark):
    df = spark.createDataFrame([(i, 5, None) for i in range(30)], "doc_id long, size long, source string")
    assert {(r["target"], r["copies"]) for r in mixing.mix(df).collect()} == {(150.0, 1)}


def test_water_filling(spark):
    sizes, weights = [1, 10, 100, 1000, 3, 0], [5, 2, 1, 5, 2, 1]
    df = spark.createDataFrame(list(zip(sizes, weights, strict=True)), "source_size long, w long")
    got = {r["source_size"]: r["target"] for r in mixing.targets(df, df["w"]).collect()}
    assert got == dict(zip(sizes, map(float, expected_targets(sizes, weights)), strict=True))


# --- 13 ------------------------------------------------------------------------------------------


def expected_divergence(rows, least=3, top=200):
    norm = lambda v: "" if v is None else v
    docs = [(norm(g), norm(s), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", norm(t).translate({c: c + 32 for c in range(65, 91)}))) for _, t, g, s, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for g, _, w in docs if g == lang for t in set(w))
        kept = [t for t, n in df.items() if n >= least]
        counts = {s: Counter() for g, s, _ in docs if g == lang}
        whole = Counter()
        for g, s, w in docs:
            if g == lang:
                counts[s].update(t for t in w if df[t] >= least)
                whole.update(t for t in w if df[t] >= least)

        def p(c, kept=kept):
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        probs, q = {s: p(c) for s, c in counts.items()}, p(whole)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in counts:
            pair = [(o, sum(f(probs[s][t], probs[o][t]) for t in kept)) for o in counts if o != s]
            term = [(t, f(probs[s][t], q[t])) for t in kept if counts[s][t] and probs[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


def speech(seed, n, words=60):
    rng = random.Random(seed)
    vocab = [f"{'AbCé'[k % 4]}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(words)]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "fr", None])
        source = rng.choice(["s1", "s2", "s3", None, ""])
        text = None if i % 19 == 0 else " ".join(rng.choice(vocab[: 10 + 10 * (i % 5)]) for _ in range(rng.choice([0, 1, 5, 60]))) + " 12-[x]_Y"
        rows.append((i, text, lang, source, 1))
    return [*rows, (1, "alone here", "xx", "only", 1), (2, None, "yy", "p", 1), (3, "", "yy", "q", 1), (4, "rare", "yy", None, 1)]


def test_divergence_query_against_brute_force_and_sql(spark, tmp_path):
    rows = speech(4, 300)
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op13_source_divergence(spark, str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == expected_divergence(rows)
    same_as_sql(out, "op13_source_divergence", documents=tmp_path / "documents.parquet")


def test_divergence_in_small_dictionaries(spark, monkeypatch):
    """Emptying the counters at any point changes nothing; other columns are ignored."""
    rows = speech(6, 120)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS + ", term string, value string")
    monkeypatch.setattr(divergence, "HELD", 10)
    batches = df.select("lang", "source", "text").toArrow().to_batches()
    small = Counter()
    for b in divergence._count(iter(batches)):
        for lang, source, term, n, docs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            small[lang, source, term, "n"] += n
            small[lang, source, term, "docs"] += docs
    monkeypatch.setattr(divergence, "HELD", 10**6)
    large = Counter()
    for b in divergence._count(iter(batches)):
        for lang, source, term, n, docs in zip(*(c.to_pylist() for c in b.columns), strict=True):
            large[lang, source, term, "n"] += n
            large[lang, source, term, "docs"] += docs
    assert small == large
    got = sorted(tuple(r) for r in divergence.audit_sources(df, top=5).collect())
    assert got == expected_divergence(rows, top=5)
    assert divergence.audit_sources(df.limit(0)).count() == 0


def test_probability_beyond_64_bits(spark):
    big = 10**12
    df = spark.createDataFrame([(big, 3 * big, 7)], "c long, n long, v long").select(divergence.probability(F.col("c"), F.col("n"), F.col("v")))
    assert df.first()[0] == 1 + 10**9 * (big + 1) // (3 * big + 7)
