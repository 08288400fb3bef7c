"""The two trained operators against plain loops: what they predict, and what they descend."""

import math
import re
import zlib

import numpy as np

from rhoscope.llm import langid, quality


def plain_features(text):
    """{bucket: value} of a text, token by token."""
    counts, tokens = {}, re.findall(r"\w+|[^\w\s]+", text)
    for w in tokens:
        counts[w.lower()] = counts.get(w.lower(), 0) + 1
    out = {}
    rms = math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values()) / len(counts)) if counts else 1.0
    for w, n in counts.items():
        for key, share in ((w, 1.0), ("^" + w[:4], 0.5)):
            at = zlib.crc32(key.encode()) % quality.BUCKETS
            out[at] = out.get(at, 0.0) + share * 0.27 * math.log1p(n) / rms
    if tokens:
        facts = (sum(w.isupper() and len(w) > 1 for w in tokens) / len(tokens), 1 - len(counts) / len(tokens), 1 / (1 + len(tokens) / 20))
        for at, v in enumerate(facts, 1):
            out[at] = out.get(at, 0.0) + v
    return out


TEXTS = ["One fish, two FISH!! red fish", "BUY now now NOW $$$", "é ÀÉ naïve façade", "a", "... --- ...", "", "  ", "word " * 500 + "END"]


def test_quality_against_plain_scoring(spark):
    rng = np.random.default_rng(2)
    model = quality.OrdinalModel(rng.normal(0, 1, quality.BUCKETS).astype(np.float32), np.array([-0.4, 0.7]))
    df = spark.createDataFrame(list(enumerate([*TEXTS, None])), "doc_id int, text string")
    got = {r.doc_id: r for r in quality.classify(df, model).collect()}
    for k, text in enumerate([*TEXTS, None]):
        s = sum(float(model.weights[at]) * v for at, v in plain_features(text or "").items())
        tails = [1 / (1 + math.exp(t - s)) for t in (-0.4, 0.7)]
        assert math.isclose(got[k].expected_grade, sum(tails), abs_tol=2e-5) and math.isclose(got[k].tail_prob, tails[1], abs_tol=2e-5)
        assert got[k].kept == (got[k].tail_prob >= 0.5)


def likelihood(rows, w, raw):
    """Mean negative logarithm of the cumulative-link likelihood, row by row."""
    th = [raw[0]]
    for r in raw[1:]:
        th.append(th[-1] + math.exp(r))
    below = lambda j, s: 0.0 if j < 0 else 1.0 if j == len(th) else 1 / (1 + math.exp(s - th[j]))
    out = 0.0
    for grade, f in rows:
        s = sum(w.get(at, 0.0) * v for at, v in f.items())
        out -= math.log(below(grade, s) - below(grade - 1, s))
    return out / len(rows)


def test_quality_descends_the_likelihood():
    """The first step of the fit, turned back into a gradient, against finite differences."""
    rows = [(k % 3, t) for k, t in enumerate(TEXTS[:5])]
    plain = [(g, plain_features(t)) for g, t in rows]
    rate, eps = 0.5, 1e-3
    model = quality.fit([(g, *quality.features(t)) for g, t in rows], 3, epochs=1, rate=rate, decay=0.0)
    start = [-0.5, 0.0]
    for at in sorted({at for _, f in plain for at in f}):
        slope = (likelihood(plain, {at: 1e-5}, start) - likelihood(plain, {at: -1e-5}, start)) / 2e-5
        step = -rate * slope / math.sqrt(eps + slope * slope)
        assert math.isclose(float(model.weights[at]), step, abs_tol=1e-4), at
    raw = []
    for j in (0, 1):
        up, down = ([x + d * (k == j) for k, x in enumerate(start)] for d in (1e-5, -1e-5))
        slope = (likelihood(plain, {}, up) - likelihood(plain, {}, down)) / 2e-5
        raw.append(start[j] - 0.2 * slope / math.sqrt(eps + slope * slope))
    assert np.allclose(model.thresholds, [raw[0], raw[0] + math.exp(raw[1])], atol=1e-4)


def test_quality_reaches_the_optimum():
    """A slow descent on the same rows finds nothing much better than the fit."""
    words = ["good", "plain", "bad"]
    rng = np.random.default_rng(4)
    rows = [(g, " ".join(rng.choice(words, 6, p=np.roll([0.6, 0.3, 0.1], g)))) for g in (0, 1, 2) for _ in range(30)]
    plain = [(g, plain_features(t)) for g, t in rows]
    model = quality.fit([(g, *quality.features(t)) for g, t in rows], 3, epochs=400, decay=0.0)
    keys = sorted({at for _, f in plain for at in f})
    gap = [float(model.thresholds[0]), math.log(model.thresholds[1] - model.thresholds[0])]
    w = {at: float(model.weights[at]) for at in keys}
    reached = best = likelihood(plain, w, gap)
    x = np.array([*(w[at] for at in keys), *gap])
    value = lambda x: likelihood(plain, dict(zip(keys, x[:-2], strict=True)), x[-2:])
    for _ in range(60):
        slope = np.array([(value(x + d) - value(x - d)) / 2e-5 for d in np.eye(len(x)) * 1e-5])
        x = x - 1.0 * slope
        best = min(best, value(x))
    assert reached < likelihood(plain, {}, [-0.5, 0.0]) and reached - best < 0.01


def plain_language(net, raw):
    """Label probabilities pooled over the bytes of a text, one position at a time."""
    h_n = langid.HIDDEN
    squash = lambda a: a / (1 + abs(a))
    pooled = [0.0] * len(net.langs)
    for at in range(0, len(raw), langid.SEGMENT):
        seg = raw[at : at + langid.SEGMENT]
        seg += b" " * (langid.SEGMENT - len(seg))  # a short end is read with blanks after it
        states = []
        for d in (0, 1):
            h, seen = [0.0] * h_n, {}
            for t in range(len(seg)) if d == 0 else reversed(range(len(seg))):
                a = [float(net.table[d, seg[t], k]) + sum(h[j] * float(net.state[d, j, k]) for j in range(h_n)) for k in range(2 * h_n)]
                h = [h[k] + (0.5 + 0.5 * squash(a[k])) * (squash(a[h_n + k]) - h[k]) for k in range(h_n)]
                seen[t] = h
            states.append(seen)
        for t in range(min(langid.SEGMENT, len(raw) - at)):
            both = states[0][t] + states[1][t]
            x = [float(net.bias[k]) + sum(both[j] * float(net.head[j, k]) for j in range(2 * h_n)) for k in range(len(net.langs))]
            e = [math.exp(v - max(x)) for v in x]
            pooled = [p + v / sum(e) for p, v in zip(pooled, e, strict=True)]
    return [p / len(raw) for p in pooled]


def test_language_against_plain_loops(spark):
    rng = np.random.default_rng(6)
    net = langid.train_network([("a", b"xyz abc"), ("b", b"uvw"), ("c", "éàü".encode())], steps=20)
    sizes = (1, 5, 63, 64, 65, 127, 128, 129, 300)
    texts = ["".join(rng.choice(list("abc xyzé."), n)) + "q" for n in sizes] + ["", "12 34", "..."]
    df = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id int, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, net).collect()}
    assert got.pop(99) == ("und", 0.0)
    for k, text in enumerate(texts):
        if not any(map(str.isalpha, text)):
            assert got[k] == ("und", 0.0)
            continue
        p = plain_language(net, text.encode())
        assert got[k][0] == net.langs[int(np.argmax(p))] and math.isclose(got[k][1], max(p), abs_tol=1e-4)
