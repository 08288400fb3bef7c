"""Language identification by a bidirectional gated recurrent network over bytes.

Each direction is a gated unit with one gate: z = gate(A[b] + U h),
c = squash(C[b] + V h), h' = h + z (c - h), where b is the byte.  squash is
softsign and the gate its shift to (0, 1): both are cheap on long texts.  The
two states of a position give its language probabilities; a document's are the
mean over all its bytes.  Trained in numpy by backpropagation through time.

Texts are read whole, in segments of ``SEGMENT`` bytes whose states start
fresh, so that thousands of segments advance in one matrix product.  Training
takes segments of at most ``max_docs`` documents for each language, chosen by a
hash (a documented bound).

Defined results: null texts and texts without a letter are ``und`` with score
0; with nothing to learn from, so are all; documents without a language are
predicted but not learned from; ties go to the first language in order;
repeated rows are separate rows; other columns are kept, but for those named
like the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import append_columns, hash_below, small_batches

SEGMENT, HIDDEN = 64, 8
UND = "und"


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


@dataclass
class Network:
    langs: list[str]
    table: np.ndarray  # 2 directions x 256 x 2H: inputs of gate and candidate
    state: np.ndarray  # 2 x H x 2H
    head: np.ndarray  # 2H x L
    bias: np.ndarray  # L

    def run(self, seg: np.ndarray, keep: bool = False):
        """States of all positions, (2, T, B, H), of ``seg`` (T, B); direction 1
        reads backwards.  ``keep``: also what training needs."""
        steps, b = seg.shape
        hs = np.empty((2, steps, b, HIDDEN), np.float32)
        trace = np.empty((2, steps, b, 2 * HIDDEN), np.float32) if keep else None
        for d in (0, 1):
            h = np.zeros((b, HIDDEN), np.float32)
            table, u = self.table[d], self.state[d]
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                a = h @ u
                a += table.take(seg[t], axis=0)
                if keep:
                    trace[d, t] = a
                den = np.abs(a)
                den += 1
                a /= den
                z = a[:, :HIDDEN] * 0.5
                z += 0.5
                c = a[:, HIDDEN:] - h
                c *= z
                h = np.add(h, c, out=hs[d, t])
        return (hs, trace) if keep else hs

    def probabilities(self, seg: np.ndarray) -> np.ndarray:
        """(T, B, L) label probabilities of every position."""
        hs = self.run(seg)
        steps, b = seg.shape
        x = hs[0].reshape(-1, HIDDEN) @ self.head[:HIDDEN]
        x += hs[1].reshape(-1, HIDDEN) @ self.head[HIDDEN:]
        x += self.bias
        x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        x /= x.sum(axis=1, keepdims=True)
        return x.reshape(steps, b, -1)


def _gradients(net: Network, seg: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    hs, trace = net.run(seg, keep=True)
    steps, b = seg.shape
    both = np.concatenate([hs[0], hs[1]], axis=2).reshape(-1, 2 * HIDDEN)
    x = both @ net.head + net.bias
    x -= x.max(axis=1, keepdims=True)
    p = np.exp(x)
    p /= p.sum(axis=1, keepdims=True)
    dx = p.reshape(steps, b, -1)
    dx[:, np.arange(b), y] -= 1
    dx *= (mask / mask.sum())[:, :, None]
    flat = dx.reshape(-1, dx.shape[2])
    dhead, dbias = both.T @ flat, flat.sum(axis=0)
    dhs = (flat @ net.head.T).reshape(steps, b, 2 * HIDDEN)
    dtable, dstate = np.zeros_like(net.table), np.zeros_like(net.state)
    for d in (0, 1):
        dh = np.zeros((b, HIDDEN), np.float32)
        order = range(steps - 1, -1, -1) if d == 0 else range(steps)
        for t in order:
            dh = dh + dhs[t, :, d * HIDDEN : (d + 1) * HIDDEN]
            before = t - 1 if d == 0 else t + 1
            h = hs[d, before] if 0 <= before < steps else np.zeros((b, HIDDEN), np.float32)
            a = trace[d, t]
            slope = 1 / (1 + np.abs(a)) ** 2
            s = _squash(a)
            z, c = 0.5 + 0.5 * s[:, :HIDDEN], s[:, HIDDEN:]
            da = np.concatenate([dh * (c - h) * 0.5, dh * z], axis=1) * slope
            dstate[d] += h.T @ da
            np.add.at(dtable[d], seg[t], da)
            dh = dh * (1 - z) + da @ net.state[d].T
    return [dtable, dstate, dhead, dbias]


def train_network(samples: list[tuple[str, bytes]], steps: int = 700, batch: int = 192, rate: float = 0.02, seed: int = 5) -> Network | None:
    """Adam over segments (language, up to ``SEGMENT`` bytes)."""
    if not samples:
        return None
    rng = np.random.default_rng(seed)
    langs = sorted({s[0] for s in samples})
    y = np.array([langs.index(s[0]) for s in samples])
    seg = np.full((len(samples), SEGMENT), 32, np.uint8)
    mask = np.zeros((len(samples), SEGMENT), np.float32)
    for i, (_, raw) in enumerate(samples):
        seg[i, : len(raw)] = np.frombuffer(raw, np.uint8)
        mask[i, : len(raw)] = 1
    n = len(langs)
    net = Network(
        langs,
        rng.normal(0, 0.3, (2, 256, 2 * HIDDEN)).astype(np.float32), rng.normal(0, 0.3, (2, HIDDEN, 2 * HIDDEN)).astype(np.float32),
        rng.normal(0, 0.3, (2 * HIDDEN, n)).astype(np.float32), np.zeros(n, np.float32),
    )
    net.table[:, :, :HIDDEN] -= 1  # gates start nearly closed: states remember
    parts = [net.table, net.state, net.head, net.bias]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    groups = [np.flatnonzero(y == k) for k in range(n)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(g, -(-batch // n)) for g in groups])  # every language alike
        grads = _gradients(net, seg[pick].T, mask[pick].T, y[pick])
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, a, b in zip(parts, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def sampled(h: Column, lang: Column, counts: dict[str, int], max_docs: int) -> Column:
    """Whether a document with hash ``h`` is among about ``max_docs`` of its language."""
    return F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), hash_below(h, max_docs / n))]), lang)


def sample_segments(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_docs: int = 400, per_doc: int = 12) -> list[tuple[str, bytes]]:
    """Segments at hashed places of at most about ``max_docs`` documents a language,
    at most ``per_doc`` of each: the bounds of what is learned from.  The share of a
    language is a fraction of the hash's whole range, so it does not vanish, however
    many documents there are."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.length(text_col) > 0))
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}  # one row a language
    if not counts:
        return []
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit("langid"))
    picked = known.where(sampled(h, F.col(lang_col), counts, max_docs)).select(F.col(lang_col).alias("lang"), h.alias("h"), F.col(text_col).alias("text"))

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for lang, seed, text in pdf.itertuples(index=False):
                raw = text.encode()
                rng = np.random.default_rng(seed & 0x7FFFFFFFFFFFFFFF)
                for _ in range(min(per_doc, 1 + len(raw) // SEGMENT)):
                    at = int(rng.integers(0, max(1, len(raw) - SEGMENT + 1)))
                    length = SEGMENT if rng.random() < 0.5 else int(rng.integers(4, SEGMENT + 1))
                    rows.append((lang, seed, raw[at : at + length]))
            yield pd.DataFrame(rows, columns=["lang", "h", "seg"])

    got = picked.mapInPandas(segments, "lang string, h long, seg binary").toLocalIterator()
    return [(r[0], bytes(r[2])) for r in sorted(got, key=lambda r: (r[0], r[1], bytes(r[2])))]


def predict_batch(net: Network | None, texts: list[bytes | None], width: int = 2048) -> tuple[list[str], list[float]]:
    """Language and pooled probability of whole texts."""
    raws = [t if t and net is not None and any(map(str.isalpha, t.decode())) else b"" for t in texts]
    pooled = np.zeros((len(raws), len(net.langs) if net is not None else 1), np.float64)
    if net is not None:
        size = np.array([len(r) for r in raws])
        segs = -(-size // SEGMENT)
        data = np.full(int(segs.sum()) * SEGMENT, 32, np.uint8)
        first = np.concatenate([[0], np.cumsum(segs)])
        for i, r in enumerate(raws):
            data[first[i] * SEGMENT : first[i] * SEGMENT + len(r)] = np.frombuffer(r, np.uint8)
        owner = np.repeat(np.arange(len(raws)), segs)
        length = np.minimum(size[owner] - (np.arange(len(owner)) - first[owner]) * SEGMENT, SEGMENT)
        data = data.reshape(-1, SEGMENT)
        for at in range(0, len(data), width):
            p = net.probabilities(np.ascontiguousarray(data[at : at + width].T))
            n = length[at : at + width]
            if n.min() < SEGMENT:
                p *= (np.arange(SEGMENT)[:, None] < n[None, :])[:, :, None]
            np.add.at(pooled, owner[at : at + width], p.sum(axis=0))
        pooled /= np.maximum(size, 1)[:, None]
    best = pooled.argmax(axis=1)
    return [net.langs[b] if r else UND for b, r in zip(best, raws, strict=True)] if net is not None else [UND] * len(raws), [float(min(1.0, pooled[i, b])) if r else 0.0 for i, (b, r) in enumerate(zip(best, raws, strict=True))]


def identify(df: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``df`` plus ``lang_pred`` and ``score``."""
    df = df.drop("lang_pred", "score")
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(net)

    def label():
        return lambda texts: list(predict_batch(shared.value, texts))

    return append_columns(df, [text_col], label, "lang_pred string, score double")
