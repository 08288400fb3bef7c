"""Quality classifier: ordinal cumulative-link regression on hashed text.

One weight vector over hashed tokens is shared by all grades; ordered
thresholds turn the score s into P(grade <= k) = sigmoid(theta_k - s).  The
model gives the expected grade and the tail probability P(grade >= keep_from),
by which documents are selected.

Trained in numpy on at most ``max_rows`` labelled rows (a documented bound, the
rows with the smallest hash of their id); only hashed counts of those rows
reach the driver.  Every row of the table is scored on its whole text.

Defined results: a null or empty text has no features and gets the prior; null
grades are not trained on; rows labelled twice count twice; without any
labelled row the prior is uniform; an empty table gives no rows; other columns
are kept, but for those named like the result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, hash_below, small_batches

BUCKETS = 1 << 18
TOKEN = re.compile(r"\w+|[^\w\s]+")
_MEMO: dict[str, tuple[int, int]] = {}


def _buckets(token: str) -> tuple[int, int]:
    """Buckets of the token and of its first four letters."""
    got = _MEMO.get(token)
    if got is None:
        if len(_MEMO) > 300_000:
            _MEMO.clear()
        got = _MEMO[token] = (zlib.crc32(token.encode()) % BUCKETS, zlib.crc32(b"^" + token[:4].encode()) % BUCKETS)
    return got


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text; the root mean square of token values is fixed,
    so that one telling word counts alike in short and long texts."""
    if not text:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    counts = Counter(TOKEN.findall(text))
    if not counts:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    low: Counter[str] = Counter()
    for w, n in counts.items():
        low[w.lower()] += n
    pairs = np.array([_buckets(w) for w in low], np.int32)
    value = np.log1p(np.fromiter(low.values(), np.float32, len(low)))
    total = sum(counts.values())
    shout = sum(n for w, n in counts.items() if w.isupper() and len(w) > 1) / total
    # Dense facts about the whole text, in buckets of their own.
    facts = np.array([shout, 1 - len(low) / total, 1 / (1 + total / 20)], np.float32)
    value *= 0.27 / np.sqrt((value * value).mean())
    return np.concatenate([pairs[:, 0], pairs[:, 1], np.array([1, 2, 3], np.int32)]), np.concatenate([value, 0.5 * value, facts])


@dataclass
class OrdinalModel:
    weights: np.ndarray  # BUCKETS floats, the same for all grades
    thresholds: np.ndarray  # ascending, one fewer than grades

    def score(self, text: str | None) -> float:
        idx, val = features(text)
        return float(self.weights[idx] @ val) if len(idx) else 0.0

    def tails(self, s: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -30, 30)))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], grades: int, epochs: int = 16, batch: int = 256, rate: float = 0.5, decay: float = 1e-6, seed: int = 3) -> OrdinalModel:
    """Adagrad on the cumulative-link likelihood of (grade, buckets, values)."""
    w, acc = np.zeros(BUCKETS), np.full(BUCKETS, 1e-3)
    raw = np.concatenate([[-0.5], np.zeros(grades - 2)])  # theta_0, then logs of the gaps
    racc = np.full(grades - 1, 1e-3)
    if not rows:
        return OrdinalModel(w.astype(np.float32), np.linspace(-0.5, 0.5, grades - 1))
    rng = np.random.default_rng(seed)
    y = np.array([r[0] for r in rows])
    size = np.array([len(r[1]) for r in rows])
    at = np.concatenate([[0], np.cumsum(size)])
    idx, val = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows]).astype(np.float64)

    def thresholds() -> np.ndarray:
        return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))

    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for b in range(0, len(order), batch):
            pick = order[b : b + batch]
            take = np.concatenate([np.arange(at[i], at[i + 1]) for i in pick])
            row = np.repeat(np.arange(len(pick)), size[pick])
            i, v = idx[take], val[take]
            s = np.bincount(row, weights=w[i] * v, minlength=len(pick))
            th, k = thresholds(), y[pick]
            up, lo = np.append(th, np.inf)[k], np.insert(th, 0, -np.inf)[k]
            pu, pl = np.where(np.isinf(up), 1.0, sig(up - s)), np.where(np.isinf(lo), 0.0, sig(lo - s))
            p = np.maximum(pu - pl, 1e-9)
            du, dl = pu * (1 - pu), pl * (1 - pl)
            ds = (du - dl) / p
            g = np.bincount(i, weights=ds[row] * v, minlength=BUCKETS) / len(pick)
            on = np.flatnonzero(g)
            g = g[on] + decay * w[on]
            acc[on] += g * g
            w[on] -= rate * g / np.sqrt(acc[on])
            dth = np.array([(-(du / p) * (k == j) + (dl / p) * (k == j + 1)).mean() for j in range(grades - 1)])
            draw = np.array([dth[j:].sum() * (1 if j == 0 else np.exp(raw[j])) for j in range(grades - 1)])
            racc += draw * draw
            raw -= 0.2 * draw / np.sqrt(racc)
    return OrdinalModel(w.astype(np.float32), thresholds())


def train(labelled: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", max_rows: int = 10_000) -> OrdinalModel:
    """Fit on at most ``max_rows`` rows of ``labelled``, chosen by a hash of the id."""
    sample = labelled.where(F.col(grade_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(grade_col).cast("int").alias("g"), F.col(text_col).alias("text"))
    n = sample.count()
    if n > max_rows:  # a threshold on the hash keeps texts from being sorted
        sample = sample.where(hash_below(F.col("h"), 1.1 * max_rows / n))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"h": pdf["h"], "g": pdf["g"], "idx": [i.astype("<i4").tobytes() for i, _ in got], "val": [v.astype("<f4").tobytes() for _, v in got]})

    rows = sample.mapInPandas(hashed, "h long, g int, idx binary, val binary").toLocalIterator()
    rows = sorted(((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in rows), key=lambda r: r[:2])[:max_rows]
    return fit([(min(max(g, 0), grades - 1), np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4")) for _, g, i, v in rows], grades)


def classify(df: DataFrame, model: OrdinalModel, text_col: str = "text", keep_from: int = 2, at_least: float = 0.5) -> DataFrame:
    """``df`` plus ``expected_grade``, ``tail_prob`` = P(grade >= keep_from), ``kept``."""
    df = df.drop("expected_grade", "tail_prob", "kept")
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score():
        m = shared.value

        def rows(texts: list[bytes | None]) -> list:
            tails = m.tails(np.array([m.score(t and t.decode()) for t in texts], float))
            tail = tails[:, keep_from - 1]
            return [tails.sum(axis=1), tail, tail >= at_least]

        return rows

    return append_columns(df, [text_col], score, "expected_grade double, tail_prob double, kept boolean")


def grade(quality: str = "quality", toxic: str = "toxic"):
    """Grades of the labels: 0 toxic, 1 poor, 2 good and clean."""
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when(F.col(quality) == 1, 2)
