"""Suffix-array dedup by a common-prefix-aware distributed merge sort.

A byte goes if a string of ``LENGTH`` bytes over it starts anywhere else too.
Every such window picks one anchor: the position in it whose 32-byte hash is
smallest, so equal windows have their anchors at equal offsets, and only
suffixes at anchors need sorting (about one position in 85).  Anchors whose
32-gram occurs once are dropped.  The rest is sorted as suffixes: every task
sorts its own, front-codes the sorted runs (each entry holds the length of the
prefix shared with the entry before and the bytes after it) and sends them to
the bucket of their first 32 bytes; there a loser tree merges the runs.  The
tree compares shared-prefix lengths first and bytes only from there on, so no
known prefix is compared twice, and it yields the suffix array with its LCPs.
The bytes left of the anchors are ordered likewise.  Two windows at offset o of
their anchors are equal if the suffixes share 200 - o bytes and the left sides
o bytes; both are read off the LCPs, so the result is exact.

Equal texts are one text that occurs several times; equal entries of a task are
one entry.  The hottest case left is one passage's edge in many documents: two
entries for each document, merged in one bucket, in linear memory.

Defined results: null or empty texts have no bytes; texts shorter than the
window keep all; repeated rows are copies; equal ids with different texts are
separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import gram_hashes
from .common import append_columns, bitmap_of, cut, discard, flag_by_bitmap, small_batches

LENGTH, GRAM = 200, 32
REACH = LENGTH - GRAM  # the largest offset of an anchor in its window
_PIECE = 2_000_000
#: A task sorts this many bytes of suffixes and left sides before it sends its runs.
RUN_BYTES = 24_000_000
_POS = np.uint64((1 << 24) - 1)


def _window_anchors(buf: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows that start where ``valid``: position, hash, first and last window."""
    none = np.empty(0, np.int64)
    s = np.flatnonzero(valid)
    if not len(s):
        return none, none.astype(np.uint64), none, none
    h = gram_hashes(buf, GRAM)
    w = REACH + 1
    n = -(-len(h) // w) * w + w
    key = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    key[: len(h)] = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)  # 40 bits of hash, then leftmost
    blocks = key.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    a = (np.minimum(back[s], ahead[s + w - 1]) & _POS).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    return a[new], h[a[new]], s[new], s[np.append(new[1:], len(s)) - 1]


def anchors_of(raws: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, positions, hashes, first windows, last windows) of each text."""
    group: list[int] = []
    size = 0

    def flush() -> Iterator[tuple]:
        buf = np.frombuffer(b"".join([raws[i] for i in group]), np.uint8)
        valid = np.zeros(len(buf), bool)
        start = np.concatenate([[0], np.cumsum([len(raws[i]) for i in group])])
        for k in range(len(group)):
            valid[start[k] : max(start[k], start[k + 1] - LENGTH + 1)] = True
        a, h, first, last = _window_anchors(buf, valid)
        at = np.searchsorted(a, start)
        for k, i in enumerate(group):
            x = slice(at[k], at[k + 1])
            if at[k + 1] > at[k]:
                yield i, a[x] - start[k], h[x], first[x] - start[k], last[x] - start[k]

    for i, raw in enumerate(raws):
        if len(raw) < LENGTH:
            continue
        if len(raw) > _PIECE:  # windows dealt to overlapping pieces; an anchor on a border joins its windows
            parts = []
            for p in range(0, len(raw) - LENGTH + 1, _PIECE):
                buf = np.frombuffer(raw[p : p + _PIECE + LENGTH - 1], np.uint8)
                valid = np.zeros(len(buf), bool)
                valid[: len(buf) - LENGTH + 1] = True
                a, h, first, last = _window_anchors(buf, valid)
                parts.append((a + p, h, first + p, last + p))
            a, h, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
            new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            yield i, a[new], h[new], first[new], last[np.append(new[1:], len(a)) - 1]
            continue
        if size + len(raw) > _PIECE and group:
            yield from flush()
            group, size = [], 0
        group.append(i)
        size += len(raw)
    if group:
        yield from flush()


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are not read."""
    n = min(len(a), len(b))
    if n <= known:
        return n
    x = int.from_bytes(a[known:n]) ^ int.from_bytes(b[known:n])
    return n - (x.bit_length() + 7) // 8


# --- front-coded runs ----------------------------------------------------------------------------


def front_code(rows: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A sorted run of (right, left, owner, position); owner 0 and position -1: several owners."""
    lcp, rest, lens, lefts, llens = bytearray(), [], bytearray(), [], bytearray()
    before = b""
    for right, left, _, _ in rows:
        k = shared_prefix(before, right)
        lcp.append(k)
        lens.append(len(right) - k)
        rest.append(right[k:])
        llens.append(len(left))
        lefts.append(left)
        before = right
    n = len(rows)
    owners = np.array([r[2] for r in rows], "<i8").tobytes() + np.array([r[3] for r in rows], "<i4").tobytes()
    return struct.pack("<I", n) + bytes(lcp) + bytes(lens) + bytes(llens) + owners + b"".join(rest) + b"".join(lefts)


def read_run(blob: bytes) -> tuple[list[bytes], bytes, list[bytes], np.ndarray, np.ndarray]:
    """Rights, LCPs inside the run, lefts, owners, positions."""
    (n,) = struct.unpack_from("<I", blob)
    at = 4
    lcp, lens, llens = blob[at : at + n], blob[at + n : at + 2 * n], blob[at + 2 * n : at + 3 * n]
    at += 3 * n
    owner, pos = np.frombuffer(blob, "<i8", n, at), np.frombuffer(blob, "<i4", n, at + 8 * n)
    at += 12 * n
    rights, lefts, before = [], [], b""
    for k, m in zip(lcp, lens, strict=True):
        before = before[:k] + blob[at : at + m]
        rights.append(before)
        at += m
    for m in llens:
        lefts.append(blob[at : at + m])
        at += m
    return rights, lcp, lefts, owner, pos


def merge_runs(runs: list[tuple[list[bytes], bytes]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Loser tree over sorted runs with LCPs: (run, entry) in order, LCP with the entry before.

    A node keeps its loser and the loser's common prefix with the winner that
    went by; entries that share more with the last output are smaller, and only
    at equal lengths are bytes compared, from that length on.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    heads: list[bytes | None] = [runs[i][0][0] if i < len(runs) and runs[i][0] else None for i in range(k)]
    place, lcps = [0] * k, [0] * k  # lcps[i]: head i against the last entry that passed it
    tree = [-1] * k  # losers; tree[0] is unused

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser of two heads that have both been matched against the same entry."""
        a, b = heads[i], heads[j]
        if a is None:
            return j, i
        if b is None:
            return i, j
        x, y = lcps[i], lcps[j]
        if x > y:
            return i, j
        if y > x:
            return j, i
        m = shared_prefix(a, b, x)
        if m == len(a) or (m < len(b) and a[m] < b[m]):
            lcps[j] = m
            return i, j
        lcps[i] = m
        return j, i

    level = list(range(k))
    node = k
    while len(level) > 1:
        node //= 2
        up = []
        for t in range(0, len(level), 2):
            win, lose = play(level[t], level[t + 1])
            tree[node + t // 2] = lose
            up.append(win)
        level = up
    champion = level[0]
    order, out = [], []
    while heads[champion] is not None:
        i = champion
        rights, inner = runs[i]
        p = place[i]
        order.append((i, p))
        out.append(lcps[i])
        place[i] = p = p + 1
        if p < len(rights):
            heads[i], lcps[i] = rights[p], inner[p]
        else:
            heads[i] = None
        t = (i + k) // 2
        while t:
            lose = tree[t]
            win, tree[t] = play(i, lose)
            i = win
            t //= 2
        champion = i
    return order, out


# --- which windows are repeated ------------------------------------------------------------------


def _classes(lcp: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Class of each entry: neighbours in ``order`` sharing ``least`` bytes are alike."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(lcp < least)
    return out


def repeated_offsets(rights: list[bytes], lcp: np.ndarray, lefts: list[bytes], many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest anchor offset of a repeated window for each entry, in
    suffix order; (REACH + 1, -1) where there is none."""
    n = len(rights)
    low, high = np.full(n, REACH + 1), np.full(n, -1)
    if not n:
        return low, high
    rlen, llen = np.array([len(r) for r in rights]), np.array([len(x) for x in lefts])
    by_left = sorted(range(n), key=lefts.__getitem__)
    llcp = np.array([0] + [shared_prefix(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:], strict=False)])
    by_left, by_right = np.array(by_left), np.arange(n)
    weight = np.where(many, 2, 1)
    for o in range(REACH + 1):
        live = np.flatnonzero((llen >= o) & (rlen >= LENGTH - o))
        if len(live) < 2 and not many[live].any():
            continue
        key = _classes(llcp, by_left, o)[live] * (n + 1) + _classes(lcp, by_right, LENGTH - o)[live]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        count = np.add.reduceat(weight[live][order], first)
        hit = live[order[np.repeat(count > 1, np.diff(np.append(first, len(order))))]]
        low[hit] = np.minimum(low[hit], o)
        high[hit] = o
    return low, high


def _merge_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spans (owner, start, end) of repeated windows of one bucket."""
    done = [np.frombuffer(b, "<i8").reshape(-1, 3) for b in pdf["done"] if b]
    runs = [read_run(b) for b in pdf["run"] if b]
    order, lcp = merge_runs([(r[0], r[1]) for r in runs])
    if order:
        rights, lefts = [runs[i][0][p] for i, p in order], [runs[i][2][p] for i, p in order]
        owner, pos = np.array([runs[i][3][p] for i, p in order]), np.array([runs[i][4][p] for i, p in order], np.int64)
        many = pos < 0
        low, high = repeated_offsets(rights, np.array(lcp), lefts, many)
        hit = (high >= 0) & ~many
        done.append(np.stack([owner[hit], pos[hit] - high[hit], pos[hit] - low[hit] + LENGTH], axis=1))
    out = np.concatenate(done) if done else np.empty((0, 3), np.int64)
    return pd.DataFrame({"r": out[:, 0], "start": out[:, 1], "end": out[:, 2]})


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted or unsorted spans; touching ones join."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_per_bucket: int = 8_000_000) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``text`` (binary) and ``spans``
    (array of start, end in bytes: the maximal runs to remove)."""
    small_batches(df.sparkSession)
    raw = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(F.col(id_col).alias("id"), raw.cast("binary").alias("text"), F.xxhash64(raw).alias("k1"), F.xxhash64(F.lit(1), raw).alias("k2"))
    base = base.withColumn("r", F.xxhash64(F.col("id").cast("string"), "k1", "k2"))
    copies = cut(base.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("r").alias("rep"), F.max(F.octet_length("text")).alias("bytes")))
    total = copies.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(16, -(-int(total) // bytes_per_bucket))

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            r = pdf["r"].to_numpy()
            rows = []
            for i, a, h, _, _ in anchors_of(list(pdf["text"])):
                order = np.argsort(h, kind="stable")  # periodic texts have one anchor many times: one row
                first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
                rows += [(r[i], x, at) for x, at in zip(h[order][first].astype(np.int64).tolist(), np.split(a[order].astype(np.int32), first[1:]), strict=True)]
            yield pd.DataFrame(rows, columns=["r", "h", "ats"])

    texts = flag_by_bitmap(base.select("r", "text"), F.col("r"), bitmap_of(copies, F.col("rep")), "rep").where("rep").select("r", "text")
    # One shuffle serves the count and the join, as both read the same columns.  A text
    # has one row for each of its many anchors, so the hottest anchor has a small share.
    found = texts.mapInPandas(anchors, "r long, h long, ats array<int>").repartition("h")
    again = found.groupBy("h").agg(F.sum(F.size("ats")).alias("c"), F.min("r").alias("r0")).where("c > 1 and r0 is not null").select("h")
    wanted = found.join(again, "h").groupBy("r").agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"))
    wanted = cut(wanted.join(copies.select(F.col("rep").alias("r"), "k1", "k2"), "r"))

    def sorted_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["bucket", "run", "done"]
        last_r = None
        entries: dict[int, dict[tuple[bytes, bytes], tuple[int, int]]] = {}
        done: dict[int, list[tuple[int, int, int]]] = {}
        size = 0

        def runs_of() -> pd.DataFrame:
            rows = []
            for x, one in entries.items():
                run = front_code(sorted((*k, *v) for k, v in one.items()))
                rows.append((x, run, np.array(done[x], "<i8").tobytes() if x in done else b""))
            return pd.DataFrame(rows, columns=columns)

        for pdf in batches:
            keep = []
            for i, r in enumerate(pdf["r"]):  # repeated rows come together: take one
                if r != last_r:
                    keep.append(i)
                last_r = r
            pdf = pdf.iloc[keep]
            raws, rs, ats = list(pdf["text"]), pdf["r"].to_numpy(), list(pdf["ats"])
            for i, a, h, first, last in anchors_of(raws):
                raw, r = raws[i], int(rs[i])
                pick = np.isin(a, ats[i])
                for p, x, f, z in zip(a[pick].tolist(), (h[pick] % np.uint64(buckets)).tolist(), first[pick].tolist(), last[pick].tolist(), strict=True):
                    one = entries.setdefault(x, {})
                    key = (raw[p : z + LENGTH], raw[f:p][::-1])
                    if key not in one:
                        one[key] = (r, p)
                        size += len(key[0]) + len(key[1])
                        continue
                    # The whole context again in this task: all its windows are repeated.
                    spans = done.setdefault(x, [])
                    if one[key][1] >= 0:
                        r0, p0 = one[key]
                        spans.append((r0, p0 - len(key[1]), p0 + len(key[0])))
                        one[key] = (0, -1)
                    spans.append((r, f, z + LENGTH))
            if size > RUN_BYTES:
                yield runs_of()
                entries, done, size = {}, {}, 0
        yield runs_of()

    keyed = ["r", "k1", "k2"]
    runs = base.join(wanted, keyed).select("r", "text", "ats").mapInPandas(sorted_runs, "bucket int, run binary, done binary")
    spans = runs.groupBy("bucket").applyInPandas(_merge_bucket, "r long, start long, end long")
    per_text = spans.groupBy("r").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    # Texts with copies or spans; the others are not moved.
    result = copies.join(per_text, copies["rep"] == per_text["r"], "left").where(f"spans is not null or n > 1 and bytes >= {LENGTH}")
    result = cut(result.select("k1", "k2", "n", F.when(F.col("n") == 1, F.col("spans")).alias("found")))
    discard(wanted)
    marked = flag_by_bitmap(base, F.xxhash64("k1", "k2"), bitmap_of(result, F.xxhash64("k1", "k2")), "hit")
    moved = marked.where("hit").drop("hit")
    plan = moved.select(*keyed).distinct().join(result, ["k1", "k2"])

    def joined():
        def one(text: bytes, n: int | None, found: list[dict] | None) -> list[dict]:
            if n is None:
                return []
            if n > 1:
                return [{"start": 0, "end": len(text)}] if len(text) >= LENGTH else []
            return [{"start": s, "end": e} for s, e in union_of([(x["start"], x["end"]) for x in found or ()])]

        return lambda *columns: [[one(*row) for row in zip(*columns, strict=True)]]

    spans_t = "spans array<struct<start:long,end:long>>"
    done = append_columns(moved.join(plan, keyed, "left").select("id", "text", "n", "found"), ["text", "n", "found"], joined, spans_t, ["id", "text"])
    still = marked.where("not hit").select("id", "text", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))
    return done.unionByName(still).withColumnRenamed("id", id_col)


def kept_bytes(text: bytes, spans: list) -> bytes:
    """``text`` without its spans."""
    out, at = [], 0
    for x in spans:
        out.append(text[at : x["start"]])
        at = x["end"]
    return b"".join([*out, text[at:]])
