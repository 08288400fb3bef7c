"""Exact n-gram Jaccard join by universe-partition pigeonhole.

A document is its set of distinct word shingles.  Sets with Jaccard similarity
of 0.75 or more differ in at most (a + b) / 7 elements, and sizes lie in the
same or in neighbouring bands of ratio 4/3.  For each band the universe of
shingles is hashed into m segments.  If the larger set b has more non-empty
segments than elements may differ, one of them must be equal in both sets, so
equal segment subsets, indexed by their hash, find every pair.

Cost-based allocation: a set has to be matched on ``need`` of its segments only,
so it leaves out those whose subset is the most frequent (passages that many
documents share).  Where a set has too few non-empty segments, a few cheap
segments are matched with one deletion instead (the one-deletion neighbourhoods
are indexed in such bands alone), which covers two differences each.

Index entries travel packed, as sorted arrays in a binary per bucket of hash
values: four bytes of the hash after those that name the bucket.  Of the 2 million
entries of a bucket about one in 2,000 meets another by chance; such pairs are
verified like all others.  A record's number of entries in a bucket takes a byte.  Equal sets are one record.  Inside a group of equal subsets first only
pairs with one leader are verified and connected; what is left in different
components is compared under the allocation, inside tasks, by an exact lower
bound of the difference (parity sketches): first every record with its nearest
neighbour in another component, then, among what is still apart, with all.  Only
pairs within the bound leave a task; they are verified on their texts.  Copies and large clusters thus never expand into all pairs.

Shingles are identified by 64-bit hashes; sets by two of them: where two sets
share the first, all sets are named anew.  A subset that many records of a batch
share stays out of its bucket, so no task gathers a hot one.

Defined results: null or blank texts have the empty set and are linked with
nothing; fewer words than a shingle make one shingle; equal ids and repeated
rows are separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import append_columns, bitmap_of, cut, discard, flag_by_bitmap, release, small_batches, text_key, tidied, without_rows
from .components import connected_components

SHINGLE = 5
#: Askers, and members, of a group of equal subsets that one task takes on.
CROWD = 4_096
#: Records of one batch with a common subset from which on it is kept out of the buckets.
HOT = 64
LOOSE, NOTE = 4, 5
#: What a record does in its part of a group: it asks, is asked, or both.
ASKS, ASKED, BOTH = 1, 2, 3
_SECOND = 1 << 20  # seeds of the second hash of a set
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _C[3]
    x ^= x >> np.uint64(29)
    x = x * _C[4]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    raw = text.encode() if isinstance(text, str) else text
    words = raw.translate(_LOWER).split() if raw else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(len(w), k), np.uint64)
    for j in range(min(k, len(w))):  # a polynomial in word hashes: order counts, one mixing ends it
        h *= _C[0]
        h += w[j : j + n]
    h = _mix(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def set_id(h: np.ndarray, seed: int = 0) -> int:
    """Signed 64-bit name of a set; another one for each seed."""
    salt = np.uint64((int(_C[2]) + seed * int(_C[1])) % 2**64)
    return int(np.add.reduce(_mix(h ^ salt), dtype=np.uint64).astype(np.int64)) if len(h) else 0


@lru_cache(maxsize=1)
def band_starts() -> list[int]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(-(-out[-1] * 4 // 3))
    return out


def band(n: int) -> int:
    return int(np.searchsorted(band_starts(), n, side="right")) - 1


def need(n: int) -> int:
    """Segments on which the larger set must be matched."""
    return 2 * n // 7 + 1


def segments(zone: int) -> int:
    """Segments of a band: enough that nearly every set fills ``need`` of them."""
    return max(64, int(1.2 * need(band_starts()[zone + 1] - 1)) + 8)


def _split(h: np.ndarray, zone: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and 46-bit weight of every element."""
    deal, weigh = (np.uint64(k * int(c) % 2**64) for k, c in ((seed * 2 + 1, _C[0]), (seed, _C[1])))
    seg = ((_mix(h + deal) >> np.uint64(32)) * np.uint64(segments(zone))) >> np.uint64(32)
    return seg.astype(np.int64), (_mix(h + weigh) >> np.uint64(18)) | np.uint64(1)


def _signature(total: np.ndarray, seg: np.ndarray, zone: int, seed: int) -> np.ndarray:
    """Hash of a segment's subset; the subset's sum of weights stands for it."""
    return _mix(total.astype(np.uint64) * _C[0] + seg.astype(np.uint64) * _C[1] + np.uint64(zone * 1024 + seed))


def subset_signatures(h: np.ndarray, zone: int, seed: int) -> np.ndarray:
    """One signature for each non-empty segment."""
    seg, weight = _split(h, zone, seed)
    total = np.bincount(seg, weights=weight.astype(np.float64))  # exact: below 2**53
    at = np.flatnonzero(total)
    return _signature(total[at], at, zone, seed)


def deletion_signatures(h: np.ndarray, zone: int, seed: int) -> np.ndarray:
    """Signatures of every segment of two or more with one element left out."""
    seg, weight = _split(h, zone, seed)
    rest = np.bincount(seg, weights=weight.astype(np.float64))[seg] - weight.astype(np.float64)
    return _signature(rest[rest > 0], seg[rest > 0], zone, seed)


def filled(h: np.ndarray, seed: int) -> tuple[int, int]:
    """Non-empty segments of a set in its own band; and those of two or more."""
    if not len(h):
        return 0, 0
    count = np.bincount(_split(h, band(len(h)), seed)[0])
    return int((count > 0).sum()), int((count > 1).sum())


def sketch(h: np.ndarray) -> bytes:
    """Parity of the elements in each of 2**k cells, two to four cells an element:
    with fewer, the bound would let many pairs pass that differ by too much."""
    cells = 256
    while cells < 2 * len(h):
        cells *= 2
    odd = np.bincount((_mix(h ^ _C[4]) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def difference_bound(a: bytes, b: bytes) -> int:
    """Lower bound of the number of elements that two sketched sets differ in."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


# --- the index -----------------------------------------------------------------------------------


def _packed(sets: list[tuple[int, np.ndarray]], seed: int, bits: int, weak: frozenset[int], hot_from: int = HOT) -> Iterator[tuple]:
    """Rows (bucket, role, rids, counts, sigs) for a batch of records.

    Roles: 0 the record's own band, 1 the next band, where it is the smaller;
    with deletions 2 (own band) and 3.  A pair needs one record in its own band.
    Subsets that ``hot_from`` records of the batch share are not sent to their bucket:
    their entries stay together (role ``LOOSE``, in a bucket below 0 of the batch's
    own) and the bucket only gets a note of the subset (role ``NOTE``).
    """
    parts = []
    for role in range(4):
        own, deletion = role % 2 == 0, role > 1
        for rid, h in sets:
            zone = band(len(h)) + (0 if own else 1)
            if not deletion or zone in weak:
                s = (deletion_signatures if deletion else subset_signatures)(h, zone, seed)
                parts.append((role, rid, s))
    if not parts:
        return
    sig = np.concatenate([s for _, _, s in parts])
    size = [len(s) for _, _, s in parts]
    roles, rids = np.repeat(np.array([r for r, _, _ in parts], np.int8), size), np.repeat(np.array([i for _, i, _ in parts], np.int64), size)
    place = (sig >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sig), np.int64)
    low = (sig >> np.uint64(32 - bits)) & np.uint64((1 << 32) - 1)
    order = np.lexsort((roles, rids, low, place))
    place, low, roles, rids = place[order], low[order], roles[order], rids[order]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (place[1:] != place[:-1])])
    starts = np.flatnonzero(new)
    many = np.diff(np.append(starts, len(low))) >= hot_from
    hot = many[np.cumsum(new) - 1]
    if hot.any():
        x = np.flatnonzero(hot)
        first = np.concatenate([[True], new[x[1:]] | (rids[x[1:]] != rids[x[:-1]])])  # one entry for each record in a group
        x = x[first]
        yield -1 - int(rids[0] & 0x3FFFFFFF), LOOSE, rids[x].astype("<i8").tobytes(), (place[x] * 4 + roles[x]).astype("<i8").tobytes(), low[x].astype("<u8").tobytes()
        notes = starts[many]
        for k in np.unique(place[notes]):
            yield int(k), NOTE, b"", b"", low[notes[place[notes] == k]].astype("<u4").tobytes()
    rest = np.flatnonzero(~hot)
    rest = rest[np.lexsort((rids[rest], place[rest], roles[rest]))]
    ends = np.flatnonzero(np.concatenate([(roles[rest][1:] != roles[rest][:-1]) | (place[rest][1:] != place[rest][:-1]), [True]])) + 1 if len(rest) else []
    start = 0
    for end in ends:
        x = rest[start:end]
        docs, counts = np.unique(rids[x], return_counts=True)
        yield int(place[x[0]]), int(roles[x[0]]), docs.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), low[x].astype("<u4").tobytes()
        start = end


def _narrow(row: tuple) -> tuple:
    """A row of :func:`_packed` as it travels: a record's count is a byte, and a record with
    more than 255 entries in the bucket stands several times."""
    bucket, role, rids, counts, sigs = row
    if role in (LOOSE, NOTE):
        return row
    ids, n = np.frombuffer(rids, "<i8"), np.frombuffer(counts, "<u4").astype(np.int64)
    parts = -(-n // 255)
    each = np.full(int(parts.sum()), 255, np.uint8)
    each[np.cumsum(parts) - 1] = n - 255 * (parts - 1)
    return bucket, role, np.repeat(ids, parts).tobytes(), each.tobytes(), sigs


def _groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: the followers of each group of equal subsets (two records at
    least, one in its own band) with their leader, the smallest record in its own
    band; of subsets that are hot somewhere, all entries, without a leader."""
    bucket = int(pdf["bucket"].iloc[0])
    if bucket < 0:  # entries that met in no bucket: nothing to do but to unpack them
        rid = np.concatenate([np.frombuffer(b, "<i8") for b in pdf["rids"]])
        code = np.concatenate([np.frombuffer(b, "<i8") for b in pdf["counts"]])
        sig = np.concatenate([np.frombuffer(b, "<u8") for b in pdf["sigs"]])
        return _members(code >> 2, sig, rid, code & 3, np.ones(len(sig), bool))
    sig, rid, role, noted = [], [], [], [np.empty(0, np.uint64)]
    for r, ids, counts, sigs in zip(pdf["role"], pdf["rids"], pdf["counts"], pdf["sigs"], strict=True):
        s = np.frombuffer(sigs, "<u4").astype(np.uint64)
        if r == NOTE:
            noted.append(s)
            continue
        sig.append(s)
        rid.append(np.repeat(np.frombuffer(ids, "<i8"), np.frombuffer(counts, np.uint8)))
        role.append(np.full(len(s), r, np.int8))
    if not sig:
        return _members(*(np.empty(0, np.int64),) * 4, np.empty(0, bool))
    sig, rid, role, noted = np.concatenate(sig), np.concatenate(rid), np.concatenate(role), np.unique(np.concatenate(noted))
    order = np.argsort(sig, kind="stable")
    s = sig[order]
    same = s[1:] == s[:-1]
    live = np.isin(s, noted)
    live[1:] |= same
    live[:-1] |= same
    order = order[live]  # most subsets are found once and end here
    order = order[np.lexsort((role[order], rid[order], sig[order]))]
    sig, rid, role = sig[order], rid[order], role[order]
    lead, more, hot = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)
    if len(sig):
        first = np.ones(len(sig), bool)  # one entry for each record in a group: own band and exact subset preferred
        first[1:] = (sig[1:] != sig[:-1]) | (rid[1:] != rid[:-1])
        sig, rid, role = sig[first], rid[first], role[first]
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(starts, len(sig)))
        own = role % 2 == 0
        lead = np.repeat(np.minimum.reduceat(np.where(own, rid, np.iinfo(np.int64).max), starts), size)
        some = np.repeat((size > 1) & (np.add.reduceat(own.astype(np.int64), starts) > 0), size)
        hot, more = np.isin(sig, noted), np.repeat(size > 2, size)
        keep = hot | some & (rid != lead)
        sig, rid, role, hot, lead, more = (x[keep] for x in (sig, rid, role, hot, lead, more))
    return _members(np.full(len(sig), bucket), sig, rid, role, hot, lead, more)


def _members(bucket: np.ndarray, sig: np.ndarray, rid: np.ndarray, role: np.ndarray, hot: np.ndarray, lead: np.ndarray | int = 0, more: np.ndarray | bool = True) -> pd.DataFrame:
    return pd.DataFrame({"bucket": bucket.astype(np.int32), "sig": sig.astype(np.int64), "rid": rid, "own": role % 2 == 0, "exact": role < 2, "hot": hot, "lead": lead, "more": more})


def _likely_pairs(pdf: pd.DataFrame, nearest: bool = False) -> pd.DataFrame:
    """Pairs of an asker and a smaller member of its group, in different
    components, that sizes and sketches allow; no other pair leaves the task.
    ``nearest``: of each asker's pairs only the closest by sketch."""
    key = pdf[["bucket", "sig", "salt"]].to_numpy(np.int64)
    order = np.lexsort(key.T)
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])) if len(key) else []
    rid, n, root = (pdf[c].to_numpy(np.int64)[order] for c in ("rid", "n", "root"))
    part, sketches = pdf["part_role"].to_numpy(np.int8)[order], pdf["sketch"].to_numpy()[order]
    found = [np.empty((0, 2), np.int64)]
    for s, e in zip(starts, [*starts[1:], len(key)], strict=True):
        x, y = s + np.flatnonzero(part[s:e] != ASKED), s + np.flatnonzero(part[s:e] != ASKS)
        if not len(x) or not len(y) or (root[s:e] == root[s]).all():
            continue
        least = min(map(len, sketches[s:e]))  # members of a band: at most twice that

        def folded(at: np.ndarray, least: int = least) -> np.ndarray:
            rows = []
            for b in sketches[at]:
                v = np.frombuffer(b, np.uint64)
                while len(v) * 8 > least:
                    v = v[: len(v) // 2] ^ v[len(v) // 2 :]
                rows.append(v)
            return np.stack(rows)

        fx, fy = folded(x), folded(y)
        step = max(1, 4_000_000 // (len(y) * least))
        for k in range(0, len(x), step):
            i = x[k : k + step]
            apart = np.bitwise_count(fx[k : k + step, None, :] ^ fy[None, :, :]).sum(axis=2, dtype=np.int64)
            nx, ny = n[i][:, None], n[y][None, :]
            ok = (apart <= (nx + ny) // 7) & (root[i][:, None] != root[y][None, :]) & (ny <= nx) & (4 * ny >= 3 * nx)
            if nearest:
                p = np.flatnonzero(ok.any(axis=1))
                q = np.where(ok, apart, np.iinfo(np.int64).max)[p].argmin(axis=1)
            else:
                p, q = np.nonzero(ok)
            found.append(np.sort(np.stack([rid[i[p]], rid[y[q]]], axis=1), axis=1))
    out = np.unique(np.concatenate(found), axis=0)
    return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})


def _named(stats: DataFrame, rids: DataFrame) -> DataFrame:
    """Rows of ``stats`` that ``rids`` names and a few others: only these need a shuffle."""
    return flag_by_bitmap(stats, F.xxhash64("rid"), bitmap_of(rids, F.xxhash64("rid")), "named").where("named")


def _verify(pairs: DataFrame, stats: DataFrame, docs: DataFrame, seed: int) -> DataFrame:
    """Pairs (a, b) of records that are similar, tested on their texts."""
    pairs = cut(pairs)
    info = _named(stats, pairs.select(F.explode(F.array("a", "b")).alias("rid"))).select("rid", "n", "sketch")
    left, right = (info.select(F.col("rid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}")) for x in "ab")
    sized = pairs.join(left, "a").join(right, "b").where("4 * na >= 3 * nb and 4 * nb >= 3 * na")

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [difference_bound(x, y) <= (m + n) // 7 for x, y, m, n in zip(pdf["sa"], pdf["sb"], pdf["na"], pdf["nb"], strict=True)]
            yield pdf.loc[ok, ["a", "b"]]

    likely = cut(sized.mapInPandas(tidied(bounded), "a long, b long"))
    rids = likely.select(F.col("a").alias("rid")).union(likely.select("b")).distinct()
    wanted = cut(rids.join(stats.select("rid", "rep"), "rid"))
    flagged = flag_by_bitmap(docs, F.xxhash64("id"), bitmap_of(wanted, F.xxhash64("rep")), "wanted").where("wanted").select("id", "text")
    texts = flagged.join(wanted, F.col("id").eqNullSafe(F.col("rep"))).select("rid", "text")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @lru_cache(maxsize=64)
        def parsed(text: str) -> tuple[int, np.ndarray]:
            h = shingles(text)
            return set_id(h, seed), h

        for pdf in batches:
            ok = []
            for a, b, x, y in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"], strict=True):
                (i, x), (j, y) = parsed(x), parsed(y)
                ok.append(i == a and j == b and similar(x, y))  # ids can repeat with other texts
            yield pdf.loc[ok, ["a", "b"]]

    both = likely.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("rid").alias("a"), F.col("text").alias("ta")), "a")
    found = cut(both.select("a", "b", "ta", "tb").mapInPandas(tidied(exact), "a long, b long"))
    discard(pairs, likely, wanted)
    return found


def similar_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", entries_per_bucket: int = 2_000_000, hot_from: int = HOT) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``n_shingles``, ``component_id``
    (the smallest id reachable over links, its own included)."""
    return _components(df, id_col, text_col, entries_per_bucket, hot_from).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _components(df: DataFrame, id_col: str, text_col: str, entries_per_bucket: int = 2_000_000, hot_from: int = HOT) -> DataFrame:
    small_batches(df.sparkSession)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def measured(seed: int):
        def start():
            def rows(texts: list[bytes | None]) -> list[list]:
                sets = [shingles(t) for t in texts]
                fill = [filled(h, seed) for h in sets]
                return [
                    [len(h) for h in sets], [set_id(h, seed) for h in sets], [set_id(h, seed + _SECOND) for h in sets],
                    [f for f, _ in fill], [d for _, d in fill], [sketch(h) for h in sets],
                ]

            return rows

        return append_columns(keyed, ["text"], start, "n long, rid long, rid2 long, filled long, double long, sketch binary", ["id", "key"])

    keyed = docs.select("id", text_key(F.col("text")).alias("key"), "text")
    seed = 0
    while True:
        members = cut(measured(seed))
        first = [F.first(c).alias(c) for c in ("n", "filled", "double", "sketch")]
        sets = members.where("n > 0").groupBy("rid").agg(F.min("id").alias("rep"), *first, (F.min("rid2") != F.max("rid2")).alias("clash"))
        stats = cut(sets.withColumn("need", F.floor(2 * F.col("n") / 7) + 1))
        # Deal and name anew where deletions (one for each segment of two or more) are not
        # enough, or where two sets got one name, which a second hash shows.
        if not stats.where("filled + double < need or clash").head(1):
            break
        discard(members, stats)
        seed += 1
    weak_n = [r[0] for r in stats.where("filled < need").select("n").distinct().collect()]  # sizes, a handful
    weak = frozenset(band(n) for n in weak_n)
    total = stats.agg(F.sum("n")).first()[0] or 0
    bits = min(24, max(0, (int(total) // entries_per_bucket).bit_length()))

    reps = bitmap_of(stats, F.xxhash64("rep"))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["bucket", "role", "rids", "counts", "sigs"]
        sets: dict[int, np.ndarray] = {}
        size = 0
        for pdf in batches:
            for h in map(shingles, pdf["text"]):
                if len(h) and sets.setdefault(set_id(h, seed), h) is h:
                    size += len(h)
            if size > 1_500_000:  # elements: some 12 MB of hashes for one row of each bucket
                yield pd.DataFrame(list(map(_narrow, _packed(list(sets.items()), seed, bits, weak, hot_from))), columns=columns)
                sets, size = {}, 0
        yield pd.DataFrame(list(map(_narrow, _packed(list(sets.items()), seed, bits, weak, hot_from))), columns=columns)

    # Only one text of each set is indexed; the bitmap may let a few copies through, which changes nothing.
    one_each = flag_by_bitmap(docs, F.xxhash64("id"), reps, "rep").where("rep").select("text")
    entries = one_each.mapInPandas(tidied(index), "bucket int, role int, rids binary, counts binary, sigs binary")
    groups = cut(entries.groupBy("bucket").applyInPandas(_groups, "bucket int, sig long, rid long, own boolean, exact boolean, hot boolean, lead long, more boolean"))
    release(docs.sparkSession)

    # First round: each group's leader with the others.  Hot groups were not gathered, so their leaders are found here.
    g = ["bucket", "sig"]
    hot = groups.where("hot").drop("lead")
    led = groups.where("not hot").unionByName(hot.join(hot.where("own").groupBy(*g).agg(F.min("rid").alias("lead")), g).where("rid != lead"))
    edges = _verify(led.select(F.least("rid", "lead").alias("a"), F.greatest("rid", "lead").alias("b")).distinct(), stats, docs, seed)
    roots = connected_components(edges)
    # Groups of three and more have pairs without the leader.
    followers = cut(led.where("more").select(*g, "rid", "own", "exact"))
    discard(edges, groups)

    def crossed(roots: DataFrame, nearest: bool) -> DataFrame:
        """Similar pairs in groups that still hold several components, under the allocation.

        Pairs with a group's leader are decided already, so leaders are left out here.
        """
        rooted = followers.join(roots, followers["rid"] == roots["node"], "left").select(*g, "rid", "own", "exact", F.coalesce("root", "rid").alias("root"))
        mixed = rooted.groupBy(*g).agg(F.count("*").alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select(*g, "size")
        left = rooted.join(mixed, g).join(stats.select("rid", "filled", "need"), "rid")
        rank = F.row_number().over(Window.partitionBy("rid", "own", "exact").orderBy(F.desc("size"), *g))
        # Left out: the most frequent subsets, as many as the set can spare.  Deletions are never left out.
        out = F.col("own") & F.col("exact") & (rank <= F.col("filled") - F.col("need"))
        left = cut(left.withColumn("asks", F.col("own") & ~out).select(*g, "rid", "root", "asks"))
        # Groups without an asker end here.  Large ones are split into blocks: an asker meets every block of members.
        blocks = left.groupBy(*g).agg(F.ceil(F.sum(F.col("asks").cast("long")) / CROWD).cast("int").alias("ka"), F.ceil(F.count("*") / CROWD).cast("int").alias("km"))
        held = left.join(blocks.where("ka > 0"), g)
        held = held.join(_named(stats, held.select("rid")).select("rid", "n", "sketch"), "rid")
        a, m = (F.pmod(F.xxhash64("rid", F.lit(x)), k).cast("int") for x, k in (("asks", "ka"), ("asked", "km")))
        one = F.array(F.struct(F.lit(0).alias("salt"), F.when(F.col("asks"), BOTH).otherwise(ASKED).alias("part_role")))
        asked = F.transform(F.sequence(F.lit(0), F.col("ka") - 1), lambda i: F.struct((i * F.col("km") + m).alias("salt"), F.lit(ASKED).alias("part_role")))
        asks = F.transform(F.sequence(F.lit(0), F.col("km") - 1), lambda j: F.struct((a * F.col("km") + j).alias("salt"), F.lit(ASKS).alias("part_role")))
        dealt = F.when((F.col("ka") == 1) & (F.col("km") == 1), one).when(F.col("asks"), F.concat(asked, asks)).otherwise(asked)
        parts = max(16, left.count() // 20_000)
        cross = held.select(*g, "rid", "n", "root", "sketch", F.explode(dealt).alias("d")).select(*g, "rid", "n", "root", "sketch", "d.*")
        cross = cross.withColumn("part", F.pmod(F.xxhash64(*g, "salt"), F.lit(parts)))

        def likely(pdf: pd.DataFrame) -> pd.DataFrame:
            return _likely_pairs(pdf, nearest)

        found = _verify(cross.groupBy("part").applyInPandas(likely, "a long, b long").distinct(), stats, docs, seed)
        discard(left)
        return found

    # Second round: every asker with its nearest neighbour in another component, which
    # joins what a large group of near copies left apart and keeps the last round small.
    # Last round: all pairs that are likely and still apart.
    for nearest in (True, False):
        more = crossed(roots, nearest)
        before = roots
        roots = connected_components(before.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
        discard(more, before)
    discard(followers, stats)

    named = members.join(roots, members["rid"] == roots["node"], "left").select("id", "key", "n", F.when(F.col("n") > 0, F.coalesce("root", "rid")).alias("root"))
    smallest = named.where("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    lone = named.where("root is null").select("id", "key", "n", F.col("id").alias("component_id"))
    return named.where("root is not null").join(smallest, "root").select("id", "key", "n", "component_id").unionByName(lone)


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one document (the smallest id) of each component; rows that
    repeat it and rows without an id stay too."""
    gone = _components(df, id_col, text_col).where(F.col("id") > F.col("component_id"))
    return without_rows(df, gone.select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key")), id_col, text_col)
