"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are scanned once.  Test items are cut into windows of ``window`` words
(an item with fewer words, but not none, is one window); the automaton is built
over word numbers, so a match can only start and end at words.  Matches give
word spans, mapped back to character offsets of the original text.

Words: A-Z lower-cased, maximal runs outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.

There is one automaton, and one scan, whatever the size of the benchmark, up to
``most_bytes`` of item texts (some 60 bytes of automaton for one of text, once a
worker); beyond that the call is refused, and ``blocks`` says into how many
automata, one scan each, the items shall be dealt.

Defined results: null or empty texts have no words and no hits; items without
words match nothing; items with equal texts are all reported; repeated rows are
separate rows; an empty table on either side gives rows without hits, or none;
other columns of the documents are kept, but for those named like the result.
"""

from __future__ import annotations

import re
import uuid
import ahocorasick
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, cut, fresh, small_batches

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: One byte pass that lower-cases A-Z and turns every separator into a space.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 32 if (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F) else b for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    return _raw(text).translate(_TABLE).split() if text else []


def _raw(text: str | bytes) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text


class Scanner:
    """Automaton over the windows of items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.number: dict[bytes, int] = {}
        self.windows: list[tuple[int, list[int]]] = []  # length, places in self.ids
        self.ids = [None if i is None else str(i) for i, _ in items]
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        seen: dict[tuple[int, ...], int] = {}
        for place, (_, text) in enumerate(items):
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            n = min(window, len(words))
            for i in range(len(words) - n + 1 if n else 0):
                key = tuple(words[i : i + n])
                if key not in seen:
                    seen[key] = len(self.windows)
                    self.windows.append((n, []))
                    self.auto.add_word(key, seen[key])
                if place not in (owners := self.windows[seen[key]][1])[-1:]:
                    owners.append(place)
        if seen:
            self.auto.make_automaton()
        self.empty = not seen

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged spans of hit words [start, end), and the ids of items found."""
        if self.empty or not words:
            return [], set()
        get = self.number.get
        key = tuple([get(w, 0) for w in words])
        spans: list[list[int]] = []
        items: set[str | None] = set()
        for end, k in self.auto.iter(key):
            n, owners = self.windows[k]
            start = end + 1 - n
            while spans and spans[-1][0] >= start:  # shorter windows can begin before longer ones that ended earlier
                spans.pop()
            if spans and spans[-1][1] >= start:
                spans[-1][1] = end + 1
            else:
                spans.append([start, end + 1])
            items.update(self.ids[p] for p in owners)
        return [(a, b) for a, b in spans], items


def char_spans(text: str | bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans as character offsets of the original text."""
    raw = _raw(text)
    at = [m.span() for m in WORD.finditer(raw.lower())]
    out, done, chars = [], 0, 0
    for a, b in spans:  # in order and apart, so every byte is decoded once
        start = chars + len(raw[done : at[a][0]].decode("utf-8", "surrogatepass"))
        chars, done = start + len(raw[at[a][0] : at[b - 1][1]].decode("utf-8", "surrogatepass")), at[b - 1][1]
        out.append((start, chars))
    return out


def _joined(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and out[-1][1] >= s:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


#: The worker's automaton, by the name of the scan that needs it.
_BUILT: dict[str, Scanner] = {}


def _scanner(name: str, shared: Broadcast, window: int) -> Scanner:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Scanner(shared.value, window)
    return _BUILT[name]


def scan_benchmark(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, blocks: int | None = None, most_bytes: int = 16_000_000) -> DataFrame:
    """``docs`` plus ``n_words``, ``hits`` (word spans with character offsets)
    and ``items`` (ids found, sorted as strings; a null id comes last, as null).

    Items of more than ``most_bytes`` are dealt to as many automata (``blocks``) as
    hold that much each; every automaton after the first reads the documents, and
    what is found so far, from a table that the one before wrote.
    """
    spark = docs.sparkSession
    small_batches(spark)
    size = items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = blocks or max(1, -(-2 * size // most_bytes) if size > most_bytes else 1)  # twice as many: hashed blocks differ in size
    block = fresh(items, "block")
    dealt = items.withColumn(block, F.pmod(F.xxhash64(F.col(item_id).cast("string")), F.lit(blocks)))
    out = docs.drop("n_words", "hits", "items")
    kept = out.columns
    for k in range(blocks):
        out = cut(out) if k else out
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in dealt.where(F.col(block) == k).select(item_id, item_text).toLocalIterator()])

        def scan(name: str = uuid.uuid4().hex, shared: Broadcast = shared):
            scanner = _scanner(name, shared, window)

            def rows(texts: list[bytes | None], *before: list) -> list[list]:
                n_words, hits, items = [], [], []
                for i, text in enumerate(texts):
                    words = words_of(text)
                    spans, found = scanner.scan(words)
                    if before:
                        spans = _joined(spans, [(x["first_word"], x["end_word"]) for x in before[0][i]])
                        found.update(before[1][i])
                    at = char_spans(text, spans) if spans else []
                    n_words.append(len(words))
                    hits.append([{"first_word": a, "end_word": b, "start": s, "end": e} for (a, b), (s, e) in zip(spans, at, strict=True)])
                    items.append(sorted(found, key=lambda i: (i is None, i or "")))
                return [n_words, hits, items]

            return rows

        made = "n_words long, hits array<struct<first_word:long,end_word:long,start:long,end:long>>, items array<string>"
        out = append_columns(out, [text_col, "hits", "items"] if k else [text_col], scan, made, kept)
    return out
