"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut into chunks where a rolling hash says so, hence a passage shared
by documents is cut alike in all of them.  A chunk that occurs in several texts
is encoded once and its token ids are joined back; the rest is encoded where it
is read.  Joins are then repaired: the text between the last white space of the
left chunk and the first of the right one, which tokens may cross, is encoded
again; where a chunk has no white space the re-encoded stretch grows over it.
White space is dropped by this tokenizer and never inside a token, so there the
joined ids agree exactly with those of the whole text.

Which chunks are shared travels as a bitmap of constant size; it may call a few
lone chunks shared, which costs a detour and changes no result.

Defined results: null or empty text has no tokens; repeated rows and equal ids
are separate rows (pieces are keyed by the text's hash, not by an id); an empty
table gives no rows; other columns of the input are dropped.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import cuts
from .common import BITMAP_ROW_BITS, append_columns, bitmap_of, cut, flag_by_bitmap, forgettable, small_batches, tidied

#: Words and pieces of words remembered per worker in each of two generations
#: (some 50 MB when all are full); longer ones are not kept.
MEMO_WORDS, MEMO_PIECES, MEMO_BYTES = 120_000, 60_000, 64
BITMAP_ROWS = 1024
#: Shared chunks that a task remembers to have sent.
SEEN = 200_000


#: Words whose normal form and pieces plain Python knows for certain: printable
#: ASCII and the letters of Latin-1.  All others go through the whole library.
_PLAIN = re.compile(rb"(?:[\x21-\x7e]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_LETTER = "a-z\u00df-\u00f6\u00f8-\u00ff"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^{_LETTER}0-9]+")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes: visible Latin-1 ones for themselves, the
    others numbered from U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


#: The normalising and splitting that :class:`Encoder` reproduces.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def check_file(path: str) -> None:
    """Refuse a tokenizer that normalises, splits or decodes in another way: texts
    could not be cut at its white space, and words not be split here."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    added = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in told["added_tokens"])
    if told["normalizer"] != NORMALIZER or told["pre_tokenizer"] != SPLITTER or told["decoder"] is not None or not added or told["model"]["dropout"]:
        raise ValueError(f"{path}: a tokenizer of another kind")


class Memo:
    """Token ids by word in two generations: a full one becomes the older one, and
    what is asked for again moves to the newer, so that frequent words stay."""

    def __init__(self, most: int):
        self.most = most
        self.newer: dict = {}
        self.older: dict = {}

    def keep(self, word: bytes | str, ids: bytes) -> bytes:
        if len(word) <= MEMO_BYTES:
            if len(self.newer) >= self.most:
                self.newer, self.older = {}, self.newer
            self.newer[word] = ids
        return ids

    def get(self, word: bytes | str) -> bytes | None:
        ids = self.newer.get(word)
        if ids is None and (ids := self.older.get(word)) is not None:
            self.keep(word, ids)
        return ids


class Encoder:
    """Encodes texts word by word with a bounded memory of words.

    The tokenizer works on pieces of words; a word's pieces and their merges do
    not depend on its neighbours.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        check_file(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.words, self.pieces = Memo(MEMO_WORDS), Memo(MEMO_PIECES)

    def _piece(self, text: str) -> bytes:
        if (known := self.pieces.get(text)) is not None:
            return known
        shown = text if text.isascii() else "".join([self.letters[b] for b in text.encode()])
        ids = [t.id for t in self.model.tokenize(shown)]
        return self.pieces.keep(text, struct.pack(f"<{len(ids)}I", *ids))

    def _word(self, word: bytes) -> bytes:
        if (known := self.words.get(word)) is not None:
            return known
        if word.isalpha():  # of bytes: ASCII letters only, a single piece
            ids = self._piece(word.decode().lower())
        elif b"<|" in word or not _PLAIN.fullmatch(word):
            told = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
            ids = struct.pack(f"<{len(told)}I", *told)
        else:
            ids = b"".join([self._piece(p) for p in _PIECES.findall(word.decode().lower())])
        return self.words.keep(word, ids)

    def encode(self, raw: bytes) -> bytes:
        """Ids of a UTF-8 text as little-endian unsigned 32-bit integers."""
        words = raw.split()  # bytes: ASCII white space only, at which a text may always be cut
        out = list(map(self.words.newer.get, words))
        for n, ids in enumerate(out):
            if ids is None:
                out[n] = self._word(words[n])
        return b"".join(out)


@forgettable
@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@forgettable
@lru_cache(maxsize=1)
def vocabulary(path: str) -> list[str]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [t.id_to_token(i) for i in range(t.get_vocab_size(with_added_tokens=True))]


def decode(ids: bytes, path: str) -> str:
    """The tokenizer file has no decoder (:func:`check_file`): tokens are joined by one space."""
    v = vocabulary(path)
    return " ".join([v[i] for i in np.frombuffer(ids, "<u4").tolist()])


_SPACES = b" \t\n\x0b\x0c\r"
_EACH = [_SPACES[i : i + 1] for i in range(len(_SPACES))]
_SPACE = re.compile(rb"[ \t-\r]")


def split_safe(raw: bytes) -> tuple[bytes, bytes, bytes] | None:
    """(head, body, tail) at the first and last white space; None without any."""
    if (found := _SPACE.search(raw)) is None:
        return None
    first, last = found.start(), len(raw.rstrip(_SPACES)) if raw[-1] in _SPACES else max(raw.rfind(s) for s in _EACH) + 1
    return raw[:first], raw[first:last], raw[last:]


def piece(raw: bytes, enc: Encoder) -> tuple[bytes, bytes | None, bytes]:
    """A chunk as (head text, body ids, tail text); no white space: (all, None, '')."""
    parts = split_safe(raw)
    return (raw, None, b"") if parts is None else (parts[0], enc.encode(parts[1]), parts[2])


def repair(pieces: list[tuple[bytes, bytes | None, bytes]], enc: Encoder) -> bytes:
    """Ids of the whole text from its pieces in order."""
    out, open_text = [], b""
    for head, body, tail in pieces:
        open_text += head
        if body is not None:
            out += [enc.encode(open_text), body]
            open_text = tail
    return b"".join([*out, enc.encode(open_text)])


def _key(raw: bytes) -> tuple[int, int]:
    """128-bit hash as two signed longs."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(raw))


class Shared:
    """The bitmap of shared chunks: at most ``BITMAP_ROWS`` rows of 4 KB."""

    def __init__(self, rows: dict[int, bytes]):
        self.rows = rows

    def __contains__(self, key: int) -> bool:
        at = key % (BITMAP_ROWS * BITMAP_ROW_BITS)
        bits = self.rows.get(at // BITMAP_ROW_BITS)
        bit = at % BITMAP_ROW_BITS
        return bits is not None and bool(bits[bit >> 3] >> (bit & 7) & 1)


def _chunks(raw: bytes) -> Iterator[bytes]:
    at = 0
    for end in cuts(raw):
        yield raw[at:end]
        at = end


#: Rows that pass between the tasks: places of chunks, shared chunks, encoded ones.
HASHED = pa.schema({"k1": pa.int64(), "k2": pa.int64(), "seq": pa.int32(), "h1": pa.int64(), "h2": pa.int64()})
CHUNKS = pa.schema({"h1": pa.int64(), "h2": pa.int64(), "chunk": pa.binary()})
PIECES = pa.schema({"h1": pa.int64(), "h2": pa.int64(), "head": pa.binary(), "body": pa.binary(), "tail": pa.binary()})


def _raws(batch: pa.RecordBatch) -> list[bytes]:
    """Texts of the only column as UTF-8, null as empty."""
    return [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", derive: dict[str, tuple[str, Callable[[bytes], object]]] | None = None) -> DataFrame:
    """One row per row of ``df``: ``id_col`` and ``ids`` (binary, unsigned
    32-bit little-endian); or, with ``derive`` (name -> SQL type and a function of
    the ids), those columns instead, made in the task that has the ids at hand."""
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    derive = derive or {"ids": ("binary", bytes)}
    result = ", ".join(f"{name} {t}" for name, (t, _) in derive.items())

    def finished(ids: list[bytes | None]) -> list[list]:
        return [[None if i is None else f(i) for i in ids] for _, f in derive.values()]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in _raws(batch):
                k = _key(raw)
                rows += [(*k, n, *_key(c)) for n, c in enumerate(_chunks(raw))]
            yield _batch(rows, HASHED)

    where = "k1 long, k2 long, seq int, h1 long, h2 long"
    places = cut(docs.select("text").mapInArrow(tidied(hashed), where))
    again = places.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    bitmap = bitmap_of(again, F.col("h1"), BITMAP_ROWS)
    bits = {r["bm_row"]: bytes(r["bm_bits"]) for r in bitmap.collect()}  # 4 MB at most
    shared = spark.sparkContext.broadcast(bits)

    def chunk_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Shared(shared.value), set()
        for batch in batches:
            rows = []
            for raw in _raws(batch):
                for c in _chunks(raw):
                    k = _key(c)
                    if k[0] in known and k not in seen:
                        if len(seen) > SEEN:  # forgetting costs a row sent twice
                            seen.clear()
                        seen.add(k)
                        rows.append((*k, c))
            yield _batch(rows, CHUNKS)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows = [(a, b, *piece(c, enc)) for a, b, c in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield _batch(rows, PIECES)

    once = docs.select("text").mapInArrow(tidied(chunk_texts), "h1 long, h2 long, chunk binary").groupBy("h1", "h2").agg(F.first("chunk").alias("chunk"))
    pieces = once.mapInArrow(tidied(encoded), "h1 long, h2 long, head binary, body binary, tail binary")

    def whole():
        """Texts without shared chunks, encoded where they are read."""
        known, enc = Shared(shared.value), encoder(path)

        def rows(texts: list[bytes | None]) -> list[list]:
            lone = [not any(_key(c)[0] in known for c in _chunks(t or b"")) for t in texts]
            return [lone, *finished([enc.encode(t or b"") if x else None for t, x in zip(texts, lone, strict=True)])]

        return rows

    def own():
        """Of the other texts, the runs of chunks that no other text has."""
        known, enc = Shared(shared.value), encoder(path)

        def one(raw: bytes) -> list[dict] | None:
            runs, begin, at, first, lone = [], 0, 0, 0, True
            for n, c in enumerate(_chunks(raw)):
                if _key(c)[0] in known:
                    if at > begin:
                        runs.append((first, raw[begin:at]))
                    begin, first, lone = at + len(c), n + 1, False
                at += len(c)
            if lone:
                return None
            if at > begin:
                runs.append((first, raw[begin:at]))
            return [dict(zip(("seq", "head", "body", "tail"), (n, *piece(r, enc)), strict=True)) for n, r in runs]

        def rows(texts: list[bytes | None]) -> list[list]:
            raws = [t or b"" for t in texts]
            keys = [_key(r) for r in raws]
            return [[k for k, _ in keys], [k for _, k in keys], [one(r) for r in raws]]

        return rows

    part = "struct<seq:int,head:binary,body:binary,tail:binary>"
    alone = append_columns(docs, ["text"], whole, f"lone boolean, {result}", ["id"]).where("lone").drop("lone")
    mine = append_columns(docs, ["text"], own, f"k1 long, k2 long, own array<{part}>", ["id"]).where("own is not null")

    # Ids of shared chunks, once per distinct text that needs them.
    refs = flag_by_bitmap(places, F.col("h1"), bitmap, "shared", BITMAP_ROWS).where("shared").dropDuplicates(["k1", "k2", "seq"])
    given = refs.join(pieces, ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("seq", "head", "body", "tail")).alias("given"))
    joined = mine.join(given, ["k1", "k2"], "left")

    def assemble():
        enc = encoder(path)

        def rows(own: list[list[dict]], given: list[list[dict] | None]) -> list[list]:
            parts = [sorted([*a, *(b or ())], key=lambda p: p["seq"]) for a, b in zip(own, given, strict=True)]
            return finished([repair([(p["head"], p["body"], p["tail"]) for p in x], enc) for x in parts])

        return rows

    done = append_columns(joined, ["own", "given"], assemble, result, ["id"])
    return alone.unionByName(done).withColumnRenamed("id", id_col)
