"""The thin queries ``op<N>_<name>`` and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, divergence, exact_dedup, jaccard, langid, licenses, mixing, quality, repair, shards, suffixes
from .common import append_columns, cut, read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- 1 chat formatting ---------------------------------------------------------------------------

_EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(_EXTRA, "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.format_conversations(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), chat.loss_text().alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


_ESC = rf"regexp_replace({{}}, '([<\[])(\\*)({chat._TAILS})', '\1\\\2\3', 'g')"
OP1_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
b AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS same FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESC.format('text')}) + CASE WHEN same THEN {len(chat.TURN)} ELSE length({_ESC.format('role')}) + {len(chat.ROLE) + len(chat.TEXT) + len(chat.END)} END)::BIGINT AS formatted_chars
FROM b GROUP BY conv_id
"""

# --- 2 BPE ---------------------------------------------------------------------------------------


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    digests = {
        "n_tokens": ("long", lambda ids: len(ids) // 4),
        "ids_sha256": ("string", lambda ids: hashlib.sha256(ids).hexdigest()),
        "decoded_sha256": ("string", lambda ids: hashlib.sha256(bpe.decode(ids, path).encode()).hexdigest()),
    }
    return bpe.encode_documents(read(spark, sf_dir, "documents"), path, derive=digests)


# --- 3 license scans -----------------------------------------------------------------------------


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["base"])
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    starts = F.transform("base", lambda m: m["start"])
    own = F.array_max(F.transform(F.filter("matches", lambda m: ~m["base"]), lambda m: m["fraction"]))
    return out.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.col("base")).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.greatest(F.coalesce(own, F.lit(0.0)), F.when(F.size("base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


# --- 4 decontamination ---------------------------------------------------------------------------


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.scan_benchmark(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["end_word"] - h["first_word"])
    return out.withColumn("n_hit", n_hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, i, i + least(13, len(w)) - 1) AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# --- 5 exact dedup -------------------------------------------------------------------------------


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = exact_dedup.exact_groups(docs, digest="text_sha256")
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


OP5_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

# --- 6 quality -----------------------------------------------------------------------------------


def quality_model(spark: SparkSession, sf_dir: str) -> quality.OrdinalModel:
    labelled = read(spark, sf_dir, "labels").select("doc_id", quality.grade().alias("grade"))
    return quality.train(read(spark, sf_dir, "documents").select("doc_id", "text").join(labelled, "doc_id"), grades=3)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, quality_model(spark, sf_dir)).drop("text")


# --- 7 suffix-array dedup ------------------------------------------------------------------------


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest():
        def rows(texts: list[bytes], spans: list[list[dict]]) -> list[list]:
            kept = [suffixes.kept_bytes(t, s) for t, s in zip(texts, spans, strict=True)]
            return [[len(t) for t in texts], [len(t) - len(k) for t, k in zip(texts, kept, strict=True)], [len(s) for s in spans], [hashlib.sha256(k).hexdigest() for k in kept]]

        return rows

    out = suffixes.repeated_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return append_columns(out, ["text", "spans"], digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", ["doc_id"])


# --- 8 language ID -------------------------------------------------------------------------------


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    net = langid.train_network(langid.sample_segments(docs.where(~held), "doc_id", "text", "lang"))
    out = langid.identify(docs.select("doc_id", "text", held.alias("held_out")), net)
    return out.select("doc_id", "held_out", "lang_pred", "score")


# --- 9 sharding ----------------------------------------------------------------------------------


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    small = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = shards.feistel_shards(small, tie=F.struct("size", "text_crc32"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# --- 10 n-gram Jaccard join ----------------------------------------------------------------------


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(read(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""

# --- 11 conversation structure repair ------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with the faults that the query plants by crc32 of ``conv_id:turn``."""
    blank = F.lit(" ")
    fill = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    k = F.crc32(F.concat(fill("conv_id"), F.lit(":"), fill("turn"))) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(fill("text"), "[.!?]", "")).otherwise(fill("text"))
    copies = F.when(k == 0, 0).when(k == 3, 2).otherwise(1)
    out = turns.select("conv_id", "turn", F.when(k == 4, "user").otherwise(fill("role")).alias("role"), text.alias("text"), F.array_repeat(F.lit(1), copies).alias("copies"))
    return out.withColumn("copies", F.explode("copies")).drop("copies")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = damaged(turns)
    audits = repair.audit_conversations(rows, ids=turns)

    def digest(said):
        sha = hashlib.sha256()
        for k, (role, text) in enumerate(said):
            sha.update(f"{chr(10) if k else ''}{role}:{text}".encode())
        yield [sha.hexdigest()]

    out = repair.repaired(rows, audits, digest, "repaired_sha256 string")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


#: CRC-32 of a string ``{0}``, byte by byte with a table.
_CRC_TABLE = """crc_steps AS (
  SELECT i, 0 AS k, i AS v FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS crc_tab FROM crc_steps WHERE k = 8)"""
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: xor(h >> 8, crc_tab[(xor(h, c) & 255) + 1])))"


def _least(*options: str) -> str:
    """The cheapest of structs (cost, audit, text); those that can't be are null."""
    return f"list_min(list_filter([{', '.join(options)}], lambda e: e IS NOT NULL))"


def _edit(state: str, cost: str, letter: str, said: str, when: str) -> str:
    out = f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r || {said}}}"
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {out} END"


_KEPT, _NEW = "role || ':' || text || chr(10)", "'{}:' || text || chr(10)"
_INS = {"u": "'user:' || chr(10)", "a": "'assistant:' || chr(10)"}
_E0 = "NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"
_FREE, _MORE = "NOT (f IN ('blank', 'duplicate'))", "CASE WHEN f = 'truncated' THEN 3 ELSE 0 END"
_TO_U = [_edit(s, _MORE, "K", _KEPT, f"{_FREE} AND ini = 'u'") for s in ("s0", "s1", "s3")] + [_edit(s, f"3 + {_MORE}", "R", _NEW.format("user"), _FREE) for s in ("s0", "s1", "s3")]
_TO_A = [_edit("s2", _MORE, "K", _KEPT, f"{_FREE} AND ini = 'a'"), _edit("s2", f"3 + {_MORE}", "R", _NEW.format("assistant"), _FREE)]
_GONE = lambda s: _edit(s, "4", "D", "''", "true")
_CLOSED = f"""SELECT conv_id, i, n0 AS s0, n1 AS s1, {_least('n2', _edit('n0', '3', 'I', _INS['u'], 'true'), _edit('n1', '3', 'I', _INS['u'], 'true'), _edit('n3', '3', 'I', _INS['u'], 'true'))} AS s2,
    {_least('n3', _edit('n2', '3', 'I', _INS['a'], 'true'), _edit('n0', '6', 'II', f"{_INS['u']} || {_INS['a']}", 'true'), _edit('n1', '6', 'II', f"{_INS['u']} || {_INS['a']}", 'true'))} AS s3"""
OP11_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS k
  FROM conversations, crc_table),
d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM c WHERE k <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, left(role, 1) AS ini,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS e FROM d),
q AS (
  SELECT *, CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN e NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS f,
    CASE WHEN i > 1 THEN lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini NOT IN ('su', 'ua', 'au') ELSE false END AS bad FROM o),
t AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate,
    count(*) FILTER (f = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal, count(*) AS rows FROM q GROUP BY conv_id),
z AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS n0, {_E0} AS n1, {_E0} AS n2, {_E0} AS n3 FROM q),
w AS (
  {_CLOSED} FROM z
  UNION ALL
  {_CLOSED} FROM (
    SELECT w.conv_id, q.i, {_least(_GONE('s0'))} AS n0, {_least(_GONE('s1'), _edit('s0', _MORE, 'K', _KEPT, f"{_FREE} AND ini = 's'"))} AS n1,
      {_least(_GONE('s2'), *_TO_U)} AS n2, {_least(_GONE('s3'), *_TO_A)} AS n3
    FROM w JOIN q ON q.conv_id IS NOT DISTINCT FROM w.conv_id AND q.i = w.i + 1)),
b AS (SELECT w.conv_id, {_least('s0', 's3')} AS e FROM w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.rows = w.i)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(left(e.r, length(e.r) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
"""

# --- 12 mixing sources ---------------------------------------------------------------------------


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    small = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    out = mixing.mix(cut(small))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


# Sources in order of limit over weight: those before the first whose limit is not above its share are fixed.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM d GROUP BY source),
o AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l, sum(w) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r,
    row_number() OVER p AS k FROM s WINDOW p AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST)),
f AS (SELECT l, r, k FROM o WHERE l * w <= 3 * source_size * r ORDER BY k LIMIT 1),
t AS (SELECT o.source, o.source_size, CASE WHEN o.k < f.k THEN (3 * o.source_size)::DOUBLE ELSE (f.l * o.w)::BIGINT::DOUBLE / f.r::DOUBLE END AS target FROM o, f),
n AS (
  SELECT doc_id, size, d.source, source_size, target, (row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) - 1)::DOUBLE AS k, coalesce(target / nullif(source_size, 0), 0) AS rate
  FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
x AS (
  SELECT *, floor(rate) + least(floor((k + 1) * (rate - floor(rate)) + u) - floor(k * (rate - floor(rate)) + u), 1) AS copies
  FROM (SELECT *, ('0x' || left(md5('12:' || j || ':' || coalesce('=' || source, '')), 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM n, range(16) t(j))),
y AS (SELECT source, j, row_number() OVER (PARTITION BY source ORDER BY abs(sum(size * copies) - any_value(target)), j) AS best FROM x GROUP BY source, j)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM x JOIN y ON y.j = x.j AND y.source IS NOT DISTINCT FROM x.source WHERE best = 1
"""

# --- 13 source divergence ------------------------------------------------------------------------


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(read(spark, sf_dir, "documents"))


_P13 = "1 + (1000000000::HUGEINT * ({0} + 1)) // nullif({1} + v, 0)"
OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
g AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(lang_total, 0) AS lang_total, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source)),
p AS (
  SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, {_P13.format('coalesce(n, 0)', 'total')} AS p, {_P13.format('lang_n', 'lang_total')} AS q
  FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_bpe": op2_bpe,
    "op3_license_scan": op3_license_scan,
    "op4_decontaminate": op4_decontaminate,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_language_id": op8_language_id,
    "op9_sharding": op9_sharding,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_source_mix": op12_source_mix,
    "op13_source_divergence": op13_source_divergence,
}
ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": OP1_SQL, "op4_decontaminate": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op10_ngram_jaccard": OP10_SQL,
    "op11_conversation_repair": OP11_SQL, "op12_source_mix": OP12_SQL, "op13_source_divergence": OP13_SQL,
}
