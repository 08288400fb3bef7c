"""Chat formatting with Spark expressions only.

Turns are collected per conversation as structs, sorted, and concatenated; which
of them are adjacent turns of one role, merged into one block, and where each
text begins, are windows over the turns.
The inverse (:func:`read_back`) is made of expressions as well.

Template of a block: ``<|role|>R<|text|>T1<|turn|>T2<|end|>`` where T1, T2 are
the merged turns.  Control strings inside roles and texts (those of the
template and of common public chat formats) are escaped by one backslash after
their first character, ``</s>`` -> ``<\\/s>``; a string that already has
backslashes there gets one more, so removing one restores every text.

Defined results: null role or text counts as empty; repeated rows are all kept;
ties on the turn number are ordered by role, then text; a null turn sorts
first; a null conversation id forms a conversation of its own; an empty table
gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLE, TEXT, TURN, END = "<|role|>", "<|text|>", "<|turn|>", "<|end|>"

# Control strings of the template above and of public chat formats.
CONTROL = (
    "<|role|>", "<|text|>", "<|turn|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|startoftext|>", "<|endoftext|>",
)

_TAILS = "|".join(sorted((t[1:].replace("|", "\\|").replace("]", "\\]") for t in CONTROL), key=len, reverse=True))
ESCAPE = (rf"([<\[])(\\*)({_TAILS})", (r"$1\\$2$3"))
UNESCAPE = (rf"([<\[])\\(\\*)({_TAILS})", r"$1$2$3")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv``, ``formatted`` and ``loss_spans``.

    ``loss_spans`` holds (start, length) in code points of ``formatted`` for each
    text of ``loss_role``.  Every turn is written out as it stands in its
    conversation, and the lengths before it are summed up, by a window; then the
    pieces are collected, sorted and joined, which is linear in the turns.  A
    conversation's turns meet in one row because the result is one string;
    nothing else is gathered.
    """
    fill = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.select(F.col(conv).alias(conv), F.col(turn).alias("turn_"), fill(role).alias("role_"), fill(text).alias("text_"))
    w = Window.partitionBy(conv).orderBy(F.asc_nulls_first("turn_"), "role_", "text_")
    first = ~F.coalesce(F.lag("role_").over(w) == F.col("role_"), F.lit(False))
    last = ~F.coalesce(F.lead("role_").over(w) == F.col("role_"), F.lit(False))
    head = F.when(first, F.concat(F.lit(ROLE), escape(F.col("role_")), F.lit(TEXT))).otherwise(F.lit(TURN))
    rows = rows.select(conv, "role_", F.row_number().over(w).alias("n"), head.alias("head"), escape(F.col("text_")).alias("said"), F.when(last, F.lit(END)).otherwise(F.lit("")).alias("tail"))
    long = lambda c: F.char_length(c).cast("long")
    rows = rows.withColumn("all", long("head") + long("said") + long("tail"))
    at = F.sum("all").over(Window.partitionBy(conv).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) - F.col("all") + long("head")
    span = F.when(F.col("role_") == loss_role, F.struct(at.alias("start"), long("said").alias("length")))
    rows = rows.select(conv, F.struct("n", F.concat("head", "said", "tail").alias("s"), span.alias("span")).alias("one"))
    out = rows.groupBy(conv).agg(F.array_sort(F.collect_list("one")).alias("ts"))
    spans = F.filter(F.transform("ts", lambda t: t["span"]), lambda s: s.isNotNull())
    return out.select(conv, F.array_join(F.transform("ts", lambda t: t["s"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame, text: str = "formatted") -> DataFrame:
    """Add ``turns`` (array of role, text), parsed from the formatted string."""
    blocks = F.expr(f"filter(split({text}, '<[|]end[|]>', -1), b -> b != '')")

    def one(block: Column) -> Column:
        parts = F.split(F.substring(block, len(ROLE) + 1, 2**31 - 1), "<[|]text[|]>", 2)
        return F.transform(F.split(parts[1], "<[|]turn[|]>", -1), lambda t: F.struct(unescape(parts[0]).alias("role"), unescape(t).alias("text")))

    return formatted.withColumn("turns", F.flatten(F.transform(blocks, one)))


#: Characters of the slices in which a formatted string is looked up.
SLICE = 1024


def loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """The unescaped text under the loss mask, cut out of the formatted string; the
    string is sliced once, as counting characters from its start for each span would
    be quadratic in very long conversations."""
    slices = F.regexp_extract_all(F.col(formatted), F.lit(f"(?s).{{1,{SLICE}}}"), F.lit(0))

    def cut(parts: Column, s: Column) -> Column:
        of = lambda at: F.floor(at / SLICE).cast("int")
        near = F.array_join(F.slice(parts, of(s["start"]) + 1, of(s["start"] + s["length"]) - of(s["start"]) + 1), "")
        return unescape(near.substr((s["start"] % SLICE + 1).cast("int"), s["length"].cast("int")))

    # The slices are bound by a transform over an array of one, so that they are made once.
    return F.transform(F.array(slices), lambda parts: F.array_join(F.transform(spans, lambda s: cut(parts, s)), ""))[0]
