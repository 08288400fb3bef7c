"""Repair of conversation structure by a min-plus matrix scan.

A conversation is well formed when the initials of its roles match
``(s?(ua)+)?``.  That pattern has four states: nothing yet, after ``s``, after
``u``, after ``a``.  Each turn becomes a 4x4 matrix whose element (i, j) is the
cheapest edit that takes state i to j, followed by the closure over inserts; an
element is (cost, audit), the audit being the edits' initials (Keep, Rerole,
Delete, Insert).  Sum is the smaller pair, product adds costs and joins audits;
that is associative, so any consecutive turns can be multiplied first.  (Equal
costs of the same turns never have audits of which one begins the other: what
would be left over is inserts, which cost.  So comparing before or after joining
is the same.)

Turns are numbered in order over all rows (:func:`shards.row_numbers`), runs of
at most ``RUN`` consecutive numbers are multiplied where they lie, and the runs
of conversations that have several are combined in a tree of fan-in 64.  No
step needs the turns of one conversation together; its audit, one letter for
each edit, is one value because the result is.

Texts do not move in any of this.  :func:`repaired` deals them out once, sorted,
and applies the audits in a stream: one batch and one audit are in memory.

Defined results: null roles and texts count as one space, and every role whose
initial is not s, u or a has to be changed or deleted.  A null turn sorts first,
ties are ordered by role, then by the text's SHA-256; repeated rows are rows.
A null conversation id is a conversation of its own.  An empty table gives no
rows.  Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, cut, small_batches
from .shards import row_numbers

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLANKS = " \t\n\x0b\f\r"
#: Rows of a run, and the bits by which runs grow from one level of the tree to the next.
RUN, FAN_BITS = 1024, 6

Element = tuple[int, str] | None
Matrix = tuple[tuple[Element, ...], ...]

START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: State after a role's initial.
STEP = {(START, "s"): AFTER_S, **{(i, "u"): AFTER_U for i in (START, AFTER_S, AFTER_A)}, (AFTER_U, "a"): AFTER_A}


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product over (cost, audit)."""
    return tuple(tuple(min((x[0] + y[0], x[1] + y[1]) for x, y in zip(row, col, strict=True) if x and y) if any(x and y for x, y in zip(row, col, strict=True)) else None for col in zip(*b, strict=True)) for row in a)


def _one_step(cost: int, letter: str, initials: str) -> Matrix:
    to = {(i, j) for (i, c), j in STEP.items() if c in initials}
    return tuple(tuple((cost, letter) if (i, j) in to else None for j in range(4)) for i in range(4))


def plus(*ms: Matrix) -> Matrix:
    return tuple(tuple(min((m[i][j] for m in ms if m[i][j]), default=None) for j in range(4)) for i in range(4))


IDENTITY: Matrix = tuple(tuple((0, "") if i == j else None for j in range(4)) for i in range(4))
_INSERT = _one_step(INSERT, "I", "ua")
#: Any inserts: more than two lead to no further state.
CLOSURE = plus(IDENTITY, _INSERT, times(_INSERT, _INSERT))


@functools.lru_cache(maxsize=64)
def turn_matrix(initial: str, delete: bool, truncated: bool) -> Matrix:
    """Edits of one turn, then inserts.  ``delete``: the turn has to go."""
    gone = tuple(tuple((DELETE, "D") if i == j else None for j in range(4)) for i in range(4))
    if delete:
        return times(gone, CLOSURE)
    more = TRUNCATED if truncated else 0
    return times(plus(gone, _one_step(KEEP + more, "K", initial), _one_step(REROLE + more, "R", "ua")), CLOSURE)


def cheapest(m: Matrix) -> tuple[int, str]:
    """Cost and audit of whole conversations, inserts before the first turn included."""
    first = times(CLOSURE, m)[START]
    return min(e for e in (first[START], first[AFTER_A]) if e)


@dataclass
class Run:
    """Consecutive turns of one conversation, ``rest`` being columns to hand on."""

    number: int
    rows: int
    first: str
    last: str
    counts: list[int]  # blank, duplicate, truncated, illegal
    matrix: Matrix
    rest: list = field(default_factory=list)


LEGAL = {"su", "ua", "au"}


def join_runs(a: Run, b: Run) -> Run:
    counts = [x + y for x, y in zip(a.counts, b.counts, strict=True)]
    counts[3] += a.last + b.first not in LEGAL
    return Run(a.number, a.rows + b.rows, a.first, b.last, counts, times(a.matrix, b.matrix), a.rest)


def reduce_tree(runs: list[Run]) -> Run:
    """Product of neighbouring runs, in pairs of about equal length."""
    while len(runs) > 1:
        runs = [join_runs(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


_ELEMENT = "number long, rows long, first string, last string, counts array<bigint>, costs array<bigint>, audits array<string>"


def _pack(run: Run) -> list:
    flat = [e for row in run.matrix for e in row]
    return [run.number, run.rows, run.first, run.last, run.counts, [e and e[0] for e in flat], [e and e[1] for e in flat]]


def _unpack(values: list, rest: list) -> Run:
    number, rows, first, last, counts, costs, audits = values
    flat = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
    return Run(number, rows, first, last, list(counts), tuple(tuple(flat[4 * i : 4 * i + 4]) for i in range(4)), rest)


def _chained(key: Callable[[tuple], object], runs: Iterator[tuple[tuple, Run]], most: int) -> Iterator[tuple[tuple, Run]]:
    """Runs that follow each other inside one conversation, joined, ``most`` at a time."""
    held, of = [], None
    for row, run in runs:
        if held and (key(row) != key(of) or held[-1].number + held[-1].rows != run.number or len(held) == most):
            yield of, reduce_tree(held)
            held = []
        if not held:
            of = row
        held.append(run)
    if held:
        yield of, reduce_tree(held)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _emit(rows: Iterator[list], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, str | bytes))
        if len(held) == size or weight > 1 << 23:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _schema(df_schema) -> pa.Schema:
    return pa.schema([pa.field(f.name, arrow_type(f.dataType)) for f in df_schema.fields])


def _made(conv: str, kind: str, ddl: str):
    from pyspark.sql import types as T

    return T.StructType.fromDDL(f"`{conv}` {kind}, {ddl}")


def last_visible(text: Column) -> Column:
    """The last character that is not white space; empty for a blank text."""
    return F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1)


def normal(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    fill = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), fill(role).alias("role"), fill(text).alias("text"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def audit_conversations(turns: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, ``gaps``, ``blank``, ``duplicate``,
    ``truncated``, ``illegal``, ``cost`` (longs) and ``audit``.

    ``ids``: rows whose ``conv`` must appear even without turns.
    """
    kind = turns.schema[conv].dataType.simpleString()
    rows = normal(turns, conv, turn, role, text)
    end = last_visible(F.col("text"))
    order = F.struct("turn", "role", digest(F.col("text")).alias("digest"))
    small = rows.select("conv", order.alias("tie"), (end == "").alias("blank"), (~end.isin("", ".", "!", "?")).alias("cut_off"))
    numbered, _ = row_numbers(cut(small), "conv", "tie", "number")  # cut: the ranges are sampled, and texts are read once

    # A turn is new if it is the first of its conversation with its role and text.
    new = numbered.groupBy("conv", "tie.role", "tie.digest").agg(F.min("number").alias("number"))
    block = F.floor(F.col("number") / RUN).alias("block")
    marks = new.select(block, "number", F.lit(0).alias("mark"), F.lit(None).cast(kind).alias("conv"), F.lit(None).cast("string").alias("initial"), F.lit(None).cast("boolean").alias("blank"), F.lit(None).cast("boolean").alias("cut_off"))
    each = numbered.select(block, "number", F.lit(1).alias("mark"), "conv", F.substring("tie.role", 1, 1).alias("initial"), "blank", "cut_off")
    dealt = each.unionByName(marks).repartition("block").sortWithinPartitions("number", "mark")
    schema = _made("conv", kind, _ELEMENT)
    arrow = _schema(schema)

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def single() -> Iterator[tuple[tuple, Run]]:
            fresh_number = None
            for _, number, mark, of, initial, blank, cut_off in _rows(batches):
                if mark == 0:
                    fresh_number = number
                    continue
                again = not blank and number != fresh_number
                short = cut_off and not again
                counts = [int(blank), int(again), int(short), 0]
                yield (of,), Run(number, 1, initial, initial, counts, turn_matrix(initial if initial in ("s", "u", "a") else "-", blank or again, short))

        return _emit(([of[0], *_pack(run)] for of, run in _chained(lambda r: r[0], single(), RUN)), arrow)

    seen = rows.select("conv", "turn", F.lit(1).alias("n"))
    if ids is not None:
        seen = seen.unionByName(ids.select(F.col(conv).alias("conv"), F.lit(None).cast(seen.schema["turn"].dataType).alias("turn"), F.lit(0).alias("n")))
    spread = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    totals = seen.groupBy("conv").agg(F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"), F.sum("n").cast("long").alias("of"))
    totals = cut(totals)
    runs = dealt.mapInArrow(first_level, schema)
    left = cut(runs.join(totals.select(F.col("conv").alias("conv_"), "gaps", "of"), F.col("conv").eqNullSafe(F.col("conv_"))).drop("conv_"))

    upper = _made("conv", kind, f"{_ELEMENT}, gaps long, of long")
    upper_arrow = _schema(upper)

    def next_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacked = ((row, _unpack(row[1:8], list(row[8:10]))) for row in _rows(batches))
        return _emit(([row[0], *_pack(run), *run.rest] for row, run in _chained(lambda r: r[0], unpacked, 1 << 2 * FAN_BITS)), upper_arrow)

    whole, shift = [left.where("rows = of")], RUN.bit_length() - 1
    while not (rest := left.where("rows < of")).isEmpty():  # one level of the tree
        shift += FAN_BITS
        up = rest.select(*upper.names, F.shiftright("number", shift).alias("up"))
        left = cut(up.repartition("up").sortWithinPartitions("number").drop("up").mapInArrow(next_level, upper))
        whole.append(left.where("rows = of"))
    done = functools.reduce(DataFrame.unionByName, whole)

    final = _made("conv", kind, "gaps long, counts array<bigint>, cost long, audit string")
    final_arrow = _schema(final)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(([row[0], row[8], run.counts, *cheapest(run.matrix)] for row in _rows(batches) for run in [_unpack(row[1:8], [])]), final_arrow)

    none = totals.where("of = 0").select("conv", "gaps", F.array(*[F.lit(0).cast("long")] * 4).alias("counts"), F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    out = done.select(*upper.names).mapInArrow(answer, final).unionByName(none)
    names = ["blank", "duplicate", "truncated", "illegal"]
    return out.select(F.col("conv").alias(conv), "gaps", *[F.col("counts")[k].alias(c) for k, c in enumerate(names)], "cost", "audit")


def apply_audit(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Roles and texts of one repaired conversation; ``turns`` in order."""
    state, turns = START, iter(turns)
    for edit in audit:
        wanted = "assistant" if state == AFTER_U else "user"
        role, text = (wanted, "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        role = wanted if edit == "R" else role
        state = STEP[state, role[0]]
        yield role, text


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """For each conversation, its head's columns and its repaired turns, in a stream."""
    rows = _rows(batches)
    row = next(rows, None)

    def turns() -> Iterator[tuple[str, str]]:
        nonlocal row
        while (row := next(rows, None)) is not None and row[0]:
            yield row[1], row[2]

    while row is not None:
        head, of = row[3:], turns()
        yield head, apply_audit(head[-1], of)
        for _ in of:  # nothing is left but for an audit that the reader gave up
            pass


def repaired(turns: DataFrame, audits: DataFrame, made: Callable[[Iterator[tuple[str, str]]], Iterator[list]], ddl: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``audits`` (of :func:`audit_conversations` on the same ``turns``) with the
    columns ``ddl`` that ``made`` yields from a conversation's repaired turns.

    ``made`` may yield several rows, or none.  The turns of one conversation pass
    through one task, as they do in any reading in order, but batch by batch.
    """
    small_batches(turns.sparkSession)
    from pyspark.sql import types as T

    body = normal(turns, conv, turn, role, text).select("conv", F.lit(True).alias("is_turn"), "turn", "role", "text", digest(F.col("text")).alias("digest"))
    head = audits.select(F.col(conv).alias("conv"), F.lit(False).alias("is_turn"), F.struct(*audits.columns).alias("head"))
    both = head.unionByName(body, allowMissingColumns=True).repartition("conv").sortWithinPartitions("conv", "is_turn", F.asc_nulls_first("turn"), "role", "digest")
    schema = T.StructType([*audits.schema.fields, *T.StructType.fromDDL(ddl).fields])
    arrow = _schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _emit(([*head, *row] for head, said in _streams(batches) for row in made(said)), arrow)

    return both.select("is_turn", "role", "text", *[F.col("head")[c].alias(c) for c in audits.columns]).mapInArrow(run, schema)


def repaired_turns(turns: DataFrame, audits: DataFrame, **columns: str) -> DataFrame:
    """The repaired conversations, one row per turn: id, ``place`` from 0, ``role``, ``text``."""
    conv = columns.get("conv", "conv_id")
    rows = lambda said: ([i, r, t] for i, (r, t) in enumerate(said))
    return repaired(turns, audits, rows, "place long, fixed_role string, fixed_text string", **columns).select(conv, "place", F.col("fixed_role").alias("role"), F.col("fixed_text").alias("text"))
