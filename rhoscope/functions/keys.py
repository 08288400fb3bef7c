"""Key and label expressions: normalisation, parsing, canonical forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean(c: str | Column) -> Column:
    """Text of any label, without outer blanks."""
    return F.trim(_col(c).cast("string"))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_fold(op: str | Column) -> Column:
    """``unit_3`` -> ``unit``."""
    return F.regexp_replace(_col(op), r"_\d+$", "")


def strip_control(label: str | Column) -> Column:
    """``gene+ctrl`` -> ``gene``."""
    return F.regexp_replace(_col(label), r"\+ctrl$", "")


def normalise(c: str | Column) -> Column:
    """Blanks and dots to underscores, hyphens dropped, lower case."""
    return F.lower(F.translate(_col(c), " .-", "__"))


def components(label: str | Column, control: str = "control") -> Column:
    """``A + B`` -> [A, B]; blanks, empty parts and the control label are dropped."""
    parts = F.transform(F.split(_col(label), r"\+"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (p != "") & (p != control))


def label_type(label: str | Column, control: str = "control") -> Column:
    n = F.size(components(label, control))
    return F.when(n == 0, "control").when(n == 1, "single").otherwise("double")


def pair_key(label: str | Column) -> Column:
    """One key for ``A+B`` and ``B+A``."""
    return F.array_join(F.array_sort(F.split(_col(label), r"\+")), "+")


def seed32(*parts: Column | str) -> Column:
    """Stable 32-bit seed of a key: leading digits of its SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, 8), 16, 10).cast("long")


def hash_position(size: str | Column, *parts: Column | str) -> Column:
    """Position in 0..size-1 drawn by the MD5 of a key."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")
    return F.pmod(drawn, _col(size))


def first_present(df: DataFrame, candidates: list[str]) -> str:
    """First column of a candidate list that the frame has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise KeyError(f"none of {candidates} in {df.columns}")


def control_label(labels: DataFrame, candidates: list[str], by: list[str], label: str = "label") -> DataFrame:
    """(by, label): the first of the candidate control labels that each ``by`` has;
    those without any are missing."""
    place = F.array_position(F.array(*map(F.lit, candidates)), F.col(label))
    return labels.where(F.col(label).isin(candidates)).groupBy(*by).agg(F.min_by(label, place).alias(label))


def vocabulary(c: str | Column, mapping: dict[str, str], default: str | None = None) -> Column:
    """Dictionary lookup; unmapped values become null, or stay with ``default='same'``."""
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), _col(c))
    return F.coalesce(found, _col(c)) if default == "same" else found


#: Stored class names and their canonical form.
CLASS_NAMES = {
    "genuine": "Specific", "genuine_signal": "Specific", "trivial": "Shared", "falsely_solved": "Shared",
    "unreliable": "Unreliable", "unmeasurable": "Unreliable",
}


def is_guide_label(c: str | Column) -> Column:
    """Labels of guides rather than gene targets (fixed patterns)."""
    c = _col(c)
    return c.contains("posA") | c.contains("posB") | c.startswith("NegCtrl") | c.contains("_+_") | c.contains("_-_")


def scope(dataset: str | Column, base: str | Column) -> Column:
    """Chemical screens are a scope of their own, whatever file they came in."""
    return F.when(F.lower(_col(dataset)).startswith("sciplex"), "chemical").otherwise(_col(base))
