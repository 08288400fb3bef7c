"""License scan over a positional rare-token index, DataFrame functions only.

Templates are word sequences with mandatory key phrases.  Over the whole corpus
the document frequency of every template word is counted.  Each file looks up
its own highest-IDF licence words (and the anchors, the rarest words, of every
template's mandatory phrases, as many as have to agree) in the positional index of
the templates: no place that holds the mandatory phrases is lost.  Every
posting proposes an alignment (template, start); proposals are sorted once, so
that alignments on which enough words agree are runs of equal numbers, and of
those the mandatory key phrases are verified word by word.  Everything after the
count is one expression per row, linear in the text but for that sort: no
shuffle, so a hot source or copies make no hot task.

Words: A-Z lower-cased, maximal runs outside ``[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``.

Defined results: a null or empty text has no words, no labels and score 0;
repeated rows are separate rows; an empty table gives no rows; all columns of
the input are kept, but for those named like the result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: Alignments are numbered template * _SPAN + start + _ZERO; a start may lie before the text.
_SPAN, _ZERO = 1 << 34, 1 << 20
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[int, int], ...]  # mandatory phrases: (first word, number of words)
    base: bool = False


def _template(label: str, text: str, *keys: str, base: bool = False) -> Template:
    words = tuple(text.split())
    spans = []
    for k in keys or (text,):
        need = k.split()
        at = next(i for i in range(len(words)) if list(words[i : i + len(need)]) == need)
        spans.append((at, len(need)))
    return Template(label, words, tuple(spans), base)


# Phrases that must be reported, and public licence notices, as words.
TEMPLATES = (
    _template("mit", "mit license", base=True),
    _template("apache", "apache license", base=True),
    _template("gpl", "general public license", base=True),
    _template("mit-notice", "released under the mit license", "under the mit license"),
    _template(
        "mit-grant",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "permission is hereby granted free of charge",
    ),
    _template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies",
        "for any purpose with or without fee is hereby granted",
    ),
    _template("apache-2.0", "licensed under the apache license version 2 0", "apache license", "version 2 0"),
    _template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "you may not use this file except in compliance with the license",
    ),
    _template("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license", "version 3"),
    _template("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license", "version 2"),
    _template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
        "as published by the free software foundation",
        "redistribute it and or modify it under the terms of the gnu general public license",
    ),
    _template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
        "as published by the free software foundation",
        "gnu lesser general public license",
    ),
    _template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file "
        "you can obtain one at",
        "mozilla public license",
    ),
    _template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    _template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    _template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    _template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistribution and use in source and binary forms",
    ),
)


def words_of(text: Column) -> Column:
    """Lower-cased words.  The two non-ASCII letters whose lower case holds an
    ASCII letter are kept away from ``lower``; template words are ASCII, so the
    case of other letters is of no consequence."""
    kept = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ẞ")), F.lit("İ"), F.lit("ẞ"))
    return F.regexp_extract_all(F.lower(kept), F.lit(WORD), F.lit(0))


def licence_idf(df: DataFrame, text_col: str, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """IDF of every template word over all rows; at most one row per template
    word reaches the driver, whatever the corpus."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = F.array_intersect(F.array(*map(F.lit, vocabulary)), words_of(F.col(text_col)))
    counted = df.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("w")).groupBy("w").count().collect()  # "": every row
    df_of = {r[0]: r[1] for r in counted}
    return {w: math.log((1 + df_of.get("", 0)) / (1 + df_of.get(w, 0))) for w in vocabulary}


def ranked_words(idf: dict[str, float]) -> list[str]:
    """Words from the rarest to the most frequent, equals in order."""
    return sorted(idf, key=lambda w: (-idf[w], w))


def anchors(templates: tuple[Template, ...], ranked: list[str], each: int = 1) -> list[str]:
    """The ``each`` rarest words of the templates' mandatory phrases."""
    return sorted({w for t in templates for w in sorted({w for at, n in t.keys for w in t.words[at : at + n]}, key=ranked.index)[:each]})


def scan_licenses(df: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES, rare_words: int = 12, agree: int = 2) -> DataFrame:
    """``df`` plus ``n_words`` and ``matches`` (label, start, fraction, base; by
    template and place).

    ``rare_words``: how many of its highest-IDF licence words a file looks up;
    ``agree``: how many places must propose the same alignment (for reported
    phrases one is enough: they are verified whole).
    """
    ranked = ranked_words(licence_idf(df, text_col, templates))
    postings = {w: [(k, i) for k, t in enumerate(templates) for i, x in enumerate(t.words) if x == w] for w in ranked}
    index = F.create_map(*[x for w in ranked for x in (F.lit(w), F.array(*[F.lit(k * _SPAN - i + _ZERO) for k, i in postings[w]]))])
    table = F.array(*[
        F.struct(
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(1 if t.base else min(agree, len(t.words))).alias("need"), F.array(*map(F.lit, t.words)).alias("words"),
            F.array(*[F.lit(i) for at, n in t.keys for i in range(at, at + n)]).alias("must"),
        )
        for k, t in enumerate(templates)
    ])
    df = df.drop("n_words", "matches")
    words, look, prop = fresh(df, "words"), fresh(df, "look"), fresh(df, "prop")
    out = df.withColumn(words, words_of(F.col(text_col)))
    w, c = F.col(words), F.col(prop)
    mine = F.array_intersect(F.array(*map(F.lit, ranked)), w)  # the file's licence words, rarest first
    # Always looked up, so that whatever holds its mandatory phrases is proposed often enough.
    base, own = (tuple(t for t in templates if t.base == b) for b in (True, False))
    must_look = F.array(*map(F.lit, sorted({*anchors(base, ranked), *anchors(own, ranked, agree)})))
    # A file without the rarest word of any mandatory phrase has no licence.
    able = F.arrays_overlap(w, F.array(*map(F.lit, anchors(templates, ranked))))
    out = out.withColumn(look, F.when(able, F.array_union(F.slice(mine, 1, rare_words), F.array_intersect(must_look, mine))).otherwise(F.expr("cast(array() as array<string>)")))
    # Words of the file with their postings: the index cut down to what this file looks up.
    mine = F.transform(F.col(look), lambda x: F.struct(x.alias("w"), F.element_at(index, x).alias("at")))
    # An alignment is one number: template times a span, plus its start.
    hit = lambda x: F.filter(F.transform(w, lambda v, i: F.when(v == x["w"], i.cast("long"))), lambda i: i.isNotNull())
    proposed = F.flatten(F.transform(mine, lambda x: F.flatten(F.transform(hit(x), lambda i: F.transform(x["at"], lambda p: p + i)))))
    out = out.withColumn(prop, F.when(F.size(look) > 0, F.array_sort(proposed)).otherwise(F.expr("cast(array() as array<bigint>)")))

    def template(x: Column) -> Column:
        return F.get(table, F.floor(x / _SPAN).cast("int"))

    def start(x: Column) -> Column:
        return (F.pmod(x, F.lit(_SPAN)) - _ZERO).cast("int")

    def same(x: Column, p: Column) -> Column:
        return F.coalesce(F.get(w, start(x) + p) == F.get(template(x)["words"], p), F.lit(False))

    def agreed(x: Column, i: Column) -> Column:
        new = F.coalesce(F.get(c, i - 1) != x, F.lit(True))
        return new & F.coalesce(F.get(c, i + template(x)["need"] - 1) == x, F.lit(False))

    def verified(x: Column) -> Column:
        return F.forall(template(x)["must"], lambda p: same(x, p))

    def match(x: Column) -> Column:
        t = template(x)
        n = F.size(F.filter(F.sequence(F.lit(0), F.size(t["words"]) - 1), lambda p: same(x, p)))
        return F.struct(t["label"].alias("label"), start(x).cast("long").alias("start"), (n / F.size(t["words"])).alias("fraction"), t["base"].alias("base"))

    matches = F.transform(F.filter(F.filter(c, agreed), verified), match)
    return out.withColumn("n_words", F.size(w).cast("long")).withColumn("matches", matches).drop(words, look, prop)
