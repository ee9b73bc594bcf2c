"""License notices by an exact set-similarity join with containment.

A template is looked for in every window of twice as many words as it has, wherever lines end, so a wrapped notice is
found and so is one with words put in, while words that stand far apart aren't taken together. A block is a stretch of
words that two of the longest windows fill, and begins where the first half of the one before ends: each window lies in
a block. Only template tokens can overlap with a template, so a block is represented by the set of template
tokens it holds. Tokens are ordered by their frequency over all blocks, rarest first. A
template with ``t`` tokens needs an overlap of ``a = ceil(threshold * t)``: the pair must then share a token among the
first ``t - a + 1`` of the template and the first ``b - a + 1`` of the block (prefix filter), the block must hold ``a``
tokens (length filter), and enough tokens must follow the shared one on both sides (positional filter). What is left is
verified window by window. Joins are on tokens of prefixes only, so a common word never becomes a join key of its own.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.text import ascii_lower, text_or_empty
from vigil.shared import written

# Fixed values of the output contract: phrase and label.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Notices in common use, by label.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "public-domain": "This is free and unencumbered software released into the public domain",
}


def template_tokens(text: str) -> list[str]:
    return sorted({w for w in re.split(SEPARATORS, text.lower()) if w})


def window(text: str) -> int:
    """The number of words among which a template is looked for."""
    return 2 * sum(1 for w in re.split(SEPARATORS, text.lower()) if w)


def _needed(templates: dict[str, str], threshold: float) -> dict[str, int]:
    return {label: math.ceil(threshold * len(template_tokens(text))) for label, text in templates.items()}


def _texts(tokens: list[str]) -> Column:
    return F.array(*map(F.lit, tokens))


def _blocks(words: Column, templates: dict[str, str]) -> Column:
    """The blocks of an array of words, as arrays of words: two of the longest windows long, half of it into the next."""
    step = max(map(window, templates.values()))
    starts = lambda w: F.sequence(F.lit(1), F.size(w), F.lit(step))
    return _bound(words, lambda w: F.transform(starts(w), lambda at: F.slice(w, at, 2 * step)))


def token_order(words: DataFrame, templates: dict[str, str]) -> list[str]:
    """The templates' tokens by the number of blocks that hold them, rarest first, ties by code point.

    ``words``: one column ``words``, an array a text. One row per token comes back, of a fixed list of templates.
    """
    tokens = sorted({t for text in templates.values() for t in template_tokens(text)})
    blocks = words.select(F.explode(_blocks(F.col("words"), templates)).alias("block"))
    held = blocks.select(F.explode(F.array_intersect(_texts(tokens), "block")).alias("token"))
    counts = {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def _prefixes(templates: dict[str, str], order: list[str], threshold: float) -> dict[str, list[str]]:
    """The rarest tokens of each template, of which every block that meets the threshold holds one."""
    at = {t: i for i, t in enumerate(order)}
    need = _needed(templates, threshold)
    ranked = {label: sorted(template_tokens(text), key=at.__getitem__) for label, text in templates.items()}
    return {label: tokens[: len(tokens) - need[label] + 1] for label, tokens in ranked.items()}


def _candidates(words: Column, templates: dict[str, str], order: list[str], threshold: float) -> Column:
    """(block, words) of the blocks with a token of some template's prefix: block, its template tokens, rarest first."""
    least = min(_needed(templates, threshold).values())
    some = _texts(sorted({t for tokens in _prefixes(templates, order, threshold).values() for t in tokens}))
    blocks = F.filter(_blocks(words, templates), lambda w: F.arrays_overlap(w, some))
    held = F.transform(blocks, lambda w: F.struct(F.array_intersect(_texts(order), w).alias("block"), w.alias("words")))
    return F.filter(held, lambda x: F.size(x["block"]) >= least)


def _starts(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words follow each other."""
    parts = phrase.split(" ")

    def here(at):
        same = F.get(words, at) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & F.coalesce(F.get(words, at + k) == part, F.lit(False))
        return same

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(blocks: DataFrame, templates: dict[str, str], order: list[str], threshold: float) -> DataFrame:
    """(row, label, containment) of every block-template pair with a window that meets the threshold, by the best window.

    ``blocks``: row, block (template tokens in ``order``), words.
    """
    need = _needed(templates, threshold)
    at = {t: i for i, t in enumerate(order)}
    spark = blocks.sparkSession
    rows = []
    for label, prefix in _prefixes(templates, order, threshold).items():
        template = _texts(sorted(template_tokens(templates[label]), key=at.__getitem__)).alias("template")
        rows += [
            F.struct(F.lit(t).alias("token"), F.lit(j).alias("j"), F.lit(label).alias("label"), template, F.lit(need[label]).alias("need"), F.lit(window(templates[label])).alias("width"))
            for j, t in enumerate(prefix)
        ]
    prefixes = spark.range(1).select(F.inline(F.array(*rows)))
    least = min(need.values())
    block_prefix = blocks.select(
        "row", "words", "block", F.posexplode(F.slice("block", F.lit(1), F.size("block") - (least - 1))).alias("i", "token")
    )
    fits = (
        (F.size("block") >= F.col("need"))
        & (F.col("i") <= F.size("block") - F.col("need"))
        & (F.least(F.size("block") - F.col("i"), F.size("template") - F.col("j")) >= F.col("need"))
    )
    within = F.transform(F.sequence(F.lit(1), F.size("words")), lambda at: F.size(F.array_intersect(F.slice("words", at, F.col("width")), "template")))
    overlap = F.array_max(within)
    return (
        block_prefix.join(F.broadcast(prefixes), "token")
        .filter(fits)
        .withColumn("overlap", overlap)
        .filter(F.col("overlap") >= F.col("need"))
        .select("row", "label", (F.col("overlap") / F.size("template")).alias("containment"))
    )


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None,
    threshold: float = 0.8,
) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are those of the lower-cased text; the base columns come from the three fixed phrases, ``labels`` adds the
    templates that a window of words contains by ``threshold`` or more. ``score`` is the largest containment found, 1 where a base
    phrase stands and 0 where nothing was found. A null or empty text has no words, no labels and a score of 0.
    Repeated rows each get their own result; only the two named columns are read. The templates are a fixed list, so
    their table may be broadcast and the counts of their tokens may be collected.
    """
    templates = TEMPLATES if templates is None else templates
    flat = F.trim(F.regexp_replace(ascii_lower(text_or_empty(text_col)), SEPARATORS, " "))
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), flat.alias("flat"))
    padded = F.concat(F.lit(" "), F.col("flat"), F.lit(" "))
    held = {label: F.contains(padded, F.lit(f" {phrase} ")) for phrase, label in BASE_PHRASES.items()}
    words = F.split("flat", " ", -1)
    order = token_order(rows.select(words.alias("words")), templates)
    some = held["cc-by"] | held["gpl"] | held["reserved"]
    starts = _bound(words, lambda w: F.struct(*[_starts(w, phrase).alias(label) for phrase, label in BASE_PHRASES.items()]))
    base = written(
        rows.select(
            "id", "row",
            F.when(F.col("flat") == "", F.lit(0))
            .otherwise(F.octet_length("flat") - F.octet_length(F.replace("flat", F.lit(" "), F.lit(""))) + 1)
            .cast("long").alias("n_words"),
            F.when(some, starts).alias("starts"),
            _candidates(words, templates, order, threshold).alias("blocks"),
        ),
        "license",
    )
    blocks = base.select("row", F.inline("blocks"))
    found = matches(blocks, templates, order, threshold).groupBy("row").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("best")
    )
    labels = list(BASE_PHRASES.values())
    places = F.concat(*[F.coalesce(F.col("starts")[x], F.array().cast("array<int>")) for x in labels])
    named = F.filter(F.array(*[F.when(F.size(F.col("starts")[x]) > 0, F.lit(x)) for x in labels]), F.isnotnull)
    return (
        base.drop("blocks").join(found, "row", "left")
        .withColumns({"places": places, "named": F.array_sort(named)})
        .select(
            F.col("id").alias(id_col), "n_words", F.size("places").cast("long").alias("n_base"),
            F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
            F.array_join("named", ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("named", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
            F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("places") > 0, 1.0).otherwise(0.0)).alias("score"),
        )
    )
