"""License scan: an exact containment join between the blocks of all texts
and the texts of known license notices.

A block is a window of 2 L words that begins at a multiple of L, so any
passage of L + 1 words lies whole in one block.  Every template has the L
that is the smallest power of two (8 at least) that its words fit in, and is
compared with the blocks of that L only.  A block holds a template when at
least ``threshold`` of the template's distinct words occur in it.

The join finds all such pairs without comparing all of them:

* token order: the templates' words are ordered by the number of documents
  that hold them, rarest first; sets are sorted by that order
* prefix filter: a template of m words that needs o of them must share one
  of its m - o + 1 rarest words; only blocks around such words are built
* length filter: a block with fewer than o words of the vocabulary goes
* positional filter: if the first shared word is p-th in the block and q-th
  in the template, at most 1 + min(words behind p, words behind q) are shared
* the pairs left are counted exactly

Only windows around rare words leave a row, as sorted sets of template words;
texts are never shuffled.  The template tables are parameters and small
(their words are counted here, see ``MAX_VOCABULARY``), so they are broadcast.

The base scan looks for fixed phrases standing word for word.  Its labels
stay; templates add theirs.

Defined results: a null text counts as empty, a text without words has none
of all; a null doc_id is the smallest id; repeated rows get equal results
each; an empty table gives an empty table; any other column is ignored, or
carried under ``keep`` whatever its name; texts of any length are scanned
whole; of words equally frequent the one first by code point counts as rarer.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import materialise, with_row_key

# ============================================================ fixed values ==
# Phrases of the base scan and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
# Openings of public license notices and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
            " documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in"
               " compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
            " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
            " option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
            " the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is"
            " hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc", "Licensed under CC BY-NC 4.0."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
)
# ============================================================================
#: A notice of five words must be whole, longer ones may lose some.
THRESHOLD = 0.85
MIN_STRIDE = 8
#: Distinct words of all templates together; what is broadcast grows with this alone.
MAX_VOCABULARY = 20_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(_UPPER, _LOWER)


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[str, ...]  # distinct, in code point order
    needed: int             # of its words, for a block to hold it
    stride: int


def templates_of(texts: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    """Templates from (label, text) pairs."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    out = []
    for number, (label, text) in enumerate(texts):
        words = re.findall(WORD, text.translate(_LOWERED))
        if not words:
            raise ValueError(f"template {number} ({label}) has no word")
        distinct = tuple(sorted(set(words)))
        stride = max(MIN_STRIDE, 1 << (len(words) - 1).bit_length())
        out.append(Template(number, label, distinct, ceil(threshold * len(distinct) - 1e-9), stride))
    if len({w for t in out for w in t.words}) > MAX_VOCABULARY:
        raise ValueError(f"the templates hold more than {MAX_VOCABULARY} distinct words")
    return out


def words_of(text: Column) -> Column:
    """The text's words, A-Z lower-cased, as an array."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)  # there lower() is the same, and faster
    return F.array_remove(F.split(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), BETWEEN, -1), "")


def _array(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


# ------------------------------------------------------------------ the join --
def token_order(words: DataFrame, templates: list[Template]) -> list[str]:
    """All template words, those in the fewest documents first.  ``words`` has
    one row a document with its array ``w``; every partition sends on at most
    one count for each template word."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = words.select(F.explode(F.array_intersect(F.col("w"), _array(vocabulary))).alias("token"))
    counts = {r["token"]: r["n"] for r in found.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def _postings(spark: SparkSession, templates: list[Template], order: list[str]) -> DataFrame:
    """(token, stride) to the templates whose prefix holds the token, with its place there."""
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for t in templates:
        for q, word in enumerate(sorted(t.words, key=rank.__getitem__)[:len(t.words) - t.needed + 1]):
            rows.append((word, t.stride, t.number, q, len(t.words), t.needed))
    return spark.createDataFrame(rows, "token string, stride int, template int, q int, m int, needed int")


def prefix_tokens(templates: list[Template], order: list[str]) -> dict[int, list[str]]:
    """For each stride the words that are in a prefix of one of its templates."""
    rank = {w: k for k, w in enumerate(order)}
    out: dict[int, set[str]] = {}
    for t in templates:
        out.setdefault(t.stride, set()).update(sorted(t.words, key=rank.__getitem__)[:len(t.words) - t.needed + 1])
    return {s: sorted(ws) for s, ws in sorted(out.items())}


def _prefix_places(words: Column, prefixes: dict[int, list[str]]) -> Column:
    """Word numbers of all prefix words (few: they are the rarest of the templates)."""
    tokens = sorted({w for ws in prefixes.values() for w in ws})
    places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(tokens), i)), lambda i: i.isNotNull())
    return F.when(F.arrays_overlap(words, _array(tokens)), places).otherwise(F.array().cast("array<int>"))


def _blocks_of(words: Column, places: Column, stride: int, prefix: list[str], order: list[str], least: int) -> Column:
    """The blocks of one stride around prefix words: structs of stride, block
    number and the block's template words in token order."""
    hits = F.transform(F.filter(places, lambda i: F.get(words, i).isin(prefix)), lambda i: F.floor(i / stride).cast("int"))
    numbers = F.filter(F.array_distinct(F.flatten(F.transform(hits, lambda b: F.array(b - 1, b)))), lambda b: b >= 0)
    blocks = F.transform(numbers, lambda b: F.struct(
        F.lit(stride).alias("stride"), b.alias("block"),
        F.array_intersect(_array(order), F.slice(words, b * stride + 1, F.lit(2 * stride))).alias("tokens")))
    return F.filter(blocks, lambda b: F.size(b["tokens"]) >= least)


def join_blocks(blocks: DataFrame, templates: list[Template], order: list[str], keys: list[str]) -> DataFrame:
    """``keys``, template, containment of every (block, template) pair that
    meets the threshold.  ``blocks`` has keys, stride and sorted tokens."""
    spark = blocks.sparkSession
    rank = {w: k for k, w in enumerate(order)}
    hits = blocks.select(*keys, "stride", "tokens", F.posexplode("tokens").alias("p", "token"))
    hits = hits.join(F.broadcast(_postings(spark, templates, order)), ["token", "stride"])
    hits = hits.filter(F.size("tokens") >= F.col("needed"))  # length
    # the first shared word decides: all others stand behind it on both sides
    first = hits.groupBy(*keys, "template").agg(F.min(F.struct("q", "p")).alias("at"), F.any_value("tokens").alias("tokens"),
                                                F.any_value("m").alias("m"), F.any_value("needed").alias("needed"))
    first = first.filter(1 + F.least(F.size("tokens") - F.col("at.p") - 1, F.col("m") - F.col("at.q") - 1) >= F.col("needed"))
    sets = spark.createDataFrame([(t.number, t.label, sorted(t.words, key=rank.__getitem__)) for t in templates],
                                 "template int, label string, words array<string>")
    shared = F.size(F.array_intersect("tokens", "words"))
    return first.join(F.broadcast(sets), "template").withColumn("shared", shared).filter(F.col("shared") >= F.col("needed")) \
                .select(*keys, "template", "label", (F.col("shared") / F.col("m")).alias("containment"))


# ------------------------------------------------------------- the base scan --
def _places(words: Column, phrase: str) -> Column:
    """Word numbers where the phrase's words stand one after the other."""
    parts = phrase.split(" ")
    n = F.size(words)

    def stands(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.get(words, i + k) == F.lit(p) for k, p in enumerate(parts)])

    none = F.array().cast("array<int>")
    possible = (n >= len(parts)) & reduce(lambda a, b: a & b, [F.array_contains(words, p) for p in parts])
    return F.when(possible, F.filter(F.sequence(F.lit(0), n - len(parts)), stands)).otherwise(none)


# --------------------------------------------------------------- the operator --
def _scanned(docs: DataFrame, keep: list[str], templates: list[Template], phrases) -> tuple[DataFrame, list[str]]:
    """One written row for each document: base scan and blocks around prefix words."""
    rows = with_row_key(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__doc"), F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    rows = rows.select("__doc", "__id", "__th", words_of(F.col("text")).alias("w"))
    order = token_order(rows, templates)
    least: dict[int, int] = {}
    for t in templates:
        least[t.stride] = min(t.needed, least.get(t.stride, t.needed))
    prefixes, w, places = prefix_tokens(templates, order), F.col("w"), F.col("places")
    out = rows.withColumn("places", _prefix_places(w, prefixes)).select(
        "__doc", "__id", "__th", F.size(w).cast("bigint").alias("n_words"),
        F.array(*[F.struct(F.lit(label).alias("label"), _places(w, phrase).alias("at")) for phrase, label in phrases]).alias("base"),
        F.concat(*[_blocks_of(w, places, stride, prefix, order, least[stride]) for stride, prefix in prefixes.items()]).alias("blocks"))
    return materialise(out, "license-blocks"), order


def license_blocks(docs: DataFrame, texts: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every (block, template) pair that meets the threshold: doc_id, template
    (its number), label, the block's first and last word, containment."""
    templates = templates_of(texts, threshold)
    rows, order = _scanned(docs, ["doc_id"], templates, PHRASES)
    keys = ["__id", "__th", "stride", "block"]
    blocks = rows.select("__id", "__th", F.inline("blocks")).select(*keys, "tokens")
    found = join_blocks(blocks, templates, order, keys)
    ends = rows.groupBy("__id", "__th").agg(F.first("__doc").alias("__doc"), F.first("n_words").alias("n_words"))
    start = F.col("block") * F.col("stride")
    return found.join(ends, ["__id", "__th"]).select(
        F.col("__doc.doc_id").alias("doc_id"), "template", "label", start.cast("bigint").alias("first_word"),
        (F.least(start + 2 * F.col("stride"), F.col("n_words")) - 1).cast("bigint").alias("last_word"), "containment")


def scan_licenses(docs: DataFrame, keep: list[str] | None = None, texts: Sequence[tuple[str, str]] = TEMPLATES,
                  threshold: float = THRESHOLD, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """``keep`` columns (doc_id unless named) plus n_words, the base scan's
    n_base, first_word, last_word and base_labels, all ``labels`` and
    ``score``: 1 where a phrase stands, else the largest containment of a
    template whose threshold is met, else 0."""
    keep = keep or ["doc_id"]
    templates = templates_of(texts, threshold)
    rows, order = _scanned(docs, keep, templates, phrases)
    keys = ["__id", "__th", "stride", "block"]
    found = join_blocks(rows.select("__id", "__th", F.inline("blocks")).select(*keys, "tokens"), templates, order, keys)
    # written, so that the join below can be split where one document is repeated very often
    per = materialise(found.groupBy("__id", "__th").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best")), "license-labels")
    at = F.flatten(F.col("base.at"))
    base = F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"])
    added = F.coalesce(F.col("found"), F.array().cast("array<string>"))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    both = rows.drop("blocks").join(per, ["__id", "__th"], "left")
    return both.select(
        *[F.col("__doc").getField(c).alias(c) for c in keep], "n_words", F.size(at).cast("bigint").alias("n_base"),
        F.array_min(at).cast("bigint").alias("first_word"), F.array_max(at).cast("bigint").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, added)).alias("labels"),
        F.when(F.size(at) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
