"""License scan: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line, or a paragraph of several lines without their comment markers; its tokens are its
distinct words. A block matches a template if it holds at least
CONTAINMENT of the template's tokens. Tokens are ordered globally, rarest in all blocks first. Any
match shares a token with the template's prefix, its first m - need + 1 tokens in that order; it has
at least `need` tokens; and what can still follow the first shared token, by its positions in both,
must reach `need`. Blocks that pass these filters are verified, so no match is lost. As the words of
a long paragraph may come from anywhere in it, a paragraph must also hold the template's pairs of
successive words, as many as are left whichever 1 - CONTAINMENT of its words are lost. All of this is DataFrame
and SQL functions. Texts are read and cut into words once; of the blocks only those are kept that could match.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixlake.llm.shared import LOWER, UPPER, lower_ascii, materialize, table

#: A word, and phrases with their labels.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Part of a template's tokens that a block must hold: of templates with up to 12 words all, as any of those may tell licenses apart.
CONTAINMENT = 0.92
#: What may stand before the words of a wrapped notice's line, and what lies between paragraphs.
MARKER, BETWEEN = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|>+|<!--|\.\.|(?:dnl|rem|REM)(?=[ \t]))?[ \t\r]*", r"\n\n+"
_PLACES = "array<struct<start:int,label:string>>"
_BLOCKS = "array<struct<wrapped:boolean,size:int,tokens:array<string>,follows:array<string>>>"
#: Templates: sentences of public licenses and common notices, with their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
]


def template_tokens(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[int, str, list[str]]]:
    """(number, label, distinct words) of each template, by the words of texts."""
    return [(i, label, sorted(set(_cut(text)))) for i, (label, text) in enumerate(templates)]


def _cut(text: str) -> list[str]:
    """A template's words in order."""
    return re.findall(WORD, text.translate({ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}))


def _need(words: list[str], containment: float) -> int:
    return max(1, math.ceil(containment * len(words) - 1e-9))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.expr("cast(array() as array<string>)")


def _pairs(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _blocks(lower: Column, templates: list[tuple[str, str]], containment: float) -> Column:
    """The text's blocks that could match, as an array of structs: wrapped, size (distinct words), tokens (those that
    templates have) and follows (those of the templates' pairs of successive words that a paragraph holds; null for lines).

    A block with fewer known words than the shortest template needs can't match.
    """
    own = template_tokens(templates)
    known, least = _array(sorted({w for _, _, words in own for w in words})), min(_need(words, containment) for _, _, words in own)
    pairs = _array(sorted({x for _, text in templates for x in _pairs(_cut(text))}))

    def block(text: Column, wrapped: bool) -> Column:
        words = _words(text)
        held = F.when(F.size(words) > 1, F.array_intersect(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b)), pairs))
        follows = F.coalesce(held, F.expr("cast(array() as array<string>)")) if wrapped else F.lit(None).cast("array<string>")
        return F.struct(F.lit(wrapped).alias("wrapped"), F.size(F.array_distinct(words)).alias("size"), F.array_intersect(words, known).alias("tokens"), follows.alias("follows"))

    enough = lambda text: F.size(F.array_intersect(_words(text), known)) >= least
    lines = F.transform(F.filter(F.split(lower, "\n"), enough), lambda x: block(x, False))
    cut = F.split(F.regexp_replace(lower, MARKER, ""), BETWEEN)
    wrapped = F.transform(F.filter(cut, lambda x: F.contains(x, F.lit("\n")) & enough(x)), lambda x: block(x, True))
    return F.concat(lines, wrapped)


def read(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, text_key, n_words, places, blocks) of docs (doc_id, t): the only pass over the texts.

    Blocks are cut only from texts whose words hold enough of some template, as a block holds no more than its text.
    """
    own = template_tokens(templates)
    told = sorted({w for _, _, words in own for w in words} | {w for phrase in PHRASES for w in phrase.split(" ")})
    rows = docs.select("doc_id", F.xxhash64("t").alias("text_key"), lower_ascii(F.col("t")).alias("lower"))
    rows = rows.select("*", _words(F.col("lower")).alias("w"))
    rows = rows.select("*", F.array_intersect("w", _array(told)).alias("told"))
    places = F.when(reduce(Column.__or__, (F.size(F.array_intersect("told", _array(phrase.split(" ")))) == len(set(phrase.split(" "))) for phrase in PHRASES)), _phrases("w")).otherwise(F.expr(f"cast(array() as {_PLACES})"))
    rows = rows.select("doc_id", "text_key", "lower", F.size("w").cast("long").alias("n_words"), places.alias("places"), "told")
    if not own:
        return rows.select("doc_id", "text_key", "n_words", "places", F.expr(f"cast(array() as {_BLOCKS})").alias("blocks"))
    may = reduce(Column.__or__, (F.size(F.array_intersect("told", _array(words))) >= _need(words, containment) for _, _, words in own))
    blocks = F.when(may, _blocks(F.col("lower"), templates, containment)).otherwise(F.expr(f"cast(array() as {_BLOCKS})"))
    return rows.select("doc_id", "text_key", "n_words", "places", blocks.alias("blocks"))


def global_order(blocks: DataFrame, known: list[str]) -> list[str]:
    """The templates' tokens, those in fewest blocks first; ties by token. As many counts as templates have words reach the driver."""
    counts = {r.token: r.n for r in blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    return sorted(known, key=lambda w: (counts.get(w, 0), w))


def matches(blocks: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, text_key, template, label, share): the largest share of each template that a block of the text holds, if enough.

    blocks: doc_id, text_key, size, tokens, follows. The templates' prefixes are a table that is joined by token; Spark
    broadcasts it if it is small.
    """
    spark, own = blocks.sparkSession, template_tokens(templates)
    known = sorted({w for _, _, words in own for w in words})
    order = global_order(blocks, known)
    place = {w: k for k, w in enumerate(order)}
    index = []
    for number, label, words in own:
        need, ranked, pairs = _need(words, containment), sorted(words, key=place.__getitem__), _pairs(_cut(templates[number][1]))
        taken = sorted((sum(w in pair.split(" ") for pair in pairs) for w in words), reverse=True)
        least = max(0, len(pairs) - sum(taken[: len(words) - need]))  # the pairs left where the words in most pairs are lost
        index += [(w, number, label, p, need, ranked, pairs, least) for p, w in enumerate(ranked[: len(ranked) - need + 1])]
    small = spark.createDataFrame(index, "token string, template int, label string, place int, need int, ranked array<string>, pairs array<string>, least int")
    # known words of a block in global order; unknown ones don't count, so fewer may follow than size allows
    sorted_tokens = F.filter(_array(order), lambda w: F.array_contains("tokens", w))
    probes = blocks.select("doc_id", "text_key", "size", "follows", sorted_tokens.alias("tokens")).select("*", F.posexplode("tokens").alias("at", "token"))
    pairs = probes.join(small, "token")
    follow = F.least(F.size("ranked") - F.col("place"), F.size("tokens") - F.col("at"))
    pairs = pairs.where((F.col("size") >= F.col("need")) & (F.size("tokens") >= F.col("need")) & (follow + F.least("place", "at") >= F.col("need")))
    share = F.size(F.array_intersect("tokens", "ranked"))
    verified = pairs.withColumn("overlap", share).where(F.col("overlap") >= F.col("need"))
    verified = verified.where(F.col("follows").isNull() | (F.size(F.array_intersect("follows", "pairs")) >= F.col("least")))
    return verified.groupBy("doc_id", "text_key", "template", "label").agg(F.max(F.col("overlap") / F.size("ranked")).alias("share"))


def _phrases(words: str) -> Column:
    """Array of (start, label) of all places of all phrases among the words."""
    found = []
    for phrase, label in PHRASES.items():
        same = " and ".join(f"get({words}, i + {k}) = '{w}'" for k, w in enumerate(phrase.split(" ")))
        found.append(f"transform(filter(sequence(0, size({words}) - 1), i -> {same}), i -> struct(i as start, '{label}' as label))")
    return F.expr(f"concat({', '.join(found)})")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per row of docs: doc_id, n_words, places (start, label of every phrase), found (label, share of every template).

    Null texts count as empty and have neither. Rows that agree in doc_id and text, also with a null doc_id,
    have the same result. Other columns are left out, whatever their names. Without templates nothing is found.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    base = materialize(read(rows, templates, containment), "words")
    none = F.expr("cast(array() as array<struct<label:string,share:double>>)")
    if not templates:
        return base.select("doc_id", "n_words", "places", none.alias("found"))
    blocks = base.where(F.size("blocks") > 0).select("doc_id", "text_key", F.explode("blocks").alias("b")).select("doc_id", "text_key", "b.*")
    hits = matches(blocks, templates, containment).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_list(F.struct("label", "share")).alias("found"))
    both = base.drop("blocks").join(materialize(hits, "licenses"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    return both.select("doc_id", "n_words", "places", F.coalesce("found", none).alias("found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = lambda *xs: F.array_join(F.array_sort(F.array_distinct(F.concat(*(F.expr(f"transform({x}, x -> x.label)") for x in xs)))), ",")
    starts = F.expr("transform(places, p -> cast(p.start as bigint))")
    score = F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.expr("transform(found, f -> f.share)")), F.lit(0.0)))
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels("places").alias("base_labels"), labels("places", "found").alias("labels"), score.alias("score"))
