"""License scan by an exact set-similarity join of text blocks with templates; DataFrames only.

1. How often each word of a template stands in all texts is counted (partial sums first).  Words
   are ordered by that, rarest first, for templates and blocks alike.
2. A template of s distinct words is met by a block that holds at least a = ceil(``share`` * s) of
   them.  Such a block holds one of the template's first s - a + 1 words in that order (prefix
   filter).  Texts without any of these words are passed over; of the others, blocks are kept that
   hold one of them and at least the smallest a of words of templates (length filter).
3. Words of kept blocks meet the templates' prefixes in a broadcast join.  A pair goes on if the
   words from the meeting word on, in either of the two orders, can still reach a (positional filter).
4. What is left is confirmed on whole sets.

Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased.  Blocks are runs of
twice as many words as the longest template has, each beginning one such length after the one
before, so that every passage as long as a template lies whole in a block.  Templates are a
parameter: everything that is broadcast or collected grows with them alone.

Defined cases: a null text is empty, has no words and no labels, and a score of 0.  Rows are
independent of each other but for the order of words, which changes no result; repeated rows and ids
are returned as often.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledger_jobs.llm.common import keep

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Part of a template's words that a block must hold.
SHARE = 0.9
# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Opening sentences of well-known licenses and usual one-line notices, with labels.
TEMPLATES = (
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
    ("zlib", "This software is provided as-is, without any express or implied warranty"),
)


def words_of(text: str) -> list[str]:
    return [w for w in re.split(NO_WORD, text.translate(str.maketrans(UPPER, LOWER))) if w]


@dataclass(frozen=True)
class Templates:
    """Templates as word sets; ``least``: words that a block must hold of each."""

    labels: list[str]
    words: list[list[str]]
    least: list[int]
    step: int

    @property
    def every(self) -> list[str]:
        return sorted({w for t in self.words for w in t})


def templates(rows: tuple[tuple[str, str], ...], share: float) -> Templates:
    runs = [words_of(text) for _, text in rows]
    sets = [sorted(set(r)) for r in runs]
    least = [max(1, math.ceil(round(share * len(s), 9))) for s in sets]
    return Templates([label for label, _ in rows], sets, least, max(map(len, runs)))


def _worded(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``line``: its words, one space between them."""
    low = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), UPPER, LOWER)
    return df.withColumn("line", F.trim(F.regexp_replace(low, NO_WORD, " ")))


def word_order(df: DataFrame, text_col: str, words: list[str]) -> list[str]:
    """The given words by how often they stand in all texts, rarest first, equal ones by name."""
    every = _worded(df.select(F.col(f"`{text_col}`")), text_col).select(F.explode(F.split("line", " ")).alias("word"))
    counts = {r.word: r.n for r in every.filter(F.col("word").isin(words)).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def _places(phrases: dict[str, str]) -> dict[str, Column]:
    """Counts and first and last places of phrases in ``line``, whose spaces are doubled in
    ``wide``: each word has spaces of its own, so that neighbours are counted."""
    count, low, high, labels = [], [], [], []
    words_in = lambda s: F.char_length(F.trim(s)) - F.char_length(F.replace(F.trim(s), F.lit(" "))) + F.when(F.trim(s) == "", 0).otherwise(1)
    single = lambda s: F.replace(s, F.lit("  "), F.lit(" "))
    for phrase, label in phrases.items():
        size, mark = len(phrase.split()), " " + phrase.replace(" ", "  ") + " "
        here = F.contains("line", F.lit(phrase)) & F.contains("wide", F.lit(mark))
        shorter = F.octet_length("wide") - F.octet_length(F.replace("wide", F.lit(mark)))
        count.append(F.when(here, shorter / len(mark.encode())).otherwise(0))
        low.append(F.when(here, words_in(single(F.substring_index("wide", mark, 1)))))
        high.append(F.when(here, F.col("n_words") - size - words_in(single(F.substring_index("wide", mark, -1)))))
        labels.append(F.when(here, F.lit(label)))
    return {
        "n_base": reduce(lambda a, b: a + b, count).cast("long"), "first_word": F.array_min(F.array(*low)).cast("long"),
        "last_word": F.array_max(F.array(*high)).cast("long"), "base": F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))),
    }


def blocks(df: DataFrame, id_col: str, text_col: str, wanted: Templates, prefix: list[str], phrases: dict[str, str]) -> DataFrame:
    """One row per row of ``df``, written: key, id, n_words, n_base, first_word, last_word, base, and
    ``blocks``, those that may meet a template: start and words of templates."""
    rows = _worded(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")), "text").drop("text")
    found = F.col("line").rlike("(?:^| )(?:" + "|".join(map(re.escape, prefix)) + ")(?: |$)")
    phrased = reduce(or_, [F.contains("line", F.lit(p)) for p in phrases])
    rows = rows.withColumns(
        {
            "n_words": F.when(F.col("line") == "", 0).otherwise(F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "))) + 1).cast("long"),
            "wide": F.when(phrased, F.concat(F.lit(" "), F.replace("line", F.lit(" "), F.lit("  ")), F.lit(" "))).otherwise(""),
            "words": F.when(found, F.split("line", " ")),
        }
    )
    step, every = wanted.step, wanted.every
    last = F.greatest(F.ceil(F.size("words") / step) - 2, F.lit(0)).cast("int")

    def block(k: Column) -> Column:
        held = F.array_distinct(F.filter(F.slice("words", k * step + 1, F.lit(2 * step)), lambda w: w.isin(every)))
        return F.struct((k * step).alias("start"), held.alias("words"))

    may = lambda b: (F.size(b.words) >= min(wanted.least)) & F.exists(b.words, lambda w: w.isin(prefix))
    kept = F.when(F.col("words").isNotNull(), F.filter(F.transform(F.sequence(F.lit(0), last), block), may))
    return keep(rows.select(F.monotonically_increasing_id().alias("key"), "id", "n_words", *[c.alias(n) for n, c in _places(phrases).items()], kept.alias("blocks")), "license-blocks")


def join(rows: DataFrame, wanted: Templates, order: list[str]) -> DataFrame:
    """(key, id, start, template, label, overlap, containment) of blocks that meet a template."""
    spark, rank = rows.sparkSession, {w: k for k, w in enumerate(order)}
    index = [
        (word, k, place + 1, len(t), wanted.least[k], t)
        for k, t in enumerate(wanted.words)
        for place, word in enumerate(sorted(t, key=rank.__getitem__)[: len(t) - wanted.least[k] + 1])
    ]
    index = spark.createDataFrame(index, "word string, template int, place int, size int, least int, template_words array<string>")
    labels = F.get(F.array(*map(F.lit, wanted.labels)), F.col("template"))
    ranks = F.create_map(*[F.lit(x) for w, k in rank.items() for x in (w, k)])
    ordered = F.transform(F.array_sort(F.transform("words", lambda w: F.struct(F.element_at(ranks, w).alias("rank"), w.alias("word")))), lambda x: x.word)
    words = rows.select("key", "id", F.inline("blocks")).withColumn("words", ordered).select("key", "id", "start", "words", F.posexplode("words").alias("at", "word"))
    reach = 1 + F.least(F.col("size") - F.col("place"), F.size("words") - F.col("at") - 1)
    pairs = words.join(F.broadcast(index), "word").filter((F.size("words") >= F.col("least")) & (reach >= F.col("least")))
    pairs = pairs.groupBy("key", "start", "template").agg(*[F.first(c).alias(c) for c in ("id", "words", "template_words", "size", "least")])
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect("words", "template_words"))).filter("overlap >= least")
    return pairs.select("key", "id", "start", "template", labels.alias("label"), "overlap", (F.col("overlap") / F.col("size")).alias("containment"))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: tuple[tuple[str, str], ...] = TEMPLATES, share: float = SHARE, phrases: dict[str, str] = PHRASES) -> tuple[DataFrame, DataFrame]:
    """(rows, matches): one row per row of ``df`` as ``blocks`` gives it, and as ``join`` gives them
    the blocks that meet a template."""
    wanted = templates(rows, share)
    order = word_order(df, text_col, wanted.every)
    rank = {w: k for k, w in enumerate(order)}
    prefix = sorted({w for t, a in zip(wanted.words, wanted.least, strict=True) for w in sorted(t, key=rank.__getitem__)[: len(t) - a + 1]})
    found = blocks(df, id_col, text_col, wanted, prefix, phrases)
    return found, join(found.filter(F.size("blocks") > 0), wanted, order)


def labelled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per row of ``df``: id, n_words, n_base, first_word, last_word, base_labels, labels,
    score: 1 if a phrase stands in the text, else the largest containment that met a template, or 0."""
    found, matches = scan(df, id_col, text_col, **how)
    best = matches.groupBy("key").agg(F.collect_set("label").alias("met"), F.max("containment").alias("containment"))
    out = found.drop("blocks").join(best, "key", "left")
    joined = F.array_join(F.array_sort(F.array_union("base", F.coalesce("met", F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0)))
    return out.select("id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), joined.alias("labels"), score.alias("score"))
