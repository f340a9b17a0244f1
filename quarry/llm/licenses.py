"""License scan: phrases, and an exact set-similarity join of text blocks with license templates.

A text's words are cut into overlapping blocks. A block meets a template when it holds at least the threshold's share of
the template's distinct words. Words are ordered by how many blocks hold them, rarest first, counted over the whole
input. A block that meets a template must share one of the template's first |T| - need + 1 words (prefix filter),
must hold ``need`` words of the templates' vocabulary (length filter), and from the place where both orders first meet
enough words must be left on both sides (positional filter). What passes is verified exactly. Templates are a fixed
list, so the index of their prefixes is a broadcast of known size; blocks are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.storage import Scratch, lower_ascii, sql_lower_ascii

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences by which common licenses are declared, as words, and their labels.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "copyright all rights reserved"),
)


def _spaces(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def scan_licenses(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.9, step: int = 32
) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``labels`` are those of the phrases and of templates that some block meets; ``score`` is the largest share of a
    template's words that a block which meets it holds, 1 where a phrase stands. Blocks start every ``step`` words, or as
    many as the longest template has if that is more, and are twice as long: a template that stands in a text lies in
    one block, however long it is. A null or empty text has no words, empty labels and
    score 0. Repeated rows each have their row; an empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "licenses")
    sets = [(label, sorted(set(text.split()))) for label, text in templates]
    step = max(step, *(len(text.split()) for _, text in templates))
    needs = [math.ceil(threshold * len(words) - 1e-9) for _, words in sets]
    vocabulary = sorted({w for _, words in sets for w in words})

    bare = F.trim(F.regexp_replace(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), NOT_WORD, " "))
    padded = docs.select("doc_id", F.when(bare == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), bare, F.lit(" "))).alias("pad"))
    n_words = _spaces(F.col("pad")) - 1
    counts, firsts, lasts, names = [], [], [], []
    for phrase, label in PHRASES.items():
        stands = F.contains("pad", F.lit(f" {phrase} "))
        counts.append(F.when(stands, F.regexp_count("pad", F.lit(rf" {phrase}(?= )"))).otherwise(0).cast("long"))
        firsts.append(F.when(stands, _spaces(F.substring_index("pad", f" {phrase} ", 1))))
        lasts.append(F.when(stands, n_words - len(phrase.split()) - _spaces(F.substring_index("pad", f" {phrase} ", -1))))
        names.append(F.when(stands, F.lit(label)))
    words = F.split(F.trim("pad"), " ")
    known = F.array(*map(F.lit, vocabulary))
    # vocabulary words of each block, as their places in the vocabulary; blocks that can't meet any template go
    held = F.transform(
        F.sequence(F.lit(1), F.greatest(n_words, F.lit(1)).cast("int"), F.lit(step)),
        lambda at: F.array_intersect(F.slice("words", at, F.lit(2 * step)), known),
    )
    codes = F.transform(F.filter(held, lambda b: F.size(b) >= min(needs)), lambda b: F.transform(b, lambda w: F.array_position(known, w).cast("int")))
    table = scratch.store(
        padded.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", n_words.alias("n_words"), sum(counts[1:], counts[0]).alias("n_base"),
            F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), F.array_compact(F.array(*names)).alias("base"), words.alias("words"), "pad",
        ).withColumn("blocks", codes).drop("words", "pad")
    )

    blocks = table.select("row", F.explode("blocks").alias("held"))
    heard = {r["code"]: r["n"] for r in blocks.select(F.explode("held").alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    order = sorted(range(1, len(vocabulary) + 1), key=lambda c: (heard.get(c, 0), c))
    rank_of = {c: r for r, c in enumerate(order)}
    code_of = {w: c for c, w in enumerate(vocabulary, 1)}
    index = []
    for (label, words_of), need in zip(sets, needs, strict=True):
        ranks = sorted(rank_of[code_of[w]] for w in words_of)
        index += [(r, i, label, ranks, need) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    prefixes = docs.sparkSession.createDataFrame(index, "rank int, place int, label string, ranks array<int>, need int")
    ranked = F.array_sort(F.transform("held", lambda c: F.element_at(F.array(*(F.lit(rank_of[c]) for c in range(1, len(vocabulary) + 1))), c)))
    probes = blocks.select("row", ranked.alias("own")).select("row", "own", F.posexplode("own").alias("at", "rank"))
    left = lambda size, place: F.size(size) - F.col(place) - 1
    candidates = probes.join(F.broadcast(prefixes), "rank").where(
        (F.size("own") >= F.col("need")) & (1 + F.least(left("own", "at"), left("ranks", "place")) + F.least(F.col("at"), F.col("place")) >= F.col("need"))
    )
    shared = F.size(F.array_intersect("own", "ranks"))
    met = candidates.where(shared >= F.col("need")).groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max(shared / F.size("ranks")).alias("share")
    )
    none = F.array().cast("array<string>")
    joined = table.drop("blocks").join(met, "row", "left")
    join_sorted = lambda names: F.array_join(F.sort_array(F.array_distinct(names)), ",")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", join_sorted(F.col("base")).alias("base_labels"),
        join_sorted(F.concat("base", F.coalesce("found", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _values(rows: list[tuple[list[str], str]]) -> str:
    return "(VALUES " + ", ".join(f"({words!r}, '{label}')" for words, label in rows) + ")"


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({sql_lower_ascii("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p AS (SELECT * FROM {_values([(k.split(), v) for k, v in PHRASES.items()])} v(phrase, label)),
places AS (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1 : i + len(phrase)] = phrase)) AS place FROM d, p),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS names FROM places GROUP BY r),
t AS (SELECT * FROM {_values([(sorted(set(text.split())), label) for label, text in TEMPLATES])} v(words, label)),
blocks AS (SELECT r, unnest(list_transform(range(0, greatest(len(w), 1), 32), lambda i: w[i + 1 : i + 64])) AS held FROM d),
shares AS (SELECT r, label, len(list_intersect(words, held)) AS shared, len(words) AS n FROM blocks, t),
met AS (SELECT r, list(DISTINCT label) AS found, max(shared / n) AS share FROM shares WHERE shared >= ceil(0.9 * n - 1e-9) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(names), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(names, []), coalesce(found, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN met USING (r)
"""
