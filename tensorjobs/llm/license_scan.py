"""License scans: phrases at their places, and texts that hold most of a license's wording, by an exact set-similarity join.

Words are runs of letters a-z (A-Z lower-cased), digits and characters beyond ASCII. A text is seen as blocks of BLOCK words,
one from every BLOCK / 2 words on; a block is a set of words. A template (a line or notice of a license) is found where
a block contains at least CONTAINED percent of its distinct words (all, if they are fewer than SHORT). The join finds every such block:

1. Template words are ordered by their number of occurrences in all documents, rarest first (`frequencies`).
2. Prefix filter: of a template with t words, of which o are required, one of the t - o + 1 rarest must be in the block. Documents without
   any such word are left after one look at the text; of the others, only words that templates have travel.
3. A block's words, in the same order, meet template prefixes by equality. Length filter: the block has o of the templates'
   words at least. Positional filter: the words that both have left from the first common one on reach o.
4. What is left is verified by the intersection.

Blocks are told apart by a 128-bit hash of their text, so copies of a text are examined once; the results go back to documents by a join with
the hash, dealt out over SALT parts, as a text may have very many copies.

Defined results: null and empty texts have no words and no labels; texts of any length are taken whole; copies and repeated
rows are judged alike; other columns are ignored, whatever their names; a null id is kept; an empty table gives
an empty result. The score is 1 with a phrase, else the largest share of a template that a block contains, if it is found, else 0.

Built-in functions and joins only.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, table

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Lines and opening notices of public licenses, by label (fixed values: words of the licenses themselves).
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
BLOCK = 64
#: Percent of a template's distinct words; of templates with fewer than SHORT words all, as one word tells such licenses apart.
CONTAINED, SHORT = 85, 10
SALT = 16
#: Templates of one join; they and their words are broadcast.
MOST = 10_000
#: Word characters before lower-casing, and their opposites.
WORD, GAP = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z, in order."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP + "+"), lambda w: w != "")


def phrase_places(text: Column, phrases: dict[str, str] = PHRASES) -> Column:
    """Structs (at, label) of the places where a phrase's words stand one after the other; at is the first one's number."""
    parts = [(p.split(), label) for p, label in phrases.items()]
    some = "|".join(f"{GAP}+".join(p) for p, _ in parts)

    def of(w: Column, p: list[str], label: str) -> Column:
        hit = lambda x, i: reduce(and_, [F.coalesce(F.get(w, i + k) == p[k], F.lit(False)) for k in range(1, len(p))], x == p[0])
        found = F.transform(w, lambda x, i: F.when(hit(x, i), F.struct(i.cast("long").alias("at"), F.lit(label).alias("label"))))
        return F.filter(found, lambda x: x.isNotNull())

    def places(w: Column) -> Column:
        return F.concat(*[of(w, p, label) for p, label in parts])

    none = F.expr("cast(array() as array<struct<at:bigint,label:string>>)")
    return F.when(text.rlike(rf"(?i)(?<!{WORD})(?:{some})(?!{WORD})"), let(words_of(text), places)).otherwise(none)


def frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """Occurrences of the given words (a list of proven size) in all documents."""
    known = docs.sparkSession.createDataFrame([(w,) for w in words], "word string")
    each = docs.select(F.explode(F.split(F.lower("text"), GAP + "+")).alias("word"))
    return dict.fromkeys(words, 0) | {r["word"]: r["n"] for r in each.join(F.broadcast(known), "word").groupBy("word").agg(F.count("*").alias("n")).collect()}


def index(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, contained: int = CONTAINED) -> tuple[list[str], list[tuple[int, str, list[int], int]]]:
    """(template words, rarest first; templates as (id, label, ranks of its words in order, words required))."""
    if len(templates) > MOST:
        raise ValueError(f"{len(templates)} templates; join them in parts of {MOST} at most and unite what they find")
    sets = [(label, set(_plain(text))) for label, text in templates]
    count = frequencies(docs, sorted(set().union(*[s for _, s in sets])))
    order = sorted(count, key=lambda w: (count[w], w))
    rank = {w: i for i, w in enumerate(order)}
    return order, [(i, label, sorted(rank[w] for w in s), required(len(s), contained)) for i, (label, s) in enumerate(sets) if s]


def required(n: int, contained: int = CONTAINED) -> int:
    """Words that a block must have of a template with n."""
    return n if n < SHORT else -(-contained * n // 100)


def _plain(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def found_templates(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, contained: int = CONTAINED, block: int = BLOCK) -> DataFrame:
    """(key, block, template, label, n_common, n_words): every block (numbered by its start / half a block) of a distinct text that contains enough of a template.

    docs: text, key (a hash of the text).
    """
    spark = docs.sparkSession
    order, made = index(docs, templates, contained)
    if not made:
        return spark.createDataFrame([], "key string, block long, template int, label string, n_common int, n_words int")
    prefixes = [(r, i, at, len(ranks), need) for i, _, ranks, need in made for at, r in enumerate(ranks[: len(ranks) - need + 1])]
    ranks = F.broadcast(spark.createDataFrame(list(enumerate(order)), "rank int, word string"))
    prefix = F.broadcast(spark.createDataFrame(prefixes, "rank int, template int, at int, size int, need int"))
    whole = F.broadcast(spark.createDataFrame([(i, label, r, need) for i, label, r, need in made], "template int, label string, ranks array<int>, need int"))
    rare = sorted({order[p[0]] for p in prefixes})
    # lower() also turns letters beyond ASCII, which can only let a text too many through
    has_rare = F.arrays_overlap(F.split(F.lower("text"), GAP + "+"), F.array(*map(F.lit, rare)))
    likely = docs.where(has_rare).select("key", F.posexplode(words_of(F.col("text"))).alias("pos", "word"))
    half = block // 2
    number = F.floor(F.col("pos") / half).cast("long")
    # a word is in the block that begins in its half block and in the one before
    placed = likely.join(ranks, "word").select("key", "rank", F.explode(F.when(number > 0, F.array(number, number - 1)).otherwise(F.array(number))).alias("block"))
    sets = placed.groupBy("key", "block").agg(F.array_sort(F.collect_set("rank")).alias("own"))  # at most `block` words
    met = sets.select("key", "block", "own", F.posexplode("own").alias("own_at", "rank")).join(prefix, "rank")
    met = met.where((F.size("own") >= F.col("need")) & (F.least(F.col("size") - F.col("at"), F.size("own") - F.col("own_at")) >= F.col("need")))
    pairs = met.select("key", "block", "own", "template").distinct()
    common = F.size(F.array_intersect("own", "ranks"))
    return pairs.join(whole, "template").where(common >= F.col("need")).select("key", "block", "template", "label", common.alias("n_common"), F.size("ranks").alias("n_words"))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, contained: int = CONTAINED, block: int = BLOCK, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score per row of docs (doc_id, text)."""
    text = F.col("text")
    docs = docs.select("doc_id", "text")
    keyed = docs.withColumn("key", F.md5("text"))
    found = found_templates(keyed.select("text", "key"), templates, contained, block)
    found = cut(found.groupBy("key").agg(F.collect_set("label").alias("more"), F.max(F.col("n_common") / F.col("n_words")).alias("share")), "licenses")
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt")
    based = keyed.select("doc_id", "key", F.coalesce(F.regexp_count("text", F.lit(WORD + "+")), F.lit(0)).cast("long").alias("n_words"), phrase_places(text, phrases).alias("places"))
    based = based.withColumn("salt", (F.monotonically_increasing_id() % SALT).cast("int"))
    joined = based.join(found.select("key", "more", "share", parts), ["key", "salt"], "left")
    starts = F.transform("places", lambda x: x["at"])
    base = F.array_distinct(F.transform("places", lambda x: x["label"]))
    line = lambda a: F.array_join(F.array_sort(a), ",")
    labels = F.array_distinct(F.concat(base, F.coalesce("more", F.expr("cast(array() as array<string>)"))))
    return joined.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        line(base).alias("base_labels"), line(labels).alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    phrases = ", ".join(f"({quoted(p.split())}, '{label}')" for p, label in PHRASES.items())
    sets = [(label, sorted(set(_plain(text)))) for label, text in TEMPLATES]
    templates = ", ".join(f"('{label}', {quoted(s)}, {required(len(s))})" for label, s in sets)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(words, label) AS (VALUES {phrases}),
t(label, words, need) AS (VALUES {templates}),
place AS (SELECT rid, i - 1 AS pos, p.label FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d) x JOIN p ON x.w[i : i + len(p.words) - 1] = p.words),
base AS (SELECT rid, count(*) AS n, min(pos) AS first, max(pos) AS last, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM place GROUP BY rid),
block AS (SELECT DISTINCT rid, list_distinct(w[b * {BLOCK // 2} + 1 : b * {BLOCK // 2} + {BLOCK}]) AS own FROM (SELECT rid, w, unnest(range(0, (len(w) + {BLOCK // 2 - 1}) // {BLOCK // 2})) AS b FROM d)),
hit AS (SELECT rid, label, len(list_intersect(own, words)) / len(words) AS share FROM block JOIN t ON len(list_intersect(own, words)) >= need),
every AS (SELECT rid, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM (SELECT rid, label FROM place UNION ALL SELECT rid, label FROM hit) GROUP BY rid),
best AS (SELECT rid, max(share) AS share FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.first::BIGINT AS first_word, base.last::BIGINT AS last_word, coalesce(base.labels, '') AS base_labels,
  coalesce(every.labels, '') AS labels, CASE WHEN base.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN every USING (rid) LEFT JOIN best USING (rid)"""


ORACLE_SQL = _sql()
