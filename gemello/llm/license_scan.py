"""Licence scans by diagonal voting, in DataFrame operations only.

1. Every text becomes words; at each place the hashes of its word k-grams (k = 2 and 4) are looked up among the grams of the templates.
   A hit is kept only if the words themselves are equal, so that a hash never decides.
2. Hits vote by diagonal: the place in the text less the place in the template. One diagonal is one alignment without gaps.
3. Diagonals that lie within a few words of each other are merged: words put in or left out move the rest of a notice to a neighbour.
4. Spans are verified: all but one in ten of the template's words must be covered by grams of the span (all, under ten words), by a single
   diagonal or by merged ones whose span is no more than twice as long as the template.

A base phrase stands at a place if all its grams vote for that diagonal, so that places are exact.

Null and empty texts have no words: no places, no labels, score 0. Each row is scanned on its own, so repeated rows and null ids stay as they
are. An empty table gives no rows. A very long text is one row of the first pass and as many narrow rows as it has hits afterwards. Hits of one
row are never tied: a span that covers more wins the score, and labels are sets. Columns other than doc_id and text, whatever their names, are
not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gemello.llm.exact_dedup import normalized
from gemello.session import written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lengths of grams; a template takes the greatest that fits.
GRAMS = (2, 4)
#: Diagonals at most so far apart are neighbours, and at most a third of the template's words.
GAP = 4
#: One template word in so many may be missing from a span.
MISSING = 10
#: A span of merged diagonals may be so many times as long as its template.
STRETCH = 2
#: Grams of templates up to which their table is broadcast (some 10 MB); a larger one is joined by a shuffle.
BROADCAST_GRAMS = 100_000


@dataclass(frozen=True)
class Template:
    """A text that stands for a label; base ones count only where all their words stand consecutively."""

    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), self.text))

    @property
    def gram(self) -> int:
        if len(self.words) < GRAMS[0]:
            raise ValueError(f"a template needs {GRAMS[0]} words: {self.text!r}")
        return max(k for k in GRAMS if k <= len(self.words))


BASE = [Template(label, text, True) for text, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))]

NOTICES = [
    Template(label, text)
    for label, text in (
        ("agpl", "GNU Affero General Public License"),
        ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
        ("apache-2.0", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
        ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
        ("bsl-1.0", "Boost Software License, Version 1.0"),
        ("cc-by", "Creative Commons Attribution"),
        ("cc-by-4.0", "CC BY 4.0"),
        ("cc-by-nc", "CC BY-NC"),
        ("cc-by-nc", "Creative Commons Attribution-NonCommercial"),
        ("cc-by-nc-4.0", "CC BY-NC 4.0"),
        ("cc-by-nd", "CC BY-ND"),
        ("cc-by-nd", "Creative Commons Attribution-NoDerivatives"),
        ("cc-by-sa", "CC BY-SA"),
        ("cc-by-sa", "Creative Commons Attribution-ShareAlike"),
        ("cc0", "CC0 1.0 Universal"),
        ("epl-2.0", "Eclipse Public License 2.0"),
        ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
        ("gpl-2.0", "GNU General Public License, version 2"),
        ("gpl-3.0", "GNU General Public License, version 3"),
        ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
        ("lgpl", "GNU Lesser General Public License"),
        ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
        ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
        ("mpl-2.0", "Mozilla Public License, version 2.0"),
        ("unlicense", "This is free and unencumbered software released into the public domain"),
        ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable"),
    )
]


def template_table(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(template, label, base, words, k): the templates by their number, with the length of their grams."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.text).alias("text"), F.lit(t.gram).alias("k")) for i, t in enumerate(templates)]
    return spark.range(1).select(F.inline(F.array(*rows))).select("template", "label", "base", words_of(F.col("text")).alias("words"), "k")


def small(table: DataFrame, templates: list[Template]) -> DataFrame:
    """A table of templates or their grams, marked for broadcast if they are few enough."""
    return F.broadcast(table) if sum(len(t.words) for t in templates) <= BROADCAST_GRAMS else table


def template_grams(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """(template, tpos, k, gram, template_hash) of every place of every template."""
    places = template_table(spark, templates).select("template", "words", "k", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("k"))).alias("tpos"))
    hashed = F.coalesce(*[F.when(F.col("k") == k, gram_hash(F.col("words"), F.col("tpos"), k)) for k in GRAMS])
    return places.select("template", "tpos", "k", F.slice("words", F.col("tpos") + 1, F.col("k")).alias("gram"), hashed.alias("template_hash"))


def words_of(text):
    """The words of a text; split() leaves an empty one where a text begins or ends between words."""
    return F.array_remove(F.split(normalized(text), BETWEEN), "")


def gram_hash(words, at, k: int):
    return F.xxhash64(F.lit(k), *[F.get(words, at + i) for i in range(k)])


def hits(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """(row, doc_id, n_words, pos, template, tpos): each place of a text where a template's gram stands, and a row without template for
    each text whose first place has none. row numbers the rows of docs; the table is written, so that numbers stay."""
    of = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    at = of.select("row", "doc_id", "words", F.size("words").cast("long").alias("n_words"), F.posexplode_outer("words").alias("pos", "word"))
    grams = at.select("row", "doc_id", "words", "n_words", "pos", F.posexplode(F.array(*[F.when(F.col("pos") + k <= F.col("n_words"), gram_hash(F.col("words"), F.col("pos"), k)) for k in GRAMS])).alias("which", "hash"))
    table = small(template_grams(docs.sparkSession, templates), templates)
    same = (F.col("hash") == F.col("template_hash")) & (F.slice("words", F.coalesce("pos", F.lit(0)) + 1, F.col("k")) == F.col("gram"))
    found = grams.join(table, same, "left").filter("template IS NOT NULL OR (which = 0 AND coalesce(pos, 0) = 0)")
    return written(found.select("row", "doc_id", "n_words", F.col("pos").cast("long").alias("pos"), "template", "tpos"), "licence-hits")


def covered(places: str, gram: str) -> str:
    """SQL: the words that grams at the sorted places of a template cover."""
    return f"aggregate(transform({places}, (p, i) -> least({gram}, coalesce(get({places}, i + 1) - p, {gram}))), 0, (a, b) -> a + b)"


def spans(found: DataFrame, templates: list[Template]) -> DataFrame:
    """(row, template, first, last, covered, words, exact): the merged spans of hits; first and last are places of words, the last one's
    after the end. exact: diagonals of the span on which the whole template stands; low and high: the least and greatest of them."""
    of = template_table(found.sparkSession, templates).select("template", F.size("words").alias("words"), "k")
    votes = found.filter("template IS NOT NULL").groupBy("row", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.sort_array(F.collect_set("tpos")).alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    votes = votes.join(small(of, templates), "template").withColumn("covered", F.expr(covered("places", "k")))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.least(F.lit(GAP), F.floor(F.col("words") / 3)), F.lit(False))
    merged = (
        votes.withColumn("far", far.cast("int"))
        .withColumn("group", F.sum("far").over(order))
        .groupBy("row", "template", "words", "k", "group")
        .agg(
            F.min("first").alias("first"), (F.max("last") + F.first("k")).alias("last"), F.max("covered").alias("one"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("places")))).alias("places"),
            F.count_if(F.col("covered") == F.col("words")).alias("exact"), F.min(F.when(F.col("covered") == F.col("words"), F.col("diagonal"))).alias("low"), F.max(F.when(F.col("covered") == F.col("words"), F.col("diagonal"))).alias("high"),
        )
    )
    whole = F.when(F.col("last") - F.col("first") <= STRETCH * F.col("words"), F.expr(covered("places", "k"))).otherwise(F.col("one"))
    return merged.select("row", "template", "first", "last", F.greatest("one", whole).alias("covered"), "words", "exact", "low", "high")


def verified(found: DataFrame, templates: list[Template]) -> DataFrame:
    """The spans of hits that stand for their template's label, with label and base."""
    names = template_table(found.sparkSession, templates).select("template", "label", "base")
    return spans(found, templates).join(small(names, templates), "template").filter(F.when(F.col("base"), F.col("exact") > 0).otherwise((F.col("words") - F.col("covered")) * MISSING <= F.col("words")))


def scan(docs: DataFrame, base: list[Template] = BASE, notices: list[Template] = NOTICES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base, first_word and last_word are of the base templates' places. labels has the base labels and those of verified spans; score is the
    greatest share of a template's words that a labelled span covers, 0 without one.
    """
    found = hits(docs, [*base, *notices])
    good = verified(found, [*base, *notices])
    of_row = good.groupBy("row").agg(
        F.sum(F.when(F.col("base"), F.col("exact"))).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("low"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("high"))).alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max(F.when(F.col("base"), F.lit(1.0)).otherwise(F.col("covered") / F.col("words"))).alias("score"),
    )
    rows = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"))
    text = lambda c: F.coalesce(F.array_join(F.sort_array(c), ","), F.lit(""))
    return rows.join(of_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        text("base_labels").alias("base_labels"), text("labels").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def labelled_spans(docs: DataFrame, base: list[Template] = BASE, notices: list[Template] = NOTICES) -> DataFrame:
    """(doc_id, label, first, last, covered, words): the verified spans themselves, in words from 0, last after the end."""
    found = hits(docs, [*base, *notices])
    ids = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"))
    return verified(found, [*base, *notices]).join(ids, "row").select("doc_id", "label", "first", "last", "covered", "words")
