"""License scans: phrases, and templates found by voting of word k-grams on offset diagonals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, texts

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: label: phrase, whose words must stand one after another.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Words of a k-gram; diagonals that are merged are at most SHIFT words apart; a template counts from this share of its words on.
K, SHIFT, COVERED = 3, 4, 0.8
#: (label, notice): openings and short notices of well-known licenses. Templates of fewer than K words do not vote.
TEMPLATES = (
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "licensed under the GNU General Public License"),
    ("lgpl", "GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "released under the BSD License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits; what is not ASCII counts as a letter."""
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(template, label, n_template, gram, at, grams): a row per distinct word k-gram and place; a few hundred rows of constants."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "template int, label string, text string")
    rows = rows.withColumn("w", words_of(F.col("text"))).where(F.size("w") >= k)
    grams = F.posexplode(F.expr(f"transform(sequence(1, size(w) - {k - 1}), i -> array_join(slice(w, i, {k}), ' '))"))
    return rows.select("template", "label", F.size("w").alias("n_template"), grams.alias("at", "gram")).withColumn("h", F.xxhash64("gram"))


def _row_key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("text_hash")]


def votes(docs: DataFrame, templates=TEMPLATES, k: int = K) -> DataFrame:
    """(doc_id, text_hash, template, label, n_template, diagonal, first, last, votes): by text, template and diagonal.

    Every k-gram hash of every text meets the template places of that hash. The templates are constants, so their side
    is broadcast; a match is kept if the words themselves agree.
    """
    w = docs.select(*_row_key(), words_of(F.col("text")).alias("w"))
    joined = f"CASE WHEN size(w) >= {k} THEN transform(sequence(1, size(w) - {k - 1}), i -> array_join(slice(w, i, {k}), ' ')) END"
    grams = w.select("doc_id", "text_hash", F.posexplode_outer(F.expr(joined)).alias("place", "g")).withColumn("h", F.xxhash64("g"))  # no array of words goes on beside each row
    known = F.broadcast(template_grams(docs.sparkSession, templates, k))
    same = F.array_position(F.array("g"), F.col("gram")) > 0  # no join key: it is only looked at where the hashes agree
    met = grams.join(known, (grams["h"] == known["h"]) & same).select("doc_id", "text_hash", "template", "label", "n_template", (F.col("place") - F.col("at")).alias("diagonal"), "place", "at")
    return met.groupBy("doc_id", "text_hash", "template", "label", "n_template", "diagonal").agg(
        F.min("place").alias("first"), F.max("place").alias("last"), F.collect_set("at").alias("ats")
    )


def spans(docs: DataFrame, templates=TEMPLATES, k: int = K, shift: int = SHIFT, covered: float = COVERED) -> DataFrame:
    """(doc_id, text_hash, template, label, first, last, share): verified places of templates.

    A text's diagonals of a template are merged while each is within shift of the one before, as an inserted or lost word
    makes it, and their first places lie within two lengths of the template. The span is verified by the share of the
    template's words that its matched k-grams cover.
    """
    found = votes(docs, templates, k)
    by = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")  # rows: diagonals of one template in one text
    new = (F.col("diagonal") - F.lag("diagonal").over(by) > shift) | (F.abs(F.col("first") - F.lag("first").over(by)) > 2 * F.col("n_template"))
    merged = found.withColumn("island", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(by))
    merged = merged.groupBy("doc_id", "text_hash", "template", "label", "n_template", "island").agg(
        F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"), F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats")
    )
    reached = F.expr(f"size(array_distinct(flatten(transform(ats, a -> sequence(a, a + {k - 1})))))")
    return merged.withColumn("share", reached / F.col("n_template")).where(F.col("share") >= covered).select("doc_id", "text_hash", "template", "label", "first", "last", "share")


def _places(phrase: str) -> Column:
    """Places of a phrase's first word, in the column w; texts without its rarest word are passed over quickly."""
    words = phrase.split()
    test = " AND ".join(f"get(w, i + {j}) = '{x}'" for j, x in enumerate(words))
    some = " AND ".join(f"array_contains(w, '{x}')" for x in sorted(set(words), key=len, reverse=True))
    return F.expr(f"CASE WHEN {some} THEN filter(sequence(0, size(w) - 1), i -> {test}) ELSE cast(array() AS array<int>) END")


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 with a base phrase, else the largest covered share of a verified template, else 0. Null texts count as empty.
    Repeated rows keep a row each with the same result, and a null doc_id is a value like any other. What is shuffled is
    a few numbers a document and the matches, never a text.
    """
    rows = texts(docs).select(*_row_key(), words_of(F.col("text")).alias("w"))
    for i, phrase in enumerate(PHRASES.values()):
        rows = rows.withColumn(f"p{i}", _places(phrase))
    all_of = F.concat(*(f"p{i}" for i in range(len(PHRASES))))
    present = F.filter(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES))), lambda x: x.isNotNull())
    base = rows.select(
        "doc_id", "text_hash", F.size("w").cast("long").alias("n_words"), F.size(all_of).cast("long").alias("n_base"),
        F.array_min(all_of).cast("long").alias("first_word"), F.array_max(all_of).cast("long").alias("last_word"), present.alias("present"),
    )
    more = spans(texts(docs), templates).groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    more = more.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "more", "share")
    both = base.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    labels = F.array_sort(F.array_union("present", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("present"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


_SPLIT = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_VALUES = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
_GRAM = f"array_to_string(w[i + 1:i + {K}], ' ')"


def _sql_places(phrase: str) -> str:
    words = phrase.split()
    return "list_filter(range(0, len(w)), lambda i: " + " AND ".join(f"coalesce(w[i + {j + 1}] = '{x}', false)" for j, x in enumerate(words)) + ")"


OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), {_SPLIT}), lambda x: x <> '') AS w FROM documents),
t AS (SELECT template, label, list_filter(regexp_split_to_array(lower(text), {_SPLIT}), lambda x: x <> '') AS w FROM (VALUES {_VALUES}) AS v(template, label, text)),
tg AS (SELECT template, label, n, i AS spot, {_GRAM} AS gram FROM (SELECT template, label, len(w) AS n, w, unnest(range(0, len(w) - {K - 1})) AS i FROM t WHERE len(w) >= {K})),
dg AS (SELECT r, i AS place, {_GRAM} AS gram FROM (SELECT r, w, unnest(range(0, len(w) - {K - 1})) AS i FROM d WHERE len(w) >= {K})),
v AS (SELECT r, template, label, n, place - spot AS diagonal, min(place) AS first, list(DISTINCT spot) AS spots FROM dg JOIN tg USING (gram) GROUP BY ALL),
m AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o > {SHIFT} OR abs(first - lag(first) OVER o) > 2 * n THEN 1 ELSE 0 END AS new FROM v WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)),
s AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS island FROM m),
c AS (SELECT r, label, count(DISTINCT spot + x) / n AS share FROM (SELECT r, template, label, n, island, unnest(spots) AS spot FROM s), (SELECT unnest(range(0, {K})) AS x) GROUP BY r, template, label, n, island),
f AS (SELECT r, list(DISTINCT label) AS more, max(share) AS share FROM c WHERE share >= {COVERED} GROUP BY r),
b AS (SELECT r, doc_id, len(w) AS n_words, {", ".join(f"{_sql_places(p)} AS p{i}" for i, p in enumerate(PHRASES.values()))} FROM d),
e AS (SELECT *, list_concat(list_concat(p0, p1), p2) AS places, list_filter([{", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, label in enumerate(PHRASES))}], lambda x: x IS NOT NULL) AS present FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
  array_to_string(list_sort(present), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(present, coalesce(more, [])))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM e LEFT JOIN f USING (r)
"""
