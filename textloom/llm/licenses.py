"""License scans by diagonal voting.

Every run of three words of every text is joined, by hash and then by its
words, to the places of such runs in the license templates. A hit at word p of
a text and t of a template lies on the diagonal p - t: hits of one copy of a
notice share a diagonal, or lie on neighbouring ones where words were put in or
left out. Hits are counted by diagonal, diagonals up to two apart are merged,
and a merged span is verified: it counts if enough of the template's runs
stand in it.

Only DataFrame functions are used. The templates are a fixed list, so their
table has a fixed size and is broadcast. Of the exploded words only hits are
kept, and one mark a text that carries its number of words; texts are read once
and not shuffled.

Edge cases: null counts as empty; a text without words has counts 0, null
places, empty labels and score 0. Repeated rows get a row each, with like
results; rows of equal id are told apart by their text's hash. Only the two
named columns are read, so other columns cannot clash. An empty table gives an
empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import scratch

K = 3
#: Diagonals this far apart are merged; the part of a template's runs that a span must have.
APART, COVER = 2, 0.6
#: Words, in a text as it is: letters of either case, digits and all beyond ASCII; and what stands between them.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases of the base rule and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices of common licenses, by label. One label can have several.
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "Unauthorized copying of this file, via any medium is strictly prohibited"),
]


def template_grams() -> list[tuple[int, str, int, int, str, str, str]]:
    """(template, label, place, number of runs, and three words) for each run of each template."""
    out = []
    for n, (label, text) in enumerate(TEMPLATES):
        w = re.findall(WORD, text.lower())
        out += [(n, label, i, len(w) - K + 1, *w[i : i + K]) for i in range(len(w) - K + 1)]
    return out


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _lower(text: Column) -> Column:
    """Lower case. Of all other letters only the Kelvin sign would turn into an ASCII one, so it is changed first."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cover: float = COVER) -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best cover of
    a verified notice; a base phrase alone gives 0.5 at least) and n_notices."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    grams = spark.sql(f"SELECT *, xxhash64(a, b, c) AS h FROM VALUES {_values(template_grams())} AS t(template, label, t, runs, a, b, c)")
    base3 = {tuple(p.split()): label for p, label in BASE.items() if len(p.split()) == 3}
    base2 = {tuple(p.split()): label for p, label in BASE.items() if len(p.split()) == 2}
    # A null after the last word is a mark that every text has: its place is the number of words. So one pass finds both.
    w = F.concat(F.array_remove(F.split(_lower(F.col("text")), BETWEEN), ""), F.array(F.lit(None).cast("string")))
    far = F.lit(2**31 - 1)
    rows = d.select("id", "tie", w.alias("w")).select("id", "tie", F.posexplode(F.arrays_zip(F.col("w").alias("x"), F.slice("w", 2, far).alias("y"), F.slice("w", 3, far).alias("z"))).alias("p", "g"))
    rows = rows.select("id", "tie", F.col("p").cast("long").alias("p"), F.col("g.x").alias("x"), F.col("g.y").alias("y"), F.col("g.z").alias("z"))
    phrase = F.lit(None).cast("string")
    for (a, b), label in base2.items():
        phrase = F.when((F.col("x") == a) & (F.col("y") == b), label).otherwise(phrase)
    for (a, b, c), label in base3.items():
        phrase = F.when((F.col("x") == a) & (F.col("y") == b) & (F.col("z") == c), label).otherwise(phrase)
    same = (F.xxhash64("x", "y", "z") == F.col("h")) & (F.col("x") == F.col("a")) & (F.col("y") == F.col("b")) & (F.col("z") == F.col("c"))
    mark = F.col("x").isNull()
    hits = rows.join(F.broadcast(grams), same, "left").withColumn("phrase", phrase).where(mark | F.col("phrase").isNotNull() | F.col("template").isNotNull())
    # Repeated rows would vote twice; how often a row stands is kept.
    hits = scratch.write(hits.groupBy("id", "tie", "p", mark.alias("mark"), "phrase", "template", "label", "t", "runs").agg(F.count("*").alias("rows")))

    base = hits.where(F.col("phrase").isNotNull()).select("id", "tie", "p", "phrase").distinct().groupBy("id", "tie").agg(F.count("*").alias("n_base"), F.min("p").alias("first_word"), F.max("p").alias("last_word"), F.collect_set("phrase").alias("base_set"))
    line = hits.where(F.col("template").isNotNull()).withColumn("diagonal", F.col("p") - F.col("t")).groupBy("id", "tie", "template", "label", "runs", "diagonal").agg(F.collect_set("t").alias("ts"))
    along = Window.partitionBy("id", "tie", "template").orderBy("diagonal")
    line = line.withColumn("new", F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= APART, 0).otherwise(1)).withColumn("span", F.sum("new").over(along))
    spans = line.groupBy("id", "tie", "template", "label", "runs", "span").agg((F.size(F.array_distinct(F.flatten(F.collect_list("ts")))) / F.col("runs")).alias("cover")).where(F.col("cover") >= cover)
    notices = spans.groupBy("id", "tie").agg(F.collect_set("label").alias("label_set"), F.max("cover").alias("best"), F.count("*").alias("n_notices"))

    notices = notices.withColumnsRenamed({"id": "id2", "tie": "tie2"})
    found = base.join(notices, F.col("id").eqNullSafe(F.col("id2")) & (F.col("tie") == F.col("tie2")), "full").select(F.coalesce("id", "id2").alias("i"), F.coalesce("tie", "tie2").alias("k"), "n_base", "first_word", "last_word", "base_set", "label_set", "best", "n_notices")
    none = F.array().cast("array<string>")
    ends = hits.where("mark").select("id", "tie", F.col("p").alias("n_words"), "rows")
    out = ends.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("k")), "left").withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    joined = lambda *xs: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.coalesce(F.col(x), none) for x in xs]))), ",")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", joined("base_set").alias("base_labels"), joined("base_set", "label_set").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"), F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
    )


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), x AS (SELECT doc_id, w, unnest(range(len(w)::BIGINT)) AS p FROM d),
g AS (SELECT doc_id, p, w[p + 1] AS x, w[p + 2] AS y, w[p + 3] AS z FROM x),
t AS (SELECT * FROM (VALUES {_values(template_grams())}) AS t(template, label, t, runs, a, b, c)),
b AS (
  SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT phrase) AS base_set FROM (
    SELECT doc_id, p, CASE WHEN x = 'cc' AND y = 'by' THEN 'cc-by' WHEN x = 'general' AND y = 'public' AND z = 'license' THEN 'gpl' WHEN x = 'all' AND y = 'rights' AND z = 'reserved' THEN 'reserved' END AS phrase FROM g
  ) WHERE phrase IS NOT NULL GROUP BY doc_id
), h AS (SELECT DISTINCT doc_id, template, label, runs, t, p - t AS diagonal FROM g JOIN t ON x = a AND y = b AND z = c),
l AS (SELECT DISTINCT doc_id, template, diagonal FROM h),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {APART} THEN 0 ELSE 1 END AS new FROM l),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM n),
c AS (SELECT doc_id, template, label, span, count(DISTINCT t) / runs::DOUBLE AS cover FROM h JOIN s USING (doc_id, template, diagonal) GROUP BY doc_id, template, label, span, runs HAVING count(DISTINCT t) / runs::DOUBLE >= {COVER}),
v AS (SELECT doc_id, list(DISTINCT label) AS label_set, max(cover) AS best, count(*) AS n_notices FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base_set), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_set, []), coalesce(label_set, [])))), ','), '') AS labels,
  greatest(coalesce(best, 0.0::DOUBLE), CASE WHEN n_base > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS score, coalesce(n_notices, 0)::BIGINT AS n_notices
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN v ON d.doc_id = v.doc_id
"""
