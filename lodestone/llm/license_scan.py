"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

Units. Every line and every paragraph (lines up to a blank one) of the whole text is compared with every template.

Weights. A word (a run of a-z and 0-9 after lower-casing) weighs tf * (1 + ln((1 + N) / (1 + df))), with N the number of
documents and df those that hold it, counted over all documents and all words. Only units that could reach the threshold are scored: with a template's words ordered by weight,
those left after the shortest beginning whose rest has a norm under ``LIMIT`` times the template's cannot reach it alone, so
a unit without a word of some beginning is passed over, and no match is lost.

Result. A file has the licence of its best unit ('header', or 'file' for a licence file); else that of the licence file in
the nearest directory above it ('inherited'), found by joining the directories with their ancestors' paths; else none.
Ties go to the greater cosine, then the smaller name; of several licence files in one directory the same.

The templates are a fixed short table, so their vocabulary is small and sent to all tasks. Null and empty texts have no
header. Rows with a null path inherit nothing. Repeated rows are judged each, by their own text, whatever their key; a null
key is a key like others. Texts of any length are compared whole. An empty table gives no rows. Extra columns stay in ``inherit``;
those called license, cosine or how give way to its own.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.durable import written
from lodestone.sources import table

LIMIT = 0.6
#: The usual notices of common licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
LICENSE_FILE = "(?i)(^|/)(licen[cs]e|copying)(\\.[a-z]+)?$"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _terms(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for w in re.findall("[a-z0-9]+", text.lower()):
        out[w] = out.get(w, 0) + 1
    return out


def _weights(docs: DataFrame, text: str, templates) -> tuple[dict[str, float], int]:
    """The weight of each word of the templates, and the number of documents."""
    vocabulary = sorted({w for _, t in templates for w in _terms(t)})
    held = F.array_intersect(words(F.col(text)), F.lit(vocabulary))
    df = {r["w"]: r["n"] for r in docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # one row a word of the templates
    n = docs.count()
    return {w: 1 + math.log((1 + n) / (1 + df.get(w, 0))) for w in vocabulary}, n


def _all_weights(docs: DataFrame, text: str, n: int) -> DataFrame:
    """(word, idf) of every word of the documents."""
    df = docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    return written(df.select("word", (1 + F.log((1.0 + n) / (1 + F.col("df")))).alias("idf")), "idf")


def headers(docs: DataFrame, key: str = "doc_id", text: str = "text", templates=TEMPLATES, limit: float = LIMIT) -> DataFrame:
    """(key, text_hash, license, cosine): the best licence of each pair of key and text (by ``text_hash``) that has one."""
    spark = docs.sparkSession
    idf, n = _weights(docs, text, templates)
    rows, telling = [], set()
    for i, (_, template) in enumerate(templates):
        tf = sorted(((c * idf[w], w) for w, c in _terms(template).items()), reverse=True)
        norm = math.sqrt(sum(x * x for x, _ in tf))
        rows += [(i, w, x / norm) for x, w in tf]
        for j, (_, w) in enumerate(tf):
            telling.add(w)
            if math.sqrt(sum(x * x for x, _ in tf[j + 1 :])) < limit * norm:
                break
    vectors = spark.createDataFrame(rows, "template int, word string, x double")
    names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(templates)], "template int, license string")

    lines = F.split(F.col(text), "\n")
    units = F.filter(F.array_distinct(F.concat(lines, F.split(F.col(text), "\n[ \t\r]*\n"))), lambda u: F.arrays_overlap(words(u), F.lit(sorted(telling))))
    likely = docs.where(F.arrays_overlap(words(F.col(text)), F.lit(sorted(telling))))
    # Rows of one key and one text share their units, which multiplies all counts of a unit alike and leaves its cosine.
    found = likely.select(F.col(key).alias("key"), text_hash(F.col(text)).alias("text_hash"), F.posexplode(units).alias("unit", "body"))
    unit = ["key", "text_hash", "unit"]
    counted = found.select(*unit, F.explode(words(F.col("body"))).alias("word")).groupBy(*unit, "word").agg(F.count("*").alias("tf"))
    weighed = counted.join(_all_weights(docs, text, n), "word").withColumn("x1", F.col("tf") * F.col("idf"))
    norms = weighed.join(F.broadcast(vectors), "word", "left")  # vectors: the words of a fixed table
    dots = norms.groupBy(*unit, "template").agg(F.sum(F.col("x1") * F.col("x")).alias("dot"))
    sizes = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("x1") * F.col("x1"))).alias("norm"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in unit]
    scored = dots.where("template is not null").alias("d").join(sizes.alias("s"), same).select("d.*", "s.norm").join(F.broadcast(names), "template")
    cosine = F.least(F.round(F.col("dot") / F.col("norm"), 6), F.lit(1.0))
    best = scored.select("key", "text_hash", "license", cosine.alias("cosine")).where(F.col("cosine") >= limit)
    best = best.groupBy("key", "text_hash").agg(F.min(F.struct(-F.col("cosine"), "license")).alias("b"))
    return best.select(F.col("key").alias(key), "text_hash", F.col("b.license"), (-F.col("b.col1")).alias("cosine"))


def text_hash(text: Column) -> Column:
    """What tells the texts of one key apart."""
    return F.xxhash64(text)


def licensed(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the licence and cosine of ``found`` (from ``headers``), null where there is none."""
    mine, theirs = docs.drop("license", "cosine"), found.select(F.col(key).alias("_key"), F.col("text_hash").alias("_hash"), "license", "cosine")
    return mine.join(theirs, mine[key].eqNullSafe(theirs["_key"]) & (text_hash(mine[text]) == theirs["_hash"]), "left").drop("_key", "_hash")


def inherit(files: DataFrame) -> DataFrame:
    """(file rows, license, cosine, how) from rows with (path, license, cosine); null licences look to directories above."""
    own = F.struct(*[F.col(c) for c in files.columns if c not in ("license", "cosine", "how")])
    rows = files.select(
        own.alias("row"), "license", "cosine", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)).alias("is_file")
    )
    granted = rows.where("is_file and license is not null").groupBy("dir").agg(F.min(F.struct(-F.col("cosine"), "license")).alias("b"))
    granted = written(granted.select(F.col("dir").alias("above"), F.col("b.license").alias("given"), (-F.col("b.col1")).alias("given_cosine")), "granted")
    dirs = rows.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    chain = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    up = dirs.select("dir", F.posexplode(F.array_distinct(chain)).alias("depth", "above")).join(granted, "above")
    nearest = up.groupBy("dir").agg(F.max(F.struct("depth", "given", "given_cosine")).alias("n")).select("dir", "n.given", "n.given_cosine")
    out = rows.join(written(nearest, "nearest"), "dir", "left")
    mine = F.col("license").isNotNull()
    how = F.when(mine, F.when(F.col("is_file"), "file").otherwise("header")).when(F.col("given").isNotNull(), "inherited")
    return out.select("row.*", F.coalesce("license", "given").alias("license"), F.when(mine, F.col("cosine")).otherwise(F.col("given_cosine")).alias("cosine"), how.alias("how"))


def document_path() -> Column:
    """A path for each document: source / thousand / fifty / file, where the first of each fifty and thousand is a licence file."""
    k, c, d = F.col("doc_id"), F.expr("doc_id div 1000").cast("string"), F.expr("doc_id div 50").cast("string")
    return (
        F.when(k % 1000 == 0, F.concat_ws("/", "source", c, F.lit("LICENSE")))
        .when(k % 50 == 0, F.concat_ws("/", "source", c, d, F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", "source", c, d, F.concat(k.cast("string"), F.lit(".txt"))))
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their licence, its cosine, and how it was found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    own = written(headers(docs), "headers")
    files = licensed(docs.withColumn("path", document_path()), own).select("doc_id", "path", "license", "cosine")
    return inherit(files).select("doc_id", "path", "license", "cosine", "how")


def _sql() -> str:
    values = ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES))
    return f"""
WITH t(template, license, body) AS (VALUES {values}),
tw AS (SELECT template, word, count(*) AS tf FROM (SELECT template, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS word FROM t) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS word FROM documents) GROUP BY word),
n AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT word, 1 + ln((1 + n) / (1 + coalesce(df, 0))) AS idf FROM (SELECT word FROM tw UNION SELECT word FROM df) LEFT JOIN df USING (word), n),
tx AS (SELECT template, word, tf * idf AS x FROM tw JOIN idf USING (word)),
tv AS (SELECT template, word, x / sqrt(sum(x * x) OVER (PARTITION BY template)) AS x FROM tx),
units AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')))) AS body FROM documents),
numbered AS (SELECT doc_id, row_number() OVER () AS unit, body FROM units),
uw AS (SELECT doc_id, unit, word, count(*) AS tf FROM (SELECT doc_id, unit, unnest(regexp_extract_all(lower(body), '[a-z0-9]+')) AS word FROM numbered) GROUP BY ALL),
ux AS (SELECT doc_id, unit, word, tf * idf AS x FROM uw JOIN idf USING (word)),
norm AS (SELECT unit, sqrt(sum(x * x)) AS norm FROM ux GROUP BY unit),
cosine AS (SELECT doc_id, template, least(round(sum(ux.x * tv.x) / any_value(norm), 6), 1.0) AS cosine FROM ux JOIN tv USING (word) JOIN norm USING (unit) GROUP BY doc_id, unit, template),
own AS (SELECT doc_id, min(struct_pack(c := -cosine, l := license)) AS b FROM cosine JOIN t USING (template) WHERE cosine >= {LIMIT} GROUP BY doc_id),
files AS (SELECT d.doc_id, own.b.l AS license, -own.b.c AS cosine, d.doc_id % 50 = 0 AS lf,
  CASE WHEN d.doc_id % 1000 = 0 THEN concat_ws('/', source, d.doc_id // 1000) ELSE concat_ws('/', source, d.doc_id // 1000, d.doc_id // 50) END AS dir,
  CASE WHEN d.doc_id % 50 = 0 THEN 'LICENSE' ELSE d.doc_id || '.txt' END AS name FROM documents d LEFT JOIN own USING (doc_id)),
granted AS (SELECT dir AS above, min(struct_pack(c := -cosine, l := license)) AS b FROM files WHERE lf AND license IS NOT NULL GROUP BY dir),
nearest AS (SELECT f.doc_id, max(struct_pack(n := strlen(above), l := b.l, c := -b.c)) AS g FROM files f JOIN granted ON f.dir = above OR starts_with(f.dir, above || '/') GROUP BY f.doc_id)
SELECT doc_id, dir || '/' || name AS path, coalesce(license, g.l) AS license, CASE WHEN license IS NOT NULL THEN cosine ELSE g.c END AS cosine,
  CASE WHEN license IS NOT NULL THEN CASE WHEN lf THEN 'file' ELSE 'header' END WHEN g IS NOT NULL THEN 'inherited' END AS how
FROM files LEFT JOIN nearest USING (doc_id)
"""


SQL = _sql()
