"""License scans by diagonal voting: which license phrases and texts occur in a document, whole or nearly so.

A template is a phrase or text with a label. All rolling windows of k words of a document are hashed;
those whose hash some template has travel, with their words, into a Spark join with the places of the
templates' windows, on hash and words, so each match is exact. A match at word p of the document and
word q of the template is a vote for the diagonal p - q. Votes are counted by document, template and
diagonal; diagonals that lie within GAP of each other (what inserted and deleted words shift) are merged;
and a merged span is verified: it counts if the template's words that its votes cover are SHARE percent
of all or more. Of a phrase the window is the phrase itself, so each vote is a place where its words
stand one after another.

No row of the join depends on another document, so a phrase that all documents hold costs a row for each
place and is never grouped by itself; counts are combined before they are shuffled. The templates are a
list that the caller holds; Spark chooses how to join them by their size.

Cases: null, empty and wordless texts have no words, labels or places, and a score of 0; rows that repeat,
or have no doc_id, are judged one by one; overlapping places all count; a template of fewer words than
its window is one window of its own length, one without words is never found; no templates find nothing;
other columns of `docs` don't matter, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bytescan as bs
from .common import durable, in_python, table

#: Words of a window of a text, diagonals that are merged across, and percent of a template that verifies a span.
K, GAP, SHARE = 3, 4, 80


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False


# The phrases of the contract with their labels, then the wording of public license notices and texts.
PHRASES = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))
TEXTS = (
    Template("mit-notice", "released under the MIT License"),
    Template("apache-2.0", "licensed under the Apache License, Version 2.0"),
    Template("gpl-3", "licensed under the GNU General Public License, version 3"),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    Template(
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    Template("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    Template("lgpl-text", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("bsd-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    Template("isc-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    Template("unlicense-text", "This is free and unencumbered software released into the public domain."),
    Template("warranty-disclaimer", "is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
)
TEMPLATES = PHRASES + TEXTS

GRAMS = "array<struct<at:long,hash:long,words:string>>"
_GRAM = pa.struct([("at", pa.int64()), ("hash", pa.int64()), ("words", pa.string())])


def _windows(piece: bs.Piece, sizes: list[int]):
    """For each size the first words and hashes of all windows; and the words."""
    w = bs.words(piece, bs.ALNUM)
    sums = bs.WORDS.sums(w.hash)
    return w, [(k, *bs.windows(w, k, sums)) for k in sizes]


def template_grams(templates: tuple[Template, ...], k: int = K) -> list[tuple]:
    """hash, words, template (its place in the list), label, phrase, size (words in all), k and at, where the window begins."""
    out = []
    for i, t in enumerate(templates):
        piece = next(bs.pieces(pa.array([t.text], pa.string())))
        w = bs.words(piece, bs.ALNUM)
        n, low = len(w.start), bs.LOWER[piece.data].tobytes()
        mine = n if t.phrase else min(k, n)
        if not n:
            continue
        at, hashes = bs.windows(w, mine)
        for a, h in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True):
            out.append((h, _phrase(low, w, a, mine), i, t.label, t.phrase, n, mine, a))
    return out


def _phrase(low: bytes, w: bs.Words, at: int, k: int) -> str:
    return b" ".join(low[a:b] for a, b in zip(w.start[at : at + k].tolist(), w.end[at : at + k].tolist(), strict=True)).decode()


_TEMPLATE = "hash long, words string, template int, label string, phrase boolean, size int, k int, t_at long"


def scanned(docs: DataFrame, grams: list[tuple]) -> DataFrame:
    """row (a number of its own), doc_id, n_words and grams, the windows of whole texts whose hash some template has; written down."""
    sizes = sorted({g[6] for g in grams})
    known = np.unique(np.array([g[0] for g in grams], dtype=np.int64))

    def run(batches):
        for batch in batches:
            n_words, lists = [], []
            for piece in bs.pieces(batch.column(1)):
                w, found = _windows(piece, sizes)
                n_words.append(w.counts)
                mine: list[list] = [[] for _ in range(len(piece))]
                low = None
                for k, at, h in found:
                    h = h.view(np.int64)
                    place = np.searchsorted(known, h)
                    place[place == len(known)] = 0
                    hit = np.flatnonzero(known[place] == h)
                    if not len(hit):
                        continue
                    low = bs.LOWER[piece.data].tobytes() if low is None else low
                    owner = np.searchsorted(w.of, at[hit], side="right") - 1
                    for d, a, x in zip(owner.tolist(), at[hit].tolist(), h[hit].tolist(), strict=True):
                        mine[d].append({"at": a - int(w.of[d]), "hash": x, "words": _phrase(low, w, a, k)})
                lists += mine
            counts = np.concatenate(n_words) if n_words else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(lists, pa.list_(_GRAM))], names=["doc_id", "n_words", "grams"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").transform(in_python, run, f"doc_id {kind}, n_words long, grams {GRAMS}")
    return durable(found.select(F.monotonically_increasing_id().alias("row"), "*"))


def votes(spark: SparkSession, scan: DataFrame, grams: list[tuple]) -> DataFrame:
    """row, template, label, phrase, size, k, at and t_at: a row for each window of a document that is one of a template's, word by word."""
    known = spark.createDataFrame(grams, _TEMPLATE)
    each = scan.select("row", F.explode("grams").alias("g")).select("row", "g.at", "g.hash", "g.words")
    return each.join(known, ["hash", "words"]).drop("hash", "words")


def spans(voted: DataFrame, gap: int = GAP) -> DataFrame:
    """row, template, label, size, start and end (words of the document), covered (the template's words that votes cover), from votes for texts."""
    own = ["row", "template", "label", "size", "k"]
    diagonals = voted.where(~F.col("phrase")).withColumn("diagonal", F.col("at") - F.col("t_at"))
    counted = diagonals.groupBy(*own, "diagonal").agg(F.min("at").alias("start"), F.max(F.col("at") + F.col("k")).alias("end"), F.collect_set("t_at").alias("t_ats"))
    in_order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(in_order) > gap, F.lit(True))
    merged = counted.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(in_order))
    one = merged.groupBy(*own, "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("t_ats")))).alias("t_ats"))
    # A window covers its k words, or those up to the next one's begin.
    steps = F.zip_with(F.slice("t_ats", 2, F.size("t_ats")), F.slice("t_ats", 1, F.size("t_ats") - 1), lambda b, a: F.least(b - a, F.col("k").cast("long")))
    covered = F.col("k").cast("long") + F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)
    return one.select("row", "template", "label", "size", "start", "end", covered.alias("covered"))


def licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, k: int = K, gap: int = GAP, share: int = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, a row for each of `docs`.

    n_base counts the places of phrases, first_word and last_word are their smallest and largest beginning; labels
    are those of phrases and of texts with a verified span. The score is the largest share of a template that a
    span covers, verified or not; a phrase's is 1.
    """
    grams = template_grams(templates, k)
    scan = scanned(docs, grams)
    voted = votes(docs.sparkSession, scan, grams)
    at = F.when(F.col("phrase"), F.col("at"))
    phrases = voted.groupBy("row").agg(F.count(at).alias("n_base"), F.min(at).alias("first_word"), F.max(at).alias("last_word"), F.collect_set(F.when(F.col("phrase"), F.col("label"))).alias("base"))
    found = spans(voted, gap).groupBy("row").agg(F.collect_set(F.when(100 * F.col("covered") >= share * F.col("size"), F.col("label"))).alias("own"), F.max(F.col("covered") / F.col("size")).alias("best"))
    none = F.array().cast("array<string>")
    joined = scan.select("row", "doc_id", "n_words").join(phrases, "row", "left").join(found, "row", "left")
    joined = joined.withColumns({"n_base": F.coalesce("n_base", F.lit(0)), "base": F.coalesce("base", none), "own": F.coalesce("own", none)})
    named = lambda labels: F.array_join(F.array_sort(labels), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", named(F.col("base")).alias("base_labels"), named(F.array_union("base", "own")).alias("labels"), F.round(score, 6).alias("score"))


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    sizes = sorted({g[6] for g in template_grams(templates)})
    joined = lambda k: " || ' ' || ".join(f"w{i}" for i in range(k))
    values = ", ".join(f"({i}, '{t.label}', {t.phrase}, '{t.text}')" for i, t in enumerate(templates))
    return f"""
WITH t AS MATERIALIZED (SELECT id, label, phrase, len(w) AS size, CASE WHEN phrase THEN len(w) ELSE least({K}, len(w)) END AS k, w FROM (SELECT id, label, phrase, {words} AS w FROM (VALUES {values}) AS v(id, label, phrase, text))),
tg AS MATERIALIZED (SELECT id, label, phrase, size, k, i - 1 AS q, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM t)),
d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents),
dw AS (SELECT row, i - 1 AS p, {", ".join(f"lead(word, {i}) OVER after AS w{i}" for i in range(max(sizes)))} FROM (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) WINDOW after AS (PARTITION BY row ORDER BY i)),
dg AS ({" UNION ALL ".join(f"SELECT row, p, {joined(k)} AS gram FROM dw" for k in sizes)}),
votes AS MATERIALIZED (SELECT dg.row, dg.p, tg.* EXCLUDE (gram) FROM dg JOIN tg ON dg.gram = tg.gram),
base AS (SELECT row, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word FROM votes WHERE phrase GROUP BY row),
diagonals AS (SELECT DISTINCT row, id, p - q AS diagonal FROM votes WHERE NOT phrase),
apart AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, id ORDER BY diagonal) <= {GAP} THEN 0 ELSE 1 END AS apart FROM diagonals),
islands AS (SELECT row, id, diagonal, sum(apart) OVER (PARTITION BY row, id ORDER BY diagonal) AS span FROM apart),
places AS (SELECT DISTINCT v.row, v.id, v.label, v.size, v.k, s.span, v.q FROM votes v JOIN islands s ON v.row = s.row AND v.id = s.id AND v.p - v.q = s.diagonal WHERE NOT v.phrase),
steps AS (SELECT *, least(k, coalesce(lead(q) OVER (PARTITION BY row, id, span ORDER BY q) - q, k)) AS step FROM places),
spans AS (SELECT row, label, size, sum(step) AS covered FROM steps GROUP BY row, id, label, size, span),
best AS (SELECT row, max(covered::DOUBLE / size) AS best FROM spans GROUP BY row),
named AS (SELECT DISTINCT row, label, true AS base FROM votes WHERE phrase UNION ALL SELECT DISTINCT row, label, false FROM spans WHERE 100 * covered >= {SHARE} * size),
labels AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels FROM named GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END, 6) AS score
FROM d LEFT JOIN base ON d.row = base.row LEFT JOIN best ON d.row = best.row LEFT JOIN labels ON d.row = labels.row
"""


ORACLE = oracle()
