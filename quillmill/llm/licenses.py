"""License scans by diagonal voting, DataFrame operations only.

All rolling word k-grams of every text are hashed and joined with the k-grams
of a fixed set of templates.  A hit votes for the diagonal (word position minus
template position); a diagonal that collects every k-gram of a template is an
exact occurrence, and neighbouring diagonals (words were put in or left out)
are merged into a span, at most as many diagonals wide as the template has words,
and verified by how many distinct template places it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The phrases of the base labels.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]
#: Sentences of widely used licence notices, and the whole texts of licences and notices, with this operator's own labels.
NOTICES = [
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("licensed under the apache license version 2 0", "apache-notice"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-text"),
    ("this work is licensed under the gnu general public license version 3", "gpl-notice"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished"
        " to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
        " in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with"
        " the software or the use or other dealings in the software",
        "mit-full",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"
        " in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"
        " whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc-full",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
        " this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability"
        " and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages"
        " including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability"
        " whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
        "bsd-full",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
        " without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-full",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
        " either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty"
        " without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "gpl-full",
    ),
]
K_PHRASE, K_NOTICE = 2, 3
#: Diagonals at most so far apart are one span.
GAP = 3
#: A notice counts from this share of its k-grams on.
COVER = 0.6
#: The words of the contract, before A-Z are lower-cased.
WORD6 = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _word_hash(word):
    """Hash of a word with A-Z lower-cased.  lower() also folds letters beyond ASCII, some of
    them to ASCII, but to fewer bytes then; the byte count keeps those apart."""
    return F.xxhash64(F.lower(word), F.octet_length(word))


def _templates(spark: SparkSession) -> DataFrame:
    """(k, gram, template, place, grams, words, label, base): about a thousand rows, whatever the input."""
    rows = []
    for number, (text, label) in enumerate([*PHRASES, *NOTICES]):
        base = number < len(PHRASES)
        k, words = K_PHRASE if base else K_NOTICE, text.split(" ")
        n = len(words) - k + 1
        rows += [(k, words[i : i + k], number, i, n, len(words), label, base) for i in range(n)]
    schema = "k int, gram array<string>, template int, place int, grams int, words int, label string, base boolean"
    df = spark.createDataFrame(rows, schema)
    word = [_word_hash(F.get("gram", F.lit(i))) for i in range(3)]
    two, after = F.xxhash64(word[0], word[1]), F.xxhash64(word[1], word[2])
    hashed = F.when(F.col("k") == K_PHRASE, two).otherwise(F.xxhash64(two, after))
    return df.select(hashed.alias("t_hash"), "template", "place", "grams", "words", "label", "base")


def _next_grams(grams, hashes):
    """Hashes of (gram, next gram): from words to pairs, from pairs to triples.  The last has no next and is null."""
    return F.zip_with(grams, F.slice(grams, F.lit(2), F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))


def scan_licenses(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` are the verified notices as {label, start, end, cover}.  ``score``
    is 1 with a base phrase, else the best share of a notice found (0 if none).
    Null and empty texts have no words; without a phrase first_word and
    last_word are null and the labels empty.  Rows that repeat an id are
    scanned each for itself.  Other columns are ignored.
    """
    spark = docs.sparkSession
    templates = _templates(spark)
    # Some nine hundred hashes, whatever the input: the join's keys, looked up before rows are made.
    known = [r[0] for r in templates.select("t_hash").distinct().collect()]
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.regexp_extract_all(text, F.lit(WORD6), F.lit(0)).alias("w"))
    hashed = words.select("row", "doc_id", F.transform("w", _word_hash).alias("h"))
    pairs = hashed.select("row", "doc_id", F.size("h").alias("n"), _next_grams(F.col("h"), "h").alias("two"))
    grams = pairs.select("row", "doc_id", "n", F.concat("two", _next_grams(F.col("two"), "two")).alias("grams"))
    hit = F.transform("grams", lambda x, i: F.when(x.isin(known), F.struct(i.alias("i"), x.alias("hash"))))
    # A mark stays for each document, so that those without hits are kept.
    mark = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).cast("long").alias("hash")))
    places = grams.select("row", "doc_id", "n", F.explode(F.concat(mark, F.filter(hit, lambda x: x.isNotNull()))).alias("g"))
    places = places.select("row", "doc_id", F.col("n").cast("long").alias("n_words"), F.when(F.col("g.i") < F.col("n"), F.col("g.i")).otherwise(F.col("g.i") - F.col("n")).alias("pos"), F.col("g.hash").alias("hash"))
    hits = places.join(F.broadcast(templates.select("t_hash", "template", "place")), F.col("hash") == F.col("t_hash"), "left")
    votes = hits.groupBy("row", "doc_id", "n_words", F.coalesce("template", F.lit(-1)).alias("template"), (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        F.collect_set("place").alias("seen"), F.min("pos").alias("lo"), F.max("pos").alias("hi")
    )
    about = templates.groupBy(F.col("template").alias("t")).agg(*[F.min(c).alias(c) for c in ("grams", "words", "label", "base")])
    votes = votes.join(F.broadcast(about), F.col("template") == F.col("t"), "left")
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(along) <= GAP), 0).otherwise(1)
    runs = votes.withColumn("begin", F.when(fresh == 1, F.col("diagonal"))).withColumn("begin", F.when(F.col("base"), F.col("diagonal")).otherwise(F.last("begin", True).over(along)))
    # A chain of diagonals may go on and on; a span takes as many as the template has words.
    runs = runs.withColumn("part", F.floor((F.col("diagonal") - F.col("begin")) / F.col("words")))
    found = runs.groupBy("row", "doc_id", "n_words", "template", "begin", "part").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("places"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        *[F.first(c).alias(c) for c in ("grams", "words", "label", "base")],
    )
    cover = F.col("places") / F.col("grams")
    exact = F.col("base") & (F.col("places") == F.col("grams"))
    good = ~F.col("base") & (cover >= COVER)
    spans = F.struct("label", F.col("lo").alias("start"), (F.col("hi") + K_NOTICE).alias("end"), F.round(cover, 6).alias("cover"))
    out = found.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(exact, 1)).alias("n_base"),
        F.min(F.when(exact, F.col("lo"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("lo"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(exact, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(exact | good, F.col("label")))), ",").alias("labels"),
        F.round(F.coalesce(F.max(F.when(exact, 1.0)), F.max(F.when(~F.col("base"), cover)), F.lit(0.0)), 6).alias("score"),
        F.array_sort(F.collect_list(F.when(good, spans))).alias("spans"),
    )
    return out.drop("row")


def _quoted(rows) -> str:
    return ", ".join(f"({i}, '{text}', '{label}', {str(base).lower()}, {k})" for i, (text, label, base, k) in enumerate(rows))


#: DuckDB SQL for ``scan_licenses`` without its spans.
ORACLE_SQL = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), t AS (
  SELECT template, string_split(txt, ' ') AS ws, label, base, k FROM (VALUES {_quoted([(t, x, True, K_PHRASE) for t, x in PHRASES] + [(t, x, False, K_NOTICE) for t, x in NOTICES])}) v(template, txt, label, base, k)
), tg AS (
  SELECT template, label, base, k, len(ws) AS words, len(ws) - k + 1 AS grams, p AS place, array_to_string(ws[p + 1:p + k], ' ') AS gram FROM (SELECT *, unnest(range(0, len(ws) - k + 1)) AS p FROM t)
), dg AS (
  SELECT doc_id, k, pos, array_to_string(ws[pos + 1:pos + k], ' ') AS gram FROM (SELECT doc_id, ws, k, unnest(range(0, len(ws) - k + 1)) AS pos FROM w, (VALUES ({K_PHRASE}), ({K_NOTICE})) ks(k))
), hit AS (
  SELECT doc_id, template, label, base, words, grams, place, pos, pos - place AS diagonal FROM dg JOIN tg USING (k, gram)
), diag AS (
  SELECT *, CASE WHEN before IS NULL OR diagonal - before > {GAP} THEN diagonal END AS fresh
  FROM (SELECT *, lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS before FROM (SELECT DISTINCT doc_id, template, base, diagonal FROM hit))
), chain AS (
  SELECT doc_id, template, diagonal, CASE WHEN base THEN diagonal ELSE max(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) END AS begin FROM diag
), found AS (
  SELECT doc_id, template, any_value(label) AS label, any_value(base) AS base, any_value(grams) AS grams, count(DISTINCT place) AS places, min(pos) AS lo
  FROM hit JOIN chain USING (doc_id, template, diagonal) GROUP BY doc_id, template, begin, (diagonal - begin) // words
), marked AS (
  SELECT *, base AND places = grams AS exact, NOT base AND places / grams >= {COVER}::DOUBLE AS good FROM found
), sums AS (
  SELECT doc_id, count(*) FILTER (exact) AS n_base, min(lo) FILTER (exact) AS first_word, max(lo) FILTER (exact) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact OR good) AS labels,
    round(coalesce(max(CASE WHEN exact THEN 1.0::DOUBLE END), max(CASE WHEN NOT base THEN places / grams END), 0), 6) AS score
  FROM marked GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN sums USING (doc_id)
"""
