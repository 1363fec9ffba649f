"""Mixing sources to target weights by Efraimidis-Spirakis sampling, DataFrame operations only.

Each document gets the exponential key ``-ln(u) / quality``; the smaller the
key, the earlier its place in its source.  ``u`` comes from a digest of the id
and the seed, so reruns agree.  A source's target buys complete epochs first;
the rest is spent on documents in key order, the last of them in part.

A source may hold a third of all rows, so its prefix sum isn't one window: the
slim rows (no text) are range-partitioned by (source, key), summed in each
range, and a window over the ranges' sums gives every range its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, fresh, partitions, stage

WEIGHTS = (3, 1, 2)
#: Up to so many sources their targets are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def quality(text: Column, size: Column) -> Column:
    """A document's quality weight: 1, less for symbol junk and for odd word lengths.

    The share of symbols among its characters costs four times its value (0.1
    is the least); a mean word length outside 2 to 15 halves the weight.
    Empty texts weigh 0.1.
    """
    chars = F.length(text)
    symbols = chars - F.length(F.translate(text, "#$%&*!{}<>|=~^", ""))
    mean = (chars - size + 1) / size
    weight = F.greatest(F.lit(0.1), 1.0 - 4.0 * symbols / chars) * F.when((mean >= 2) & (mean <= 15), 1.0).otherwise(0.5)
    return F.when((size > 0) & (chars > 0), F.greatest(F.lit(0.1), weight)).otherwise(0.1)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code point order, null last, take ``weights`` in turn and share
    ``share`` times all sizes; none gets over ``most`` times its own size, what
    is cut off is shared again by weight until none is above.  In closed form:
    with sources sorted by cap / weight, the first j are capped and the rest
    get level * weight, for the first j whose level fits.  One row per source
    passes through the windows, after a partial sum by source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    k = len(weights)
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % k
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = (
        per.withColumn("level", (F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .withColumn("fits", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(every)["level"])
    )
    return per.select("source", "source_size", F.coalesce(F.least(F.col("fits") * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def mix(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=1.5, most=2, seed=17, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and quality for every row of ``docs``.

    Null texts have size 0 and take nothing; a null source is a source of its
    own, the last.  Rows that repeat an id are documents of their own with the
    same key; ties are broken by id, by size, then by the columns ``more``, which
    are in the result too.  An empty table gives no rows.  Other columns are
    ignored, whatever their names.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), text.alias("t"), *more)
    slim = slim.withColumn("quality", quality(F.col("t"), F.col("size")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1.0) / float(1 << 48)
    slim = stage(slim.select("doc_id", "source", "size", "quality", (-F.log(u) / F.col("quality")).alias("key"), *more), "mix-slim")

    targets = stage(source_targets(slim, weights, share, most), "mix-targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    targets = targets.withColumnRenamed("source", "of")

    parts = 2 * partitions(spark)
    ranged = slim.repartitionByRange(parts, F.col("source").asc_nulls_last(), "key", "doc_id", "size", *more).withColumn("part", F.spark_partition_id())
    ranged = stage(ranged, "mix-ranged")
    sums = ranged.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("offset"))
    here = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size", *more).rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.join(sums, ranged.source.eqNullSafe(sums.p_source) & (ranged.part == sums.p_part))
        .withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(here), F.lit(0)))
        .drop("p_source", "p_part")
    )
    both = placed.join(targets, placed.source.eqNullSafe(targets.of), "left")
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0)
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    taken = F.least(epochs * F.col("size") + part, F.lit(most) * F.col("size"))
    return both.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "quality", *more)


def mixed_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it was taken.

    A complete epoch gives the row as it is; the part taken of the document at
    a budget's edge gives its first words, up to the last one taken, as a row.
    Columns are those of ``docs``.  Each row is taken as its own sum says, also
    where ids repeat or are null: rows are staged with a key of their own.
    """
    tie, row, key, took, words, copy = (fresh(f"mix_{x}", docs.columns) for x in ("tie", "row", "key", "took", "words", "copy"))
    rows = stage(docs.withColumn(tie, F.xxhash64(*docs.columns)).withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    taken = mix(rows, id_col=id_col, text_col=text_col, more=(tie, row), **how)
    taken = taken.select(F.col(row).alias(key), F.col("taken").alias(took), F.col("size").alias(words)).filter(F.col(took) > 0)
    own = F.col(words) > 0
    full = F.when(own, F.floor(F.col(took) / F.col(words))).otherwise(0).cast("int")
    rest = F.when(own, F.col(took) % F.col(words)).otherwise(0).cast("int")
    joined = rows.join(taken, rows[row] == taken[key])
    copies = F.concat(F.array_repeat(F.lit(-1), full), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)), 1, F.col(copy)), " ")
    rows = joined.withColumn(copy, F.explode(copies))
    text = F.when(F.col(copy) < 0, F.col(text_col)).otherwise(cut)
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


#: DuckDB SQL for ``mix`` over all documents with its defaults.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents
), weighed AS (
  SELECT doc_id, source, size,
    CASE WHEN size > 0 AND length(t) > 0 THEN
      greatest(0.1::DOUBLE,
        greatest(0.1::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (length(t) - length(translate(t, '#$%&*!{}<>|=~^', '')))::DOUBLE / length(t)::DOUBLE)
        * CASE WHEN (length(t) - size + 1)::DOUBLE / size BETWEEN 2 AND 15 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)
    ELSE 0.1::DOUBLE END AS quality
  FROM sized
), keyed AS (
  SELECT *, -ln((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656::DOUBLE) / quality AS key
  FROM weighed
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM keyed GROUP BY source
), levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0))
      / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM per
  WINDOW b AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
  SELECT arg_min(level, cap / w) FILTER (level <= cap / w) AS level FROM levels
), targets AS (
  SELECT source, source_size, coalesce(least(c.level * w, cap), cap) AS target FROM levels, chosen c
), placed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, k.quality,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
    CASE WHEN t.source_size > 0 THEN least(floor(t.target / t.source_size), 2)::BIGINT ELSE 0 END AS epochs
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  least(epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - before)), 2 * size)::BIGINT AS taken, quality
FROM placed
"""
