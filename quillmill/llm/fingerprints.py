"""Document fingerprints from closed syncmers, DataFrame operations only.

A text is a sequence of units, by one rule for every size: a word is a unit, but
of a word over 16 characters, and in scripts without spaces, each character is.
k-1 blanks stand before and after the units, so that texts of a few units have
k-mers too, and each text's first k-mer is an anchor.  A k-mer of units is
a closed syncmer if the least hash among its s-mers is at its first or last
place.  That depends on the k-mer alone, so a shared passage yields the same
anchors wherever it stands, and two anchors' positions can be compared.

The fingerprint is the sorted list of all distinct anchor hashes, eight hex
digits each; it grows with the text.  Likeness of two is the share of common
hashes among their union: the Jaccard index of the anchors, but for clashes of
32-bit hashes.  ``placed`` likeness counts an anchor only where it stands at the
same position in both, and ``passages`` matches two texts' anchors by position: those
whose positions differ by one shift, and follow each other closely, are a passage.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import partitions, stage

K, S = 5, 2
_SCRIPTS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
_LETTER = rf"[^\x20\x09-\x0D{_SCRIPTS}]"
UNIT = rf"(?<!{_LETTER}){_LETTER}{{1,16}}(?!{_LETTER})|[^\x20\x09-\x0D]"


def with_anchors(df: DataFrame, text_col: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """Adds ``out``: array of {pos, hash}, the closed syncmers of ``text_col`` in order.

    ``pos`` is the k-mer's first unit, below 0 where it begins with blanks.  A
    text of white space alone has one anchor, over all of it; an empty or null
    one has none.  Helper columns begin with ``out`` and two underscores.
    """
    u, h, m = f"{out}__u", f"{out}__h", f"{out}__m"
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn(u, F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)))
    blanks = F.array_repeat(F.lit(0).cast("bigint"), k - 1)
    df = df.withColumn(h, F.when(F.size(u) > 0, F.concat(blanks, F.transform(u, lambda x: F.xxhash64(x)), blanks)).otherwise(F.array().cast("array<bigint>")))
    none = F.array().cast("array<bigint>")
    each = F.transform(F.sequence(F.lit(0), F.size(h) - s), lambda i: F.xxhash64(*[F.get(F.col(h), i + j) for j in range(s)]))
    df = df.withColumn(m, F.when(F.size(h) >= k, each).otherwise(none))
    w = k - s  # the last s-mer's place in a k-mer
    mer = [lambda i, j=j: F.get(F.col(m), i + j) for j in range(w + 1)]

    def closed(i: Column) -> Column:
        least = F.least(*[x(i) for x in mer])
        return (mer[0](i) == least) | (mer[w](i) == least)

    def anchor(i: Column) -> Column:
        return F.struct((i - (k - 1)).cast("int").alias("pos"), F.xxhash64(*[F.get(F.col(m), i + j) for j in sorted({*range(0, w, s), w})]).alias("hash"))

    some = F.transform(F.filter(F.sequence(F.lit(0), F.size(h) - k), closed), anchor)
    whole = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(text).alias("hash")))
    empty = F.array().cast("array<struct<pos:int,hash:bigint>>")
    return df.withColumn(out, F.when(F.size(h) >= k, some).when(text != "", whole).otherwise(empty)).drop(u, h, m)


def distinct_hashes(anchors: Column) -> Column:
    """All distinct 32-bit anchor hashes, sorted."""
    low = F.transform(anchors, lambda a: a["hash"].bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.sort_array(F.array_distinct(low))


def placed_hashes(anchors: Column) -> Column:
    """Each anchor as one long: its position above its 32-bit hash."""
    return F.transform(anchors, lambda a: F.shiftleft(a["pos"].cast("long"), 32).bitwiseOR(a["hash"].bitwiseAND(F.lit(0xFFFFFFFF))))


def passages(pairs: DataFrame, left: str, right: str, *, key: str, k: int = K, gap: int = 8 * K, least: int = 2) -> DataFrame:
    """(key, shift, begin, end, n_anchors) of passages that the texts ``left`` and ``right`` of each row share.

    Anchors match by hash; a match's shift is the position on the right less that on
    the left.  Matches of one shift at most ``gap`` units apart, ``least`` or
    more of them, are a passage from unit ``begin`` to before ``end`` on the left.  An anchor that a text
    repeats matches by its number among its like, so copies of a line aren't all paired.  Null
    and empty texts share nothing; ``key`` names each row.  Other columns are ignored.
    """
    both = with_anchors(with_anchors(pairs.select(F.col(key).alias("key"), F.col(left).alias("l"), F.col(right).alias("r")), "l", "la"), "r", "ra")
    both = stage(both.select("key", "la", "ra"), "anchors")  # else the optimizer puts their making into a filter before ``explode``, once for each place

    def rows(side: str) -> DataFrame:
        nth = Window.partitionBy("key", "hash").orderBy("pos")
        return both.select("key", F.explode(side).alias("a")).select("key", F.col("a.hash").alias("hash"), F.col("a.pos").alias("pos")).withColumn("nth", F.row_number().over(nth))

    hits = rows("la").join(rows("ra").withColumnRenamed("pos", "other"), ["key", "hash", "nth"]).withColumn("shift", F.col("other") - F.col("pos"))
    along = Window.partitionBy("key", "shift").orderBy("pos")
    hits = hits.withColumn("fresh", F.when(F.col("pos") - F.lag("pos").over(along) <= gap, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(along))
    found = hits.groupBy("key", "shift", "run").agg(F.greatest(F.min("pos"), F.lit(0)).alias("begin"), (F.max("pos") + k).alias("end"), F.count("*").alias("n_anchors"))
    return found.filter(F.col("n_anchors") >= least).select(F.col("key").alias(key), "shift", "begin", "end", "n_anchors")


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; two empty fingerprints are alike, an empty and another one are not."""
    same = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(same / (F.size(a) + F.size(b) - same))


def _bounds(docs: DataFrame, count: int) -> list[int]:
    """Ids that cut the ids into about ``count`` equal ranges: ids of rows, the least one first."""
    at = [i / count for i in range(1, count)]
    row = docs.agg(F.min("k").alias("least"), F.percentile_approx("k", at or [0.5], 20_000).alias("cuts")).first()
    return [] if row["least"] is None else sorted({row["least"], *row["cuts"]})


def _range_of(k: Column, bounds: list[int]) -> Column:
    """Place of the last of the sorted ``bounds`` that isn't above ``k``, in about 2 * sqrt(n) comparisons."""
    step = math.isqrt(len(bounds) - 1) + 1
    longs = lambda some: F.array(*[F.lit(b).cast("long") for b in some])
    begin = (F.size(F.filter(longs(bounds[::step]), lambda b: b <= k)) - 1) * step
    return begin + F.size(F.filter(F.slice(longs(bounds), begin + 1, F.lit(step)), lambda b: b <= k)) - 1


def fingerprint_neighbours(docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_anchors, placed_edited, placed_next for each row.

    The edited text has the last floor(n/4) characters replaced by the first
    as many of the next row's text by ascending id (the last row's next is the
    first; null ids come last; rows with one id are ordered by text).  Null
    texts count as empty.  An empty table gives no rows; a single row is its own
    next.  Other columns are ignored.

    Rows are dealt by ranges of the id whose bounds are ids in the table, so
    each range holds like many rows.  The first row of every range also goes, as
    a marked copy, to the end of the range before: then each row finds its
    neighbour in its own range, and no window holds the whole table.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = _bounds(base, 4 * partitions(spark))
    if not bounds:
        bounds = [0]
    n = len(bounds)
    placed = base.select("doc_id", "k", "text", _range_of(F.col("k"), bounds).alias("part"), F.lit(0).alias("copy"))
    # One row for each range: a broadcast of as many ids as there are ranges.
    firsts = spark.createDataFrame([(b, (i - 1) % n) for i, b in enumerate(bounds)], "b long, part int")
    firsts = base.join(F.broadcast(firsts), F.col("k") == F.col("b")).select("doc_id", "k", "text", "part", F.lit(1).alias("copy"))
    order = Window.partitionBy("part").orderBy("copy", "k", "text")
    rows = placed.unionByName(firsts).withColumn("next_text", F.lead("text").over(order))
    rows = with_anchors(rows, "text", "anchors").withColumn("fp", distinct_hashes(F.col("anchors"))).withColumn("n_anchors", F.size("anchors").cast("long")).withColumn("at", placed_hashes(F.col("anchors"))).drop("anchors")
    rows = rows.withColumn("next_fp", F.lead("fp").over(order)).withColumn("next_at", F.lead("at").over(order)).filter("copy = 0")
    length = F.length("text")
    cut = F.floor(length / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), length - cut), F.substring(F.coalesce(F.col("next_text"), F.lit("")), F.lit(1), cut))
    rows = rows.withColumn("edited", edited).withColumn("n_chars", length.cast("long"))
    rows = with_anchors(rows, "edited", "e_anchors").withColumn("e_fp", distinct_hashes(F.col("e_anchors"))).withColumn("e_at", placed_hashes(F.col("e_anchors")))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("e_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("e_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_anchors",
        likeness(F.col("at"), F.col("e_at")).alias("placed_edited"), likeness(F.col("at"), F.col("next_at")).alias("placed_next"),
    )
