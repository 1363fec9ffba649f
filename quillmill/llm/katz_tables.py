"""A Katz model as partitioned tables: n-grams with counts and log-probabilities, contexts with backoff weights, and a scorer for any texts.

The model is that of ``katz``, here in DataFrames: every training token is one
row of its word and the two tokens before it, triples are counted from those rows
and pairs and words from the triples' counts, each step adding up in tasks first.

    <folder>/grams/order=k/part=p      h, w, n, logp: word w after context h, seen n times
    <folder>/contexts/order=k/part=p   h, n, log_alpha: what a word not seen after h is weighed by
    <folder>/meta                      tokens, words, texts, and the discounts by order

A context is its tokens joined by a space; the end of a text is the token ``" "``
and its beginning ``"\\n"``, which no word can be.  ``part`` is a hash of the
context, so that what follows one context is read from one part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import WORD, discard, shared_path, stage
from .katz import HELD_OUT, K, OF, ORDER, discounts

END, BEGIN = " ", "\n"
#: Parts of a table of one order.
PARTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _part(h: Column) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(PARTS)).cast("int")


def tokens(docs: DataFrame, text_col: str, *more: str) -> DataFrame:
    """A row for each token: ``w``, the token before it ``h2`` and the two before it ``h3``; a null text is the end alone."""
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))
    every = docs.select(*more, F.concat(F.array(F.lit(BEGIN), F.lit(BEGIN)), words, F.array(F.lit(END))).alias("t"))
    after = F.zip_with(F.zip_with("t", F.slice("t", F.lit(2), F.size("t")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice("t", F.lit(3), F.size("t")), lambda x, w: F.when(w.isNotNull(), F.struct(w.alias("w"), x["b"].alias("h2"), F.concat(x["a"], F.lit(" "), x["b"]).alias("h3"))))
    return every.select(*more, F.explode(F.filter(after, lambda x: x.isNotNull())).alias("x")).select(*more, "x.w", "x.h2", "x.h3")


@dataclass(frozen=True)
class Tables:
    """Where a model lies, and its few numbers."""

    folder: str
    order: int
    total: int
    distinct: int
    d: dict[int, list[float]]

    @property
    def z(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def grams(self, spark: SparkSession, order: int) -> DataFrame:
        return spark.read.schema("h string, w string, n long, logp double, part int").parquet(f"{self.folder}/grams/order={order}")

    def contexts(self, spark: SparkSession, order: int) -> DataFrame:
        return spark.read.schema("h string, n long, log_alpha double, part int").parquet(f"{self.folder}/contexts/order={order}")

    def following(self, spark: SparkSession, *context: str) -> DataFrame:
        """w, n, logp of all words seen after one or two tokens; one part of the table is read."""
        h = F.lit(" ".join(context))
        return self.grams(spark, len(context) + 1).filter((F.col("part") == _part(h)) & (F.col("h") == h)).select("w", "n", "logp")


def _discounted(n: Column, d: list[float]) -> Column:
    """d(n) n, from a table of d(1) to d(K)."""
    return n * F.coalesce(F.get(F.array(*[F.lit(x) for x in d]), (n - 1).cast("int")), F.lit(1.0))


def fit(docs: DataFrame, *, text_col="text", id_col: str | None = "doc_id", order: int = ORDER, folder: str | None = None) -> Tables:
    """Write the tables of a model of all ``docs``, or, with ``id_col``, of those not held out (crc32 of the id as text modulo 5 is not 1; null: the empty text).

    The folder is the caller's, and nothing here deletes it.  Rows that repeat count
    each time; null texts are the end alone; an empty table gives empty tables,
    by which every word is unknown.  Other columns are ignored.
    """
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "katz")
    if id_col is not None:
        docs = docs.filter(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % OF != HELD_OUT)
    triples = stage(tokens(docs, text_col).groupBy("h3", "h2", "w").agg(F.count("*").alias("n")), "triples")
    pairs = stage(triples.groupBy("h2", "w").agg(F.sum("n").alias("n")), "pairs")
    words = stage(pairs.groupBy("w").agg(F.sum("n").alias("n")), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    z, found = total + 0.5 * (distinct + 1), {}
    words.select(F.lit("").alias("h"), "w", "n", F.log10((F.col("n") + 0.5) / z).alias("logp"), _part(F.lit("")).alias("part")).write.partitionBy("part").parquet(f"{folder}/grams/order=1")
    lower, rows = words.select("w", ((F.col("n") + 0.5) / z).alias("lp")), {2: pairs.withColumnRenamed("h2", "h"), 3: triples.withColumnRenamed("h3", "h")}
    for k in range(2, order + 1):
        types = {r["n"]: r["c"] for r in rows[k].filter(F.col("n") <= K + 1).groupBy("n").agg(F.count("*").alias("c")).collect()}
        found[k] = discounts([types.get(r, 0) for r in range(1, K + 2)]).tolist()
        seen = rows[k].join(lower, ["w"] if k == 2 else ["h2", "w"], "left")
        n, held = F.col("n"), _discounted(F.col("n"), found[k])
        sums = seen.groupBy("h").agg(F.sum("n").alias("count"), F.max((n <= K).cast("int")).alias("few"), F.sum(n - held).alias("free"), F.sum("lp").alias("lower"))
        # A context of which nothing was discounted sets one count aside.
        below = F.col("count") + 1 - F.col("few")
        sums = stage(sums.select("h", F.col("count").alias("n"), below.alias("below"), ((F.col("free") + below - F.col("count")) / below / (1 - F.col("lower"))).alias("alpha")), f"contexts-{k}")
        sums.select("h", "n", F.log10("alpha").alias("log_alpha"), _part(F.col("h")).alias("part")).repartition(PARTS, "part").sortWithinPartitions("part", "h").write.partitionBy("part").parquet(f"{folder}/contexts/order={k}")
        weighed = rows[k].join(sums.select("h", "below"), "h").withColumn("p", held / F.col("below"))
        table = weighed.select("h", "w", "n", F.log10("p").alias("logp"), _part(F.col("h")).alias("part"))
        # What follows a frequent context fills several files of its part.
        table.repartition(PARTS * 4, "part", F.pmod(F.xxhash64("w"), F.lit(4))).sortWithinPartitions("part", "h", "w").write.partitionBy("part").parquet(f"{folder}/grams/order={k}")
        if k < order:
            lower = stage(weighed.select(F.col("h").alias("h2"), "w", F.col("p").alias("lp")), "lower")
        discard(sums)
    spark.createDataFrame([(order, total, distinct, {k: v for k, v in found.items()})], "order int, tokens long, words long, discounts map<int,array<double>>").write.parquet(f"{folder}/meta")
    discard(triples, pairs, words, *([lower] if order > 2 else []))
    return Tables(folder, order, total, distinct, found)


def opened(spark: SparkSession, folder: str) -> Tables:
    """A model that ``fit`` has written."""
    r = spark.read.parquet(f"{folder}/meta").first()
    return Tables(folder, r["order"], r["tokens"], r["words"], dict(r["discounts"]))


def score_texts(model: Tables, docs: DataFrame, *, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_tokens, score (log10 of the model's probability) of each row of ``docs``, which the model need not have seen.

    Each distinct gram is looked up once; rows with one id, and null ids, are texts of their own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = stage(rows, "texts")
    told = stage(tokens(rows, "text", "row").groupBy("row", "h3", "h2", "w").agg(F.count("*").alias("times")), "asked")
    asked = told.select("h3", "h2", "w").distinct()
    logp = F.coalesce(F.col("p1"), F.lit(math.log10(0.5 / model.z)))
    asked = asked.join(model.grams(spark, 1).select("w", F.col("logp").alias("p1")), "w", "left")
    for k in range(2, model.order + 1):
        h = f"h{k}"
        asked = asked.join(model.grams(spark, k).select(F.col("h").alias(h), "w", F.col("logp").alias(f"p{k}")), [h, "w"], "left")
        asked = asked.join(model.contexts(spark, k).select(F.col("h").alias(h), F.col("log_alpha").alias(f"a{k}")), h, "left")
        logp = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"a{k}"), F.lit(0.0)) + logp)
    known = asked.select("h3", "h2", "w", logp.alias("logp"))
    sums = told.join(known, ["h3", "h2", "w"]).groupBy("row").agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.col("logp")).alias("score"))
    return rows.select("row", "doc_id").join(sums, "row").select("doc_id", "n_tokens", "score")
