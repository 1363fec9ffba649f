"""Connected components by alternating large and small stars, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, stage


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(id, component), staged, for every node of ``edges``; the component is its smallest id.

    Each round hangs every node's larger, then smaller, neighbours on the least
    one it knows, until nothing moves; a chain of n takes about log n rounds.
    Stars of one centre are reduced by partial minima before the shuffle.
    """
    pairs = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct()
    pairs = stage(pairs, "edges")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("l")).select(F.col("u").alias("c"), F.least("l", "u").alias("m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Large stars lose a node whose neighbours are all larger: it is their least, and stays as their centre.
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        joined = large.join(low, F.col("u") == F.col("c"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        old, pairs = pairs, stage(small, "edges")
        discard(old)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count(F.when(F.col("u") < F.col("v"), 1))).first()
        if state == before:
            break
        before = state
    found = stage(pairs.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionByName(pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")
    discard(pairs)
    return found
