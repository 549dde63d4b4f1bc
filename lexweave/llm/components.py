"""Connected components of an edge table, in rounds of joins; nothing but a count reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in `edges` (a, b): the smallest id that links lead to.

    Alternates large-star and small-star: each id's larger neighbours, then its smaller ones, are linked to the smallest
    id among it and its neighbours, until nothing changes; the rounds grow as the logarithm of the longest
    chain.  Each round is written to the shared folder.  Edges of an id with itself keep it, nulls are dropped.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null")
    alone = pairs.select(F.col("b").alias("id"))
    pairs = staged(pairs.filter("a > b").distinct(), "cc-edges")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        pairs = staged(small.select("e.a", "e.b").filter("a > b").distinct(), "cc-edges")
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        alone.unionByName(pairs.select(F.col("b").alias("id"))).distinct().join(pairs.select(F.col("a").alias("id")), "id", "left_anti").select("id", F.col("id").alias("component")))
