"""Splits, samples, set operations and replication with exact counts and reproducible choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .inject import number


def ranked(rows: DataFrame, key_cols: list[str], seed: int = 42, bits: int = 10) -> DataFrame:
    """`rows` with place (from 0) in the hashed order of the keys.

    Places are counted by hash bucket first, so only rows within one bucket are sorted together.
    """
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in key_cols))
    rows = rows.withColumn("_h", number(key, seed)).withColumn("_b", F.floor(F.col("_h") / float(1 << (32 - bits))))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = F.broadcast(counts.select("_b", start.alias("_s")))  # 2 ** bits rows at most
    place = F.col("_s") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", *key_cols)) - 1
    return rows.join(counts, "_b").withColumn("place", place).drop("_h", "_b", "_s")


def split_of(place: Column, n: int, train: float = 0.8, val: float = 0.1) -> Column:
    if not 0 <= train + val <= 1 + 1e-6:
        raise ValueError("shares must sum to at most 1")
    a, b = int(n * train), int(n * val)
    return F.when(place < a, "train").when(place < a + b, "val").otherwise("test")


def leak_free(rows: DataFrame, text_col: str = "text", train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """(text, split): distinct stripped texts that are not empty, split before anything is made of them; counts are exact."""
    texts = rows.select(T.strip(F.col(text_col)).alias("text")).filter("text <> ''").distinct()
    return ranked(texts, ["text"], seed).withColumn("split", split_of(F.col("place"), texts.count(), train, val)).drop("place")


def fallback(rows: DataFrame, text_col: str = "correct_text", val: float = 0.1, test: float = 0.2, seed: int = 42) -> DataFrame:
    """`rows` with split: those of a table that has none, by distinct text, so that no text is in two; val ends at `val` of the texts, test at `test`."""
    texts = rows.select(F.col(text_col).alias("_text")).filter("_text is not null").distinct()
    n = texts.count()
    marked = ranked(texts, ["_text"], seed).select("_text", F.when(F.col("place") < int(n * val), "val").when(F.col("place") < int(n * test), "test").otherwise("train").alias("split"))
    return rows.join(marked, rows[text_col].eqNullSafe(marked["_text"]), "left").drop("_text").withColumn("split", F.coalesce("split", F.lit("train")))


def within_budget(rows: DataFrame, key: str, order: list[str], budget: int) -> DataFrame:
    """`rows` whose key is among the first `budget` distinct keys, in the order of their first rows: a bound on searches, one for each key."""
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("_first")).orderBy("_first", key).limit(budget).select(key)
    return rows.join(first, key, "left_semi")


def hold_out(rows: DataFrame, key_cols: list[str], ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """`rows` with split val for max(1, round(n * ratio)) of them, train for the others."""
    n = rows.count()
    want = max(1, round(n * ratio))
    return ranked(rows, key_cols, seed).withColumn("split", F.when(F.col("place") < want, "val").otherwise("train")).drop("place")


def sample(rows: DataFrame, n: int, key_cols: list[str], seed: int = 42) -> DataFrame:
    """`n` rows, the first in hashed order."""
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in key_cols))
    return rows.orderBy(number(key, seed), *key_cols).limit(n)


def replicate(rows: DataFrame, times: int) -> DataFrame:
    """Each row `times` times, with the number of the copy."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def cross_pairs(rows: DataFrame, text_col: str = "text", most: int = 1000) -> DataFrame:
    """All ordered pairs of different texts of a small sample table; a table of more than `most` rows is refused, not cut."""
    small = rows.select(text_col)
    if small.limit(most + 1).count() > most:
        raise ValueError(f"pairs are made of sample tables of at most {most} rows")
    a, b = small.select(F.col(text_col).alias("a")), small.select(F.col(text_col).alias("b"))
    return a.join(F.broadcast(b), F.col("a") != F.col("b"))


def in_texts(rows: DataFrame, texts: DataFrame, col: str, keep: bool = True) -> DataFrame:
    """Rows whose text is (or is not) among `texts`; nulls are never among them."""
    other = texts.select(F.col(texts.columns[0]).cast("string").alias("_t")).filter("_t is not null").distinct()
    return rows.join(other, rows[col].cast("string") == other["_t"], "left_semi" if keep else "left_anti")
