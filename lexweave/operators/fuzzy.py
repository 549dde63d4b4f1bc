"""Similarity joins on edit distance as equi-joins on deletion keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gates as G


def deletions(word: Column) -> Column:
    """The word and all of it with one character left out; two words within one edit share one of these."""
    n = F.length(word)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    return F.array_distinct(F.concat(F.array(word), F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))))


def _keyed(a: DataFrame, b: DataFrame) -> DataFrame:
    """`a` and `b` joined on their keys by sort-merge: Spark takes a table of keys for as small as its words, and would send all keys to the driver to broadcast them."""
    return a.join(b.hint("merge"), "_key")


def within_one(left: DataFrame, right: DataFrame, left_col: str = "norm", right_col: str = "cand") -> DataFrame:
    """Pairs of distinct words at optimal-string-alignment distance 1, each once; both sides must hold distinct words.

    Deletion keys grow with the length of a word, not with the lexicon.
    """
    a = left.select(F.col(left_col), F.explode(deletions(F.col(left_col))).alias("_key"))
    b = right.select(F.col(right_col), F.explode(deletions(F.col(right_col))).alias("_key"))
    return _keyed(a, b).filter(G.one_osa(F.col(left_col), F.col(right_col))).select(left_col, right_col).distinct()


def within_two(left: DataFrame, right: DataFrame, left_col: str = "norm", right_col: str = "cand") -> DataFrame:
    """(left, right, distance): pairs at optimal-string-alignment distance exactly 2, by keys of up to two deletions."""

    def twice(word: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(deletions(word), deletions)))

    a = left.select(F.col(left_col), F.explode(twice(F.col(left_col))).alias("_key"))
    b = right.select(F.col(right_col), F.explode(twice(F.col(right_col))).alias("_key"))
    pairs = _keyed(a, b).select(left_col, right_col).distinct()
    return pairs.filter(G.two_osa(F.col(left_col), F.col(right_col))).withColumn("distance", F.lit(2))


def dealt(rows: DataFrame, col: str) -> DataFrame:
    """`rows` by `col` over all cores: few words make many keys, so a table of words must not be gathered into fewer parts for its size."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), col)


def key_rows(rows: DataFrame, col: str, two: Column, first: Column | None = None) -> DataFrame:
    """`rows` with _key and _cut for the word and each way to leave out _cut characters: one, or up to two where `two` holds; the first character alone where `first` does.

    Places are exploded rather than texts made in an array, so that Spark compiles it all.  Keys are numbers: pairs are verified, so equal ones of different texts do no harm.
    """
    first, n = F.lit(False) if first is None else first, F.length(col)
    i, j = F.col("_i"), F.col("_j")
    rows = rows.withColumn("_two", two & ~first).select("*", F.explode(F.sequence(F.when(first, 1).otherwise(0), F.when(first, 1).when(F.col("_two"), n - 1).otherwise(n))).alias("_i"))
    rows = rows.select("*", F.explode(F.when(~F.col("_two"), F.sequence(i, i)).when(i == 0, F.sequence(i, n)).otherwise(F.sequence(i + 1, F.greatest(i + 1, n)))).alias("_j"))
    left = F.concat(F.substring(F.col(col), F.lit(1), i - 1), F.substring(F.col(col), i + 1, j - i - 1), F.substring(F.col(col), j + 1, n))
    return rows.withColumns({"_key": F.xxhash64(left), "_cut": (i > 0).cast("int") + (j > i).cast("int")}).drop("_two", "_i", "_j")


def near(left: DataFrame, right: DataFrame) -> DataFrame:
    """(norm, cand, the other columns, distance): pairs at distance 1, and where `long` and `top` hold also at 2, by one join.

    `left`: norm, long, first (its only key leaves out the first character) and others; `right`: cand, top and others.
    Words with two characters left out are compared with the `top` ones alone, so these have their keys twice.
    """
    far = F.col("_cut") == 2
    a = key_rows(dealt(left, "norm"), "norm", F.col("long"), F.col("first")).withColumn("_far", far).drop("_cut")
    b = key_rows(dealt(right, "cand"), "cand", F.col("top")).drop("_cut").select("*", F.explode(F.when(F.col("top"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("_far"))
    a, b = (x.withColumn("_key", F.xxhash64("_key", "_far")).drop("_far") for x in (a, b))
    norm, cand = F.col("norm"), F.col("cand")
    most = F.when(F.col("long") & F.col("top"), 2).otherwise(1)
    others = [c for c in (*left.columns, *right.columns) if c not in ("norm", "cand")]
    pairs = _keyed(a, b).filter((norm != cand) & (F.abs(F.length(norm) - F.length(cand)) <= most)).groupBy("norm", "cand").agg(*(F.min(c).alias(c) for c in others))
    distance = F.when(G.one_osa(norm, cand), 1).when(most == 2, F.when(G.two_osa(norm, cand), 2))
    # Exploded, for a filter would compute it twice.
    return pairs.select("*", F.explode(F.array_compact(F.array(distance))).alias("distance"))


def bucket_scan(words: DataFrame, ranked: DataFrame, most: int = 1, bucket: int = 5000) -> DataFrame:
    """(norm, cand, distance): words of the length buckets (`ranked`: norm, bucket_rank) within `most` edits, 1 or 2, of each word."""
    if most not in (1, 2):
        raise ValueError("words are compared at one or two edits")
    top = ranked.filter(F.col("bucket_rank") <= bucket).select(F.col("norm").alias("cand"))
    found = within_one(words.select("norm"), top).withColumn("distance", F.lit(1))
    return found.unionByName(within_two(words.select("norm"), top)) if most == 2 else found


def splits(words: DataFrame, lex: DataFrame, col: str = "norm", least: int = 2) -> DataFrame:
    """(word, at, left, right): words that are two known words written as one; both parts have at least `least` characters."""
    points = words.filter(F.length(col) >= 2 * least).select(col, F.explode(F.sequence(F.lit(least), F.length(col) - least)).alias("at"))
    points = points.select(col, "at", F.expr(f"substring({col}, 1, at)").alias("left"), F.expr(f"substring({col}, at + 1)").alias("right"))
    known = lex.select("norm")
    return points.join(known.withColumnRenamed("norm", "left"), "left", "left_semi").join(known.withColumnRenamed("norm", "right"), "right", "left_semi").select(col, "at", "left", "right")
