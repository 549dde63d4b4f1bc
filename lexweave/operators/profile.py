"""Table profiles: descriptions, shares, histograms, nulls, duplicates, outliers, constants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numeric_columns(rows: DataFrame) -> list[str]:
    return [c for c, t in rows.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]


def describe(rows: DataFrame, digits: int = 6) -> DataFrame:
    """One row for each numeric column: count, mean, deviation, least, greatest; all columns in one pass."""
    cols = numeric_columns(rows)
    stats = F.array(*(F.struct(F.lit(c).alias("column"), F.count(c).alias("count"), F.round(F.avg(c), digits).alias("mean"), F.round(F.stddev_samp(c), digits).alias("std"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max")) for c in cols))
    return rows.agg(stats.alias("s")).select(F.explode("s").alias("s")).select("s.*")


def value_share(rows: DataFrame, column: str, digits: int = 6) -> DataFrame:
    counts = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("total"), digits).alias("share"))


def histogram(rows: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, n): equal-width bins between the least and the greatest value; every bin is there."""
    bounds = rows.agg(F.min(F.col(column).cast("double")).alias("lo"), F.max(F.col(column).cast("double")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) / width))).cast("int")
    counts = rows.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias(column)).join(F.broadcast(bounds)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = bounds.filter("lo is not null").select("lo", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.round(F.col("lo") + F.col("bin") * F.col("w"), 6).alias("low"), F.round(F.col("lo") + (F.col("bin") + 1) * F.col("w"), 6).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def null_counts(rows: DataFrame) -> DataFrame:
    stats = F.array(*(F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count(c).alias("present")) for c in rows.columns))
    return rows.agg(stats.alias("s")).select(F.explode("s").alias("s")).select("s.*")


def duplicate_rows(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Values that more than one row has, with their count."""
    return rows.groupBy(*(columns or rows.columns)).agg(F.count("*").alias("n")).filter("n > 1")


def outliers(rows: DataFrame, column: str, reach: float = 1.5) -> DataFrame:
    """Rows outside the quartiles by more than `reach` times their distance."""
    q = rows.agg(F.percentile(column, F.array(F.lit(0.25), F.lit(0.75))).alias("q")).select(F.get("q", F.lit(0)).alias("a"), F.get("q", F.lit(1)).alias("b"))
    fence = F.broadcast(q.select((F.col("a") - reach * (F.col("b") - F.col("a"))).alias("low"), (F.col("b") + reach * (F.col("b") - F.col("a"))).alias("high")))
    return rows.join(fence, (F.col(column) < F.col("low")) | (F.col(column) > F.col("high"))).drop("low", "high")


def constant_columns(rows: DataFrame) -> DataFrame:
    """Columns with one value at most."""
    stats = F.array(*(F.struct(F.lit(c).alias("column"), F.min(F.col(c).cast("string")).alias("lo"), F.max(F.col(c).cast("string")).alias("hi"), F.count(c).alias("n"), F.count("*").alias("all")) for c in rows.columns))
    found = rows.agg(stats.alias("s")).select(F.explode("s").alias("s")).select("s.*")
    return found.filter("n = 0 or (lo = hi and n = all)").select("column", F.col("lo").alias("value"))


def shape(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.lit(len(rows.columns)).alias("columns"))


def page(rows: DataFrame, order: list[str], start: int, length: int) -> DataFrame:
    """Rows `start` to `start + length` in the given order."""
    return rows.orderBy(*order).offset(start).limit(length)


def union_named(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (d.withColumn("table", F.lit(n)) for n, d in parts.items()))
