"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a budget of words.  Whole passes over the source are taken first; the rest is fitted: documents are
counted by exact length, an even share of every length is taken, a descending greedy pass brings what is left
below a fixed number of words, and a bounded-knapsack dynamic programme over the documents not yet taken closes it
as exactly as any subset of them can.  Documents of a chosen length are picked by seeded hash, so reruns agree.

Only (source, length, count) rows meet in one task, one task for a source: distinct lengths grow with the length of the
longest document, not with the number of documents.  The pick never ranks a whole length: a hash bucket
counts how many documents it holds, buckets below the cut go whole, and only the bucket at the cut is ranked.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import located, staged, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Words that the dynamic programme closes at most.
CLOSING = 1 << 15
#: Hash buckets within a source and length, each counted in one row.
BUCKETS = 1 << 10


def words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...], share: Fraction, most: int) -> dict[str | None, float]:
    """Target of each source.  Sources by code point, null last, take the weights in turn; a target stops at
    `most` times the source's size and the excess is shared again by weight among the others until none is above."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    size, left = dict(order), share * sum(n for _, n in order)
    found, open_ = {}, set(weight)
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > most * size[s]}
        if not above:
            return found | {s: float(left * weight[s] / total) for s in open_}
        for s in above:
            found[s] = float(most * size[s])
            left -= most * size[s]
        open_ -= above
    return found


def closest(budget: int, lengths: list[int], counts: list[int]) -> list[int]:
    """How many of each length (at most its count) sum nearest to `budget`: below it, or above if no farther.

    Bounded knapsack on bit sets, with counts split into powers of two.
    """
    top = budget + 1 + (min((n for n, c in zip(lengths, counts) if c and n), default=0))
    parts, reach, steps = [], 1, []
    mask = (1 << (top + 1)) - 1
    for i, (n, c) in enumerate(zip(lengths, counts)):
        c = min(c, top // n) if n else 0
        k = 1
        while c > 0:
            k = min(k, c)
            steps.append(reach)
            parts.append((i, k, n * k))
            reach |= (reach << (n * k)) & mask
            c -= k
            k *= 2
        if reach >> budget & 1:
            break
    low = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    high = reach >> (budget + 1)
    goal = low
    if high:
        up = budget + (high & -high).bit_length()
        goal = up if up - budget < budget - low else low
    taken = [0] * len(lengths)
    for (i, k, n), before in zip(reversed(parts), reversed(steps)):
        if not before >> goal & 1:
            taken[i] += k
            goal -= n
    return taken


def fit(lengths: list[int], counts: list[int], target: float) -> tuple[int, list[int]]:
    """(whole passes, further documents of each length) whose words come nearest to `target`."""
    total = sum(n * c for n, c in zip(lengths, counts))
    if total == 0:
        return 0, [0] * len(lengths)
    passes = int(target // total)
    rest = round(target - passes * total)
    taken = [c * rest // total for c in counts]
    left = rest - sum(n * t for n, t in zip(lengths, taken))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if lengths[i] and left - lengths[i] >= CLOSING // 2:
            more = min(counts[i] - taken[i], (left - CLOSING // 2) // lengths[i])
            taken[i] += more
            left -= more * lengths[i]
    more = closest(left, lengths, [c - t for c, t in zip(counts, taken)])
    return passes, [t + m for t, m in zip(taken, more)]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of `docs`: id, source, size, source_size, target, taken, and the columns `keep`, which tell rows of one id apart.

    `taken` is the size times the passes in which the mix holds the document, at most `most`.  Null texts and texts
    of white space have size 0 and are never taken; null is a source of its own, last; repeated rows count
    and are picked apart; a text of any length counts whole; an empty table gives no rows.  Sources are few by nature (they carry weights): one
    (source, size) row for each reaches the driver.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(F.col(text_col)).alias("size"), *keep)
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "id", "source", "size"), BUCKETS).cast("int"))
    sized = staged(sized, "mix-sizes")
    spark = docs.sparkSession
    sizes = [(r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    goal = targets(sizes, weights, Fraction(share), most)
    total = dict(sizes)
    plan = spark.createDataFrame([(s, total[s], goal[s]) for s in goal], "source string, source_size long, target double")
    goal_of = {s or "": goal[s] for s in goal if s is not None}
    goal_null = goal.get(None, 0.0)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        source = pdf["source"].iloc[0]
        target = goal_null if source is None or source != source else goal_of[source]
        passes, more = fit(pdf["size"].tolist(), pdf["n"].tolist(), target)
        return pdf[["source", "size"]].assign(passes=passes, more=more)

    counted = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    chosen = counted.groupBy("source").applyInPandas(fitted, "source string, size long, passes long, more long")
    buckets = sized.groupBy("source", "size", "bucket").agg(F.count("*").alias("held"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("below", F.coalesce(F.sum("held").over(before), F.lit(0)))
    same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))
    cut = buckets.alias("a").join(chosen.alias("b"), same).select("a.source", "a.size", "bucket", "held", "passes", (F.col("more") - F.col("below")).alias("room"))
    same &= F.col("a.bucket") == F.col("b.bucket")
    marked = sized.alias("a").join(cut.alias("b"), same).select("a.*", "passes", "held", "room")
    split = (F.col("room") > 0) & (F.col("room") < F.col("held"))
    at = Window.partitionBy("source", "size", "bucket").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id", *keep)
    whole = marked.filter(~split).select("id", "source", "size", *keep, (F.col("passes") + (F.col("room") > 0).cast("long")).alias("times"))
    some = marked.filter(split).withColumn("rn", F.row_number().over(at)).select("id", "source", "size", *keep, (F.col("passes") + (F.col("rn") <= F.col("room")).cast("long")).alias("times"))
    out = whole.unionByName(some)
    out = out.alias("a").join(F.broadcast(plan.alias("b")), F.col("a.source").eqNullSafe(F.col("b.source")))
    return out.select("id", "a.source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), *keep)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """`docs` as the mix holds them: a document taken twice is there twice; columns unchanged, whatever their names.

    Documents without words, null texts included, stay once, as they use no budget.  Rows that share an id are taken one by one, by
    their places in the table.  An empty table stays empty.
    """
    rows, file, row = located(docs)
    taken = mix(rows.select(F.col(id_col).alias("doc"), F.col(text_col).alias("words"), F.col(source_col).alias("from"), F.col(file).alias("_file"), F.col(row).alias("_row")), "doc", "words", "from", keep=("_file", "_row"), **options)
    times, turn = unused(docs.columns, "_times"), unused(docs.columns, "_pass")
    often = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1).cast("int")
    taken = taken.select(F.col("_file").alias(file), F.col("_row").alias(row), often.alias(times)).filter(F.col(times) > 0)
    return rows.join(taken, [file, row]).withColumn(turn, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
