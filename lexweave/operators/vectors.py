"""Model inputs: word and candidate ids, padded sequences, sample weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import profiles as P

PUNCT_CLASSES = sorted({*P.SIMPLE_LABELS, *P.STRUCTURAL_LABELS})


def action_classes(k: int = 16) -> list[str]:
    return ["KEEP", "DELETE", *(f"REPLACE_{i}" for i in range(k))]


def class_id(value: Column, classes: list[str]) -> Column:
    """Place of a label among the classes, 0 if it is none of them."""
    return F.coalesce(F.create_map(*(F.lit(x) for i, c in enumerate(classes) for x in (c, i)))[value], F.lit(0))


def padded(values: Column, length: int, fill: Column | float = 0) -> Column:
    """Exactly `length` values: cut, or filled at the end."""
    fill = fill if isinstance(fill, Column) else F.lit(fill)
    return F.slice(F.concat(values, F.array_repeat(fill, length)), 1, length)


def word_ids(rows: DataFrame, vocab: DataFrame, keys: list[str], words: str = "words") -> DataFrame:
    """(keys, ids): ids of a row's words in order; 1 for words that the vocabulary does not have."""
    one = rows.select(*keys, F.posexplode(words).alias("pos", "w")).withColumn("norm", T.normalize_word(F.col("w")))
    one = one.join(vocab.select("norm", "word_id"), "norm", "left")
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("word_id", F.lit(1)).alias("id")))), lambda x: x["id"]).alias("ids"))


def sample_weights(example: Column, is_clean: Column, action_change: float = 3.0, clean_keep: float = 2.0, dirty_keep: float = 1.0, punct_change: float = 8.0, punct_clean: float = 2.0, punct_dirty: float = 1.0, final: float = 8.0) -> tuple[Column, Column]:
    """(action weights, punctuation weights) of an aligned example's tokens."""
    n = F.size(example)
    action = F.transform(example, lambda e: F.when(e["action"] != "KEEP", action_change).when(is_clean, clean_keep).otherwise(dirty_keep))
    punct = F.transform(example, lambda e, i: F.when(e["source_punct"] != e["target_punct"], F.when(i == n - 1, final).otherwise(punct_change)).when(is_clean, punct_clean).otherwise(punct_dirty))
    return action, punct


def candidate_ids(rows: DataFrame, vocab: DataFrame, keys: list[str], texts: str = "candidates", k: int = 16) -> DataFrame:
    """(keys, candidate_ids): for each word of a row the ids of its first `k` candidate texts, 1 where unknown or missing.

    `texts`: array<array<string>>.  A text of several words takes the id of its first known one.
    """
    lists = F.transform(texts, lambda c: F.transform(padded(F.transform(c, lambda x: F.coalesce(x, F.lit(""))), k, F.lit("")), lambda x: x))
    one = rows.select(*keys, F.posexplode(lists).alias("pos", "_c")).select(*keys, "pos", F.posexplode("_c").alias("rank", "_t"))
    part = one.select(*keys, "pos", "rank", F.posexplode(F.split(F.regexp_replace(T.strip(F.col("_t")), T.WHITE, " "), " ")).alias("at", "_w")).withColumn("norm", T.normalize_word(F.col("_w")))
    part = part.join(vocab.select("norm", "word_id"), "norm", "left").groupBy(*keys, "pos", "rank").agg(F.min_by("word_id", F.when(F.col("word_id").isNotNull(), F.col("at"))).alias("id"))
    row = part.groupBy(*keys, "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("id", F.lit(1)).alias("id")))), lambda x: x["id"]).alias("ids"))
    return row.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"]).alias("candidate_ids"))


def tensors(examples: DataFrame, vocab: DataFrame, key: str, length: int = 128, k: int = 16, **weights: float) -> DataFrame:
    """(key, token_ids, candidate_ids, source_punct_ids, action_ids, punct_ids, action_weights, punct_weights), each `length` long.

    `examples`: key, example, is_clean.  What is missing at the end is 0; the last word within `length` counts as final.
    """
    cut = examples.withColumn("example", F.slice("example", F.lit(1), F.lit(length)))
    rows = cut.select(key, "example", "is_clean", F.transform("example", lambda e: e["source"]).alias("words"), F.transform("example", lambda e: e["candidates"]).alias("candidates"))
    action, punct = sample_weights(F.col("example"), F.col("is_clean"), **weights)
    actions = action_classes(k)
    made = rows.select(
        key, padded(F.transform("example", lambda e: class_id(e["source_punct"], PUNCT_CLASSES)), length).alias("source_punct_ids"), padded(F.transform("example", lambda e: class_id(e["action"], actions)), length).alias("action_ids"),
        padded(F.transform("example", lambda e: class_id(e["target_punct"], PUNCT_CLASSES)), length).alias("punct_ids"), padded(action, length, 0.0).alias("action_weights"), padded(punct, length, 0.0).alias("punct_weights"),
    )
    ids = word_ids(rows, vocab, [key]).select(key, padded(F.col("ids"), length).alias("token_ids"))
    found = candidate_ids(rows, vocab, [key], k=k).select(key, F.slice(F.concat("candidate_ids", F.array_repeat(F.array_repeat(F.lit(0), k), length)), 1, length).alias("candidate_ids"))
    return made.join(ids, key).join(found, key)
