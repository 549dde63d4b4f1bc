"""Evaluation: row metrics, summaries, slices, multiset precision and recall, decision tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import profiles as P


def distance(a: Column, b: Column) -> Column:
    """Edit distance; texts that differ little, as most pairs do, are told by narrow bands of the matrix."""
    band = lambda most: F.nullif(F.levenshtein(a, b, most), F.lit(-1))
    return F.when(a == b, 0).otherwise(F.coalesce(band(4), band(32), F.levenshtein(a, b)))


def cer(predicted: Column, target: Column) -> Column:
    """Character error rate; an empty target gives 0 for an empty prediction, else 1."""
    return F.when(target == "", F.when(predicted == "", 0.0).otherwise(1.0)).otherwise(distance(predicted, target) / F.length(target))


def wer(predicted: Column, target: Column) -> Column:
    """The same over texts with white space collapsed."""
    a, b = (T.strip(F.regexp_replace(x, T.WHITE, " ")) for x in (predicted, target))
    return cer(a, b)


def punct_count_error(predicted: Column, target: Column) -> Column:
    """Sum over marks of the difference of their counts."""

    def counted(x: Column) -> Column:
        total = F.lit(0)
        for c in P.PUNCT_CHARS:
            total = total + F.abs(T.count_of(x["a"], c) - T.count_of(x["b"], c))
        return F.when(x["a"] == x["b"], 0).otherwise(total)

    marks = F.struct(T.only(predicted, P.PUNCT_CHARS).alias("a"), T.only(target, P.PUNCT_CHARS).alias("b"))
    return F.when(predicted == target, 0).otherwise(T.let(marks, counted))


def analysis(rows: DataFrame, source: str = "error_text", target: str = "correct_text", predicted: str = "predicted_text", edits: str | None = None, word_edits: str | None = None, punct_edits: str | None = None) -> DataFrame:
    """`rows` with input_cer, pred_cer, cer_delta (what the prediction gained) and the flags that summaries count.

    `edits`, `word_edits` and `punct_edits` name counts of edits; without the last two, words and marks of the texts are compared.
    """
    s, t, p = F.col(source), F.col(target), F.col(predicted)
    out = rows.withColumns({"input_cer": cer(s, t), "pred_cer": cer(p, t)})
    alike = lambda a, b: (a == b) | (T.strip(a) == T.strip(b))
    clean, same = F.col("input_cer") == 0, alike(p, s)
    words = lambda c: F.transform(T.word_tokens(c, True), T.normalize_word)
    return out.withColumns({
        "cer_delta": F.col("input_cer") - F.col("pred_cer"), "exact_match": alike(p, t), "improved": F.col("pred_cer") < F.col("input_cer"), "worse": F.col("pred_cer") > F.col("input_cer"),
        "unchanged": same, "clean_overcorrection": clean & ~same, "word_overcorrection": clean & (F.col(word_edits) > 0 if word_edits else words(p) != words(t)),
        "punct_overcorrection": clean & (F.col(punct_edits) > 0 if punct_edits else T.only(p, P.PUNCT_CHARS) != T.only(t, P.PUNCT_CHARS)),
        "layout_changed_without_edits": (p != s) & ((F.col(edits) == 0) if edits else F.lit(False)), "punct_count_error": punct_count_error(p, t),
    })


def summary_columns(rows: DataFrame, digits: int = 6) -> list[Column]:
    clean, wrong = F.col("input_cer") == 0, F.col("input_cer") > 0
    mean = lambda c: F.avg(F.col(c).cast("double"))
    cols = {"exact_match": mean("exact_match"), "mean_input_cer": mean("input_cer"), "mean_pred_cer": mean("pred_cer"), "mean_cer_delta": mean("cer_delta"), "improved_rate": mean("improved"), "worse_rate": mean("worse"), "unchanged_rate": mean("unchanged")}
    cols |= {"unchanged_wrong_rate": F.avg(F.when(wrong, F.col("unchanged").cast("double")))}
    cols |= {f"{c}_rate": F.avg(F.when(clean, F.col(c).cast("double"))) for c in ("clean_overcorrection", "word_overcorrection", "punct_overcorrection")}
    cols |= {"mean_punct_count_error": mean("punct_count_error")}
    cols |= {n: mean(c) for n, c in (("mean_confidence", "confidence"), ("accepted_rate", "accepted"), ("punct_input_similarity", "punct_input_similarity"), ("punct_pred_similarity", "punct_pred_similarity")) if c in rows.columns}
    return [F.count("*").alias("examples"), *(F.round(c, digits).alias(n) for n, c in cols.items()), F.sum(F.col("layout_changed_without_edits").cast("long")).alias("layout_changed_without_edits_count")]


def summary(rows: DataFrame, by: list[str | Column] | None = None) -> DataFrame:
    """One row of metrics, or one for each group; rates over clean or wrong rows are null where there are none."""
    return rows.groupBy(*(by or [])).agg(*summary_columns(rows))


def summary_slices(rows: DataFrame) -> DataFrame:
    """Metrics of all rows, of clean rows and of dirty rows."""
    name = F.explode(F.array(F.lit("all"), F.when(F.col("input_cer") == 0, "clean").otherwise("dirty"))).alias("slice")
    return summary(rows.select("*", name), ["slice"])


def summary_by_label(rows: DataFrame, types: str = "error_types", min_count: int = 5) -> DataFrame:
    """Metrics of each error label with at least `min_count` occurrences; a row counts once for each of its labels, repeats included."""
    return summary(rows.withColumn("error_type", F.explode(T.labels_of(F.col(types)))), ["error_type"]).filter(F.col("examples") >= min_count)


def summary_by(rows: DataFrame, column: str) -> DataFrame:
    """Metrics of each value; null and '' are 'unknown'."""
    value = F.when(F.coalesce(F.col(column).cast("string"), F.lit("")) == "", "unknown").otherwise(F.col(column).cast("string"))
    return summary(rows.withColumn("slice", value), ["slice"])


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def worst(rows: DataFrame, key: list[str], n: int = 50) -> DataFrame:
    """The `n` rows whose error rate grew most."""
    return rows.orderBy("cer_delta", *key).limit(n)


def edit_overlap(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, tp, fp, fn, support): multiset overlap of two edit tables (keys, metric, edit_key)."""
    count = lambda d, n: d.groupBy(*keys, "metric", "edit_key").agg(F.count("*").alias(n))
    both = count(gold, "g").join(count(predicted, "p"), [*keys, "metric", "edit_key"], "full").fillna(0, ["g", "p"])
    return both.groupBy(*keys, "metric").agg(F.sum(F.least("g", "p")).alias("tp"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("fn"), F.sum("g").alias("support"))


def precision_recall(rows: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """Sums of tp, fp, fn and support with precision, recall and F1, 0 where a denominator is 0."""
    out = rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": F.round(p, digits), "recall": F.round(r, digits), "f1": F.round(ratio(2 * p * r, p + r), digits)})


def benchmark_row(rows: DataFrame, by: str = "dataset") -> DataFrame:
    """One wide row for each data set: precision, recall, F1 and counts of spelling, punctuation and case edits."""
    long = precision_recall(rows, [by, "metric"])
    cols = ("precision", "recall", "f1", "tp", "fp", "fn", "support")
    return long.groupBy(by).pivot("metric", ["spell", "punct", "case"]).agg(*(F.first(c).alias(c) for c in cols))


def target_place(candidates: Column, target: Column) -> Column:
    """Place of the target among candidate texts (from 0), null if it is not there."""
    at = F.array_position(F.transform(candidates, T.normalize_word), T.normalize_word(target))
    return F.when(at > 0, at - 1)


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)


def runs_table(summaries: dict[str, DataFrame]) -> DataFrame:
    """One row for each run of a comparison."""
    out = None
    for name, s in summaries.items():
        row = s.withColumn("run", F.lit(name))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out
