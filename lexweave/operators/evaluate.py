"""Evaluation of corrections: fact tables of edits and decisions beside what was expected, coverage of candidates, ratios, drill-downs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.profiles import RU, Profile
from ..sources import io
from . import align, metrics
from .candidates import candidates

ROW = ("difficulty", "error_types", "is_clean", "row_improved", "row_worse", "row_unchanged", "input_cer", "pred_cer", "cer_delta")


def row_facts(analysed: DataFrame, key: str) -> DataFrame:
    """(key, difficulty, error_types, is_clean, ...): what the fact tables repeat of each row; columns that are missing are 'unknown'."""
    have = lambda c: F.col(c) if c in analysed.columns else F.lit("unknown")
    return analysed.select(
        key, have("difficulty").alias("difficulty"), have("error_types").alias("error_types"), (F.col("input_cer") == 0).alias("is_clean"), F.col("improved").alias("row_improved"), F.col("worse").alias("row_worse"),
        F.col("unchanged").alias("row_unchanged"), "input_cer", "pred_cer", "cer_delta", F.col("error_text").alias("text"), F.col("predicted_text").alias("predicted"), F.col("correct_text").alias("target_text"),
    )


def expected(pairs: DataFrame, key: str) -> DataFrame:
    """(key, slot, expected_target, expected_source_punct, expected_target_punct): what each word of aligned pairs should become."""
    rows = align.edit_labels(pairs.select(key, "error_text", "correct_text")).select(key, F.posexplode_outer("example").alias("slot", "e")).filter("slot is not null")
    return rows.select(key, "slot", F.col("e.target").alias("expected_target"), F.col("e.source_punct").alias("expected_source_punct"), F.col("e.target_punct").alias("expected_target_punct"))


def edit_facts(edits: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """One row for each word edit, with the shape of its source and the facts of its row."""
    words = edits.filter((F.col("action") == "DELETE") | F.col("action").startswith("REPLACE"))
    source = F.col("source")
    first = F.regexp_replace(F.initcap(F.lower(source)), "-(\\p{L})", "-$1")
    shape = {"source_len": F.length(source), "source_norm": T.normalize_word(source), "source_is_lower": F.lower(source) == source, "source_is_title": T.is_upper(F.substring(source, 1, 1)) & (first == source), "source_is_upper": T.is_upper(source)}
    return words.withColumns(shape).join(facts, key)


def word_facts(decisions: DataFrame, wanted: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """One row for each word decision, beside its expected target: whether that is a replacement, among the candidates, and applied."""
    rows = decisions.join(wanted.select(key, "slot", "expected_target"), [key, "slot"], "left").withColumn("expected_target", F.coalesce("expected_target", F.lit("")))
    goal = T.normalize_word(F.col("expected_target"))
    replace = (F.col("expected_target") != "") & (goal != T.normalize_word(F.col("word")))
    rows = rows.withColumns({"target_is_replace": replace, "target_present": replace & F.exists("candidate_texts", lambda c: T.normalize_word(c) == T.normalize_word(F.col("expected_target")))})
    return rows.withColumn("target_present_but_not_applied", F.col("target_present") & ~F.col("applied")).join(facts, key)


def punct_facts(decisions: DataFrame, wanted: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """One row for each mark decision, beside the marks expected before and after: whether the change was predicted, and applied."""
    rows = decisions.join(wanted.select(key, "slot", "expected_source_punct", "expected_target_punct"), [key, "slot"], "left").fillna("", ["expected_source_punct", "expected_target_punct"])
    changed = F.col("expected_source_punct") != F.col("expected_target_punct")
    rows = rows.withColumns({"punct_target_changed": changed, "punct_target_predicted": changed & (F.col("predicted_punct") == F.col("expected_target_punct"))})
    return rows.withColumns({"punct_target_applied": F.col("punct_target_predicted") & F.col("punct_applied"), "punct_target_predicted_but_blocked": F.col("punct_target_predicted") & ~F.col("punct_applied")}).join(facts, key)


def coverage(pairs: DataFrame, lex: DataFrame, key: str, profile: Profile = RU, k: int = 16, **options) -> DataFrame:
    """(key, slot, word, target, rank, candidate_source): each word to be replaced with the place of its target among the candidates, -1 without."""
    rows = align.edit_labels(pairs.select(key, "error_text", "correct_text")).select(key, F.posexplode_outer("example").alias("slot", "e")).filter("slot is not null")
    rows = rows.filter(T.replace_rank(F.col("e.action")).isNotNull() & (F.col("e.target") != "") & (T.normalize_word(F.col("e.source")) != T.normalize_word(F.col("e.target"))))
    rows = rows.select(key, "slot", F.col("e.source").alias("word"), F.col("e.target").alias("target"))
    found = candidates(rows.select("word").distinct(), lex, profile, k, **options)
    lists = found.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "source"))).alias("c"))
    place = F.coalesce(metrics.target_place(F.transform(F.coalesce("c", F.array().cast("array<struct<rank:int,text:string,source:string>>")), lambda x: x["text"]), F.col("target")), F.lit(-1)).cast("int")
    rows = rows.join(lists, "word", "left").withColumn("rank", place)
    return rows.select(key, "slot", "word", "target", "rank", F.when(F.col("rank") >= 0, F.get("c", F.col("rank"))["source"]).alias("candidate_source"))


def coverage_rows(covered: DataFrame, key: str) -> DataFrame:
    """(key, replace_token_count, target_candidate_hit_count)."""
    return covered.groupBy(key).agg(F.count("*").alias("replace_token_count"), F.count_if(F.col("rank") >= 0).alias("target_candidate_hit_count"))


def rank_histogram(covered: DataFrame) -> DataFrame:
    """(candidate_source, rank, n): how often targets stand at each rank, by the source of the candidate; null for targets that are missing."""
    return covered.groupBy("candidate_source", "rank").agg(F.count("*").alias("n"))


def rank_maps(histogram: DataFrame) -> DataFrame:
    """(candidate_source, ranks): a map of ranks for each source."""
    entry = F.struct(F.col("rank").cast("string").alias("key"), F.col("n").alias("value"))
    return histogram.groupBy("candidate_source").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("ranks"))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null where the whole is 0."""
    return part / F.nullif(whole, F.lit(0))


def ratios(analysed: DataFrame, words: DataFrame, marks: DataFrame, covered: DataFrame, edits: DataFrame, digits: int = 6) -> DataFrame:
    """One row: targets present and not applied, mark targets predicted and blocked, coverage, splits applied, internal periods put into clean
    rows, and rows with a period mistaken for a comma that improved."""
    w = words.agg(F.count_if("target_present").alias("target_present_count"), F.count_if("target_present_but_not_applied").alias("target_present_but_not_applied_count"))
    names = ("changed", "predicted", "applied", "predicted_but_blocked")
    internal = F.col("is_clean") & F.col("punct_applied") & (F.col("position_type") == "internal") & (F.col("predicted_punct") == ".")
    m = marks.agg(*(F.count_if(f"punct_target_{n}").alias(f"punct_target_{n}_count") for n in names), F.count_if("punct_applied").alias("punct_applied_count"), F.count_if(F.col("predicted_punct") != F.col("source_punct")).alias("punct_change_candidate_count"), F.count_if("protected_gap").alias("protected_punct_gap_count"), F.count_if(internal).alias("_internal"))
    c = covered.agg(F.count("*").alias("replace_token_count"), F.count_if(F.col("rank") >= 0).alias("target_candidate_hit_count"))
    e = edits.agg(F.count_if(F.col("candidate_source") == "split").alias("split_applied_count"))
    period = F.col("error_types").contains("punct_wrong_period_to_comma")
    a = analysed.agg(F.greatest(F.count_if(F.col("input_cer") == 0), F.lit(1)).alias("_clean"), F.avg(F.when(period, F.col("improved").cast("double"))).alias("_period"))
    out = w.join(m).join(c).join(e).join(a)  # one row each
    rates = {
        "target_present_but_not_applied_rate": ratio(F.col("target_present_but_not_applied_count"), F.col("target_present_count")), "punct_target_predicted_but_blocked_rate": ratio(F.col("punct_target_predicted_but_blocked_count"), F.col("punct_target_predicted_count")),
        "candidate_coverage_rate": ratio(F.col("target_candidate_hit_count"), F.col("replace_token_count")), "internal_period_overcorrection_rate": F.col("_internal") / F.col("_clean"), "punct_wrong_period_to_comma_improved_rate": F.col("_period"),
    }
    return out.withColumns({n: F.round(x, digits) for n, x in rates.items()}).drop("_internal", "_clean", "_period")


def drill_downs(words: DataFrame, marks: DataFrame) -> dict[str, DataFrame]:
    """Targets that no candidate has, targets that were blocked, decisions about splits, marks that made a row worse."""
    return {
        "target_absent": words.filter("target_is_replace and not target_present"), "target_blocked": words.filter("target_present_but_not_applied"),
        "split_decisions": words.filter(F.exists("candidate_texts", lambda c: F.contains(c, F.lit(" ")))), "punct_regressions": marks.filter("punct_applied and row_worse"),
    }


def similar_marks(rows: DataFrame) -> DataFrame:
    """`rows` with the similarity of the input's and of the prediction's marks with the target's."""
    only = lambda c: T.only(F.col(c), metrics.P.PUNCT_CHARS)
    return rows.withColumns({"punct_input_similarity": align.similarity(only("error_text"), only("correct_text")), "punct_pred_similarity": align.similarity(only("predicted_text"), only("correct_text"))})


def generated_rows(rows: DataFrame, raw: str = "raw_text") -> DataFrame:
    """`rows` of a generative model with predicted_text, empty_generation and fallback_to_source, measured like any other prediction."""
    cleaned = T.generated(F.col(raw), F.lit(""))
    rows = rows.withColumns({"empty_generation": cleaned == "", "predicted_text": T.generated(F.col(raw), F.col("error_text"))})
    return metrics.analysis(rows.withColumn("fallback_to_source", F.col("empty_generation")))


def generated_summary(rows: DataFrame, digits: int = 6) -> DataFrame:
    """The summary of generated rows, with the rates of empty generations and of rows that fell back to their source."""
    rates = [F.round(F.avg(F.col(c).cast("double")), digits).alias(f"{c}_rate") for c in ("empty_generation", "fallback_to_source")]
    return rows.agg(*metrics.summary_columns(rows, digits), *rates)


def report(rows: DataFrame, folder: str, key: list[str], edits: DataFrame | None = None, words: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """Write a whole evaluation under `folder` (analysis, summary, labels, worst cases and, where given, the fact tables); the summary.

    `rows`: analysed rows.  Arrays in fact tables are written as JSON.
    """
    total = metrics.summary_slices(rows)
    io.write_table(rows, f"{folder}/error_analysis", "csv")
    io.write_table(metrics.summary_by_label(rows).orderBy("mean_cer_delta", F.desc("worse_rate")), f"{folder}/error_metrics_by_type", "csv")
    io.write_table(metrics.worst(rows, key), f"{folder}/worst_cases", "csv")
    io.write_summary(total, f"{folder}/summary")
    for name, table in (("word_edit_diagnostics", edits), ("word_decision_diagnostics", words), ("punct_edit_diagnostics", marks)):
        if table is not None:
            flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in table.dtypes]
            io.write_table(table.select(*flat), f"{folder}/{name}", "csv")
    return total
