"""Decoding of a sequence model's probabilities, with a context reranker's scores: word and mark decisions for every place.

The model and the reranker are tables: `windows` (key, window_id, start, action, punct) holds for each window the probabilities of its words
as arrays of arrays, `scores` (key, slot, text, score, available, reason) what the reranker says of the source and the candidates in their context.
A place in several windows goes to the window that sees most around it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gates as G
from ..functions import text as T
from ..plans import profiles as P
from . import windows as W

#: What a reranker must confirm: candidates of these sources, and any of several words.
CONTEXT_REQUIRED = ("split", "phrase_safe")
RERANKED = (*P.DICTIONARY_LIKE, *CONTEXT_REQUIRED)


def scored_windows(windows: DataFrame, scorer, schema: str, rows_a_batch: int = 256) -> DataFrame:
    """`windows` through a model: `scorer` takes a pandas frame of at most `rows_a_batch` windows and returns one of `schema`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), rows_a_batch):
                yield scorer(batch.iloc[at : at + rows_a_batch])

    return windows.mapInPandas(run, schema)


def model_windows(slots: DataFrame, keys: list[str], size: int = 128, overlap: int = 24) -> DataFrame:
    """(keys, window_id, start, words, puncts): the model's inputs, cut into windows that overlap; `slots`: keys, slot, word, label."""
    ordered = F.array_sort(F.collect_list(F.struct("slot", "word", "label")))
    rows = slots.groupBy(*keys).agg(ordered.alias("s")).select(*keys, "s", F.posexplode(W.window_ranges(F.size("s"), size, overlap)).alias("window_id", "w"))
    part = F.slice("s", F.col("w.start") + 1, F.col("w.end") - F.col("w.start"))
    return rows.select(*keys, "window_id", F.col("w.start").alias("start"), F.transform(part, lambda x: x["word"]).alias("words"), F.transform(part, lambda x: x["label"]).alias("puncts"))


def predictions(windows: DataFrame, keys: list[str], actions: list[str], puncts: list[str]) -> DataFrame:
    """(keys, slot, window_id, edge, action, confidence, margin, punct, punct_confidence, punct_margin): the most probable classes of each word in each window."""
    n = F.size("action")
    rows = windows.select(*keys, "window_id", "start", n.alias("_n"), F.posexplode(F.arrays_zip("action", "punct")).alias("_i", "_p"))

    def best(p: Column, classes: list[str]) -> tuple[Column, Column, Column]:
        name = F.get(F.array(*(F.lit(c) for c in classes)), (F.array_position(p, F.array_max(p)) - 1).cast("int"))
        return name, F.array_max(p), W.margin(p)

    action, confidence, margin = best(F.col("_p.action"), actions)
    punct, punct_confidence, punct_margin = best(F.col("_p.punct"), puncts)
    return rows.select(
        *keys, (F.col("start") + F.col("_i")).alias("slot"), "window_id", F.least("_i", F.col("_n") - 1 - F.col("_i")).alias("edge"), F.coalesce(action, F.lit("KEEP")).alias("action"), confidence.alias("confidence"), margin.alias("margin"),
        F.coalesce(punct, F.lit("")).alias("punct"), punct_confidence.alias("punct_confidence"), punct_margin.alias("punct_margin"),
    )


def finite(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))


def context_of(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slot, scores, ranked, context_margin, context_best): what the reranker says of a place; `ranked` holds finite scores, best first."""
    all_ = F.array_sort(F.collect_list(F.struct("place", "text", "score", "available", "reason"))).alias("scores")
    rows = scores.groupBy(*keys, "slot").agg(all_)
    good = F.filter("scores", lambda s: finite(s["score"]))
    rows = rows.withColumn("ranked", F.transform(F.array_sort(F.transform(good, lambda s: F.struct((-s["score"]).alias("neg"), s["place"].alias("place"), s["text"].alias("text")))), lambda s: F.struct(s["text"].alias("text"), (-s["neg"]).alias("score"))))
    margin = F.when(F.size("ranked") >= 2, F.get("ranked", F.lit(0))["score"] - F.get("ranked", F.lit(1))["score"]).otherwise(0.0)
    return rows.withColumns({"context_margin": margin, "context_best": F.coalesce(F.get("ranked", F.lit(0))["text"], F.lit(""))})


def judged_candidates(rows: DataFrame, row_id: list[str], lex: DataFrame, thresholds: dict, least: float, same_lemma: DataFrame | None) -> DataFrame:
    """`rows` with `judged`: its candidates with the reason of the first check and of the second, which knows the context's margin."""
    one = rows.select(*row_id, "word", "norm", "prev_word", "next_word", "known", "morph", "protected", "entity", "confidence", "margin", "context_margin", F.posexplode("cands").alias("rank", "c")).select("*", "c.*").drop("c")
    left, right = G.glued_parts(F.col("norm"), T.normalize_word(F.col("text")))
    one = one.withColumns({"_left": left, "_right": right, "_cand": T.normalize_word(F.col("text"))})
    for side in ("left", "right"):
        one = one.join(lex.select(F.col("norm").alias(f"_{side}"), F.lit(True).alias(f"{side}_known")), f"_{side}", "left").withColumn(f"{side}_known", F.coalesce(f"{side}_known", F.lit(False)))
    if same_lemma is not None:
        pairs = same_lemma.select(F.col("a").alias("norm"), F.col("b").alias("_cand"), F.lit(True).alias("same_lemma")).distinct()
        one = one.join(pairs, ["norm", "_cand"], "left").withColumn("same_lemma", F.coalesce("same_lemma", F.lit(False)))
    else:
        one = one.withColumn("same_lemma", F.lit(False))
    row = {"source": F.col("word"), "prev": F.col("prev_word"), "next": F.col("next_word")}
    row |= {k: F.col(k) for k in ("text", "cand_source", "score", "distance", "rank", "known", "morph", "same_lemma", "protected", "entity", "left_known", "right_known", "confidence", "margin")}
    first = G.word_reason(row, thresholds, True, least)
    # The second check of a candidate that was not scored has a margin of 0; of a scored one the context's.
    second = G.word_reason(row, thresholds, False, least, F.coalesce("context_margin", F.lit(0.0)))
    plain = G.word_reason(row, thresholds, False, least, F.lit(0.0))
    one = one.withColumns({"first": first, "second": second, "plain": plain})
    judged = F.array_sort(F.collect_list(F.struct("rank", "text", "cand_source", "distance", "score", "first", "second", "plain"))).alias("judged")
    return rows.join(one.groupBy(*row_id).agg(judged), row_id, "left")


def outcome(selected: Column, judged: Column, scores: Column, ranked: Column, context_margin: Column, word: Column, norm: Column, free: Column, confidence: Column, need: float) -> Column:
    """struct<text, rank, reason, reranked, scored>: what the reranker makes of a candidate that passed the first check; text null where it is refused.

    `free`: the source is unknown, in lower case, of the profile's script, and neither protected nor in an entity context.
    """
    source = selected["cand_source"]
    required = source.isin(*CONTEXT_REQUIRED) | F.contains(selected["text"], F.lit(" "))
    said = lambda keep, reason, scored, other=None, moved=False: F.struct(F.when(keep, (selected if other is None else other)["text"]).alias("text"), F.when(keep, (selected if other is None else other)["rank"]).alias("rank"), reason.alias("reason"), F.lit(moved).alias("reranked"), F.lit(scored).alias("scored"))
    refuse = lambda reason, scored=True, moved=False: said(F.lit(False), reason, scored, None, moved)
    accept = lambda reason, scored=True, other=None, moved=False: said(F.lit(True), F.lit(reason) if isinstance(reason, str) else reason, scored, other, moved)
    unlike = F.filter(judged, lambda c: c["cand_source"].isin(*RERANKED) & (T.normalize_word(c["text"]) != norm))
    best = T.normalize_word(F.get(ranked, F.lit(0))["text"])
    own = F.exists(ranked, lambda s: T.normalize_word(s["text"]) == norm)
    better = F.get(F.filter(unlike, lambda c: T.normalize_word(c["text"]) == best), F.lit(0))
    relaxed = source.isin(*P.DICTIONARY_LIKE) & (context_margin < 0.75) & (confidence >= 0.95) & (selected["distance"] == 1) & free
    lost = F.exists(scores, lambda s: ~s["available"])
    changed = T.normalize_word(better["text"]) != T.normalize_word(selected["text"])
    clear = context_margin >= need
    why = F.coalesce(F.get(scores, F.lit(0))["reason"], F.lit("no_scores"))
    return (
        F.when(~source.isin(*RERANKED), accept("not_called", False))
        .when(scores.isNull(), F.when(required, refuse(F.concat(source, F.lit("_context_disabled")), False)).otherwise(accept("not_called", False)))
        .when(F.size(unlike) == 0, accept("no_viable_candidates", False))
        .when((F.size(scores) == 0) | lost, F.when(required, refuse(F.concat(source, F.lit("_context_unavailable:"), why), False)).otherwise(accept(why, False)))
        .when(F.size(ranked) < 2, F.when(required, refuse(F.concat(source, F.lit("_context_non_finite")), False)).otherwise(accept("context_non_finite", False)))
        .when(own & (best == norm) & clear, F.when(relaxed, accept("context_source_veto_relaxed")).otherwise(refuse(F.lit("context_prefers_source"), True, True)))
        .when((best != norm) & clear & better.isNotNull() & (better["first"] == ""), F.when(changed, accept("context_changed_top1", True, better, True)).otherwise(accept("context_confirmed", True, better)))
        .when(required, refuse(F.concat(source, F.lit("_context_low_margin")))).otherwise(accept("context_low_margin"))
    )


def decode(options: DataFrame, windows: DataFrame, keys: list[str], lex: DataFrame, thresholds: dict, actions: list[str], puncts: list[str], scores: DataFrame | None = None, same_lemma: DataFrame | None = None, least: float = 0.25, need: float = 0.25, mode: str = "conservative") -> DataFrame:
    """One row for each word: its decision about the word and about the gap behind it.

    `options`: keys, slot, word, norm, gap, label, prev_word, next_word, is_final, cands, known, morph, protected, entity (`correct.options`).
    Columns: keys, slot, word, predicted_action, confidence, margin, selected_rank, selected_text, selected_source, selected_score, applied,
    blocked_reason, output_word, source_punct, predicted_punct, punct_confidence, punct_margin, punct_applied, punct_reason, output_punct, is_final,
    protected_gap, position_type, context_best, context_margin, reranker_reason, window_id, conflict.
    """
    rows = predictions(windows, keys, actions, puncts).join(options, [*keys, "slot"])
    if scores is not None:
        rows = rows.join(context_of(scores, keys), [*keys, "slot"], "left")
    else:
        rows = rows.withColumns({"scores": F.lit(None).cast("array<struct<place:int,text:string,score:double,available:boolean,reason:string>>"), "ranked": F.lit(None).cast("array<struct<text:string,score:double>>"), "context_margin": F.lit(0.0), "context_best": F.lit("")})
    rows = judged_candidates(rows, [*keys, "slot", "window_id"], lex, thresholds, least, same_lemma)
    word, norm = F.col("word"), F.col("norm")
    rank = T.replace_rank(F.col("action"))
    rows = rows.withColumns({"_rank": rank, "_picked": F.get("judged", rank)})
    free = ~F.col("known") & ~F.col("morph") & (F.lower(word) == word) & ~T.has_latin(word) & ~F.col("protected") & ~F.col("entity")
    tried = F.col("_picked").isNotNull() & (F.col("_picked.first") == "") & (F.col("_picked.text") != word)
    said = outcome(F.col("_picked"), F.col("judged"), F.col("scores"), F.col("ranked"), F.col("context_margin"), word, norm, free, F.col("confidence"), need)
    rows = rows.withColumns({"_tried": F.coalesce(tried, F.lit(False)), "_said": F.when(tried, said)})
    final = F.get("judged", F.col("_said.rank"))
    second = F.when(F.col("_said.scored"), final["second"]).otherwise(final["plain"])
    reason = F.when(F.col("_tried"), F.when(F.col("_said.text").isNull(), F.col("_said.reason")).otherwise(second))
    deleted = (F.col("action") == "DELETE") & (F.col("confidence") >= thresholds["delete"])
    blocked = (
        F.when(F.col("_rank").isNotNull() & F.col("_picked").isNull(), "replace_rank_out_of_range").when(F.col("_tried"), F.when(reason == "", "applied").otherwise(reason))
        .when(F.col("_picked").isNotNull(), F.col("_picked.first")).when(deleted, "applied").when(F.col("action") == "DELETE", "low_delete_confidence").otherwise("keep")
    )
    rows = rows.withColumn("blocked_reason", blocked)
    applied = F.col("blocked_reason") == "applied"
    chosen = F.when(F.col("_tried"), final).otherwise(F.col("_picked"))
    protected = T.protected_gap(F.col("gap"), word, F.col("next_word"))
    why = G.punctuation_reason(F.col("label"), F.col("punct"), F.col("gap"), word, F.col("next_word"), F.col("is_final"), F.col("punct_confidence"), F.col("punct_margin"), thresholds, F.col("protected_gap"), mode)
    rows = rows.withColumns({"applied": applied, "_chosen": chosen, "protected_gap": protected})
    rows = rows.withColumn("punct_reason", why).withColumn("punct_applied", G.punctuation_applies(F.col("punct_reason")) & (F.col("punct") != F.col("label")))
    rows = rows.withColumns({
        "output_word": F.when(~F.col("applied"), word).when(F.col("_tried"), F.col("_chosen.text")).otherwise(""), "output_punct": F.when(F.col("punct_applied"), F.col("punct")).otherwise(F.col("label")),
        "position_type": F.when(F.col("protected_gap"), "protected").when(F.col("is_final"), "final").otherwise("internal"), "token_confidence": F.greatest("confidence", "punct_confidence"),
    })
    detail = F.struct(
        "word", F.col("action").alias("predicted_action"), "confidence", "margin", F.coalesce("_chosen.rank", F.lit(-1)).alias("selected_rank"), F.coalesce("_chosen.text", F.lit("")).alias("selected_text"), F.coalesce("_chosen.cand_source", F.lit("")).alias("selected_source"),
        F.coalesce("_chosen.score", F.lit(0.0)).alias("selected_score"), F.coalesce("_chosen.distance", F.lit(0)).alias("selected_distance"), "applied", "blocked_reason", "output_word", F.transform("cands", lambda c: c["text"]).alias("candidate_texts"), F.col("label").alias("source_punct"), F.col("punct").alias("predicted_punct"),
        "punct_confidence", "punct_margin", "punct_applied", "punct_reason", "output_punct", "is_final", "protected_gap", "position_type", F.when(F.col("_said.scored"), F.col("context_best")).otherwise("").alias("context_best"),
        F.when(F.col("_said.scored"), F.col("context_margin")).otherwise(0.0).alias("context_margin"), F.coalesce("_said.reason", F.lit("")).alias("reranker_reason"), F.coalesce("_said.reranked", F.lit(False)).alias("reranked"), "token_confidence",
    )
    out = rows.select(*keys, "slot", "window_id", "edge", F.col("token_confidence").alias("confidence"), F.struct("output_word", "output_punct").alias("output"), detail.alias("detail"))
    best = W.resolve_overlaps(out, [*keys, "slot"], ["detail"])
    return best.select(*keys, "slot", "detail.*", "window_id", "conflict")


def logged(decisions: DataFrame) -> DataFrame:
    """The word decisions worth a row: any that is not KEEP, or that had a candidate besides the word itself."""
    return decisions.filter((F.col("predicted_action") != "KEEP") | F.exists("candidate_texts", lambda c: (c != F.col("word")) & (T.normalize_word(c) != "")))


def edits(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, slot, source, target, action, confidence, candidate_source, ...): the edits that decisions apply, words before marks."""
    common = [*keys, "slot"]
    words = decisions.filter("applied").select(*common, F.col("word").alias("source"), F.col("output_word").alias("target"), F.when(F.col("predicted_action") == "DELETE", "DELETE").otherwise(T.replace_action(F.greatest("selected_rank", F.lit(0)))).alias("action"), "confidence", F.col("selected_source").alias("candidate_source"), F.col("selected_distance").alias("candidate_distance"), F.col("selected_score").alias("candidate_score"), F.col("selected_rank").alias("candidate_rank"), "context_margin", "reranked", "reranker_reason")
    marks = decisions.filter("punct_applied").select(*common, F.col("source_punct").alias("source"), F.col("output_punct").alias("target"), F.lit("PUNCT").alias("action"), F.col("punct_confidence").alias("confidence"))
    return words.unionByName(marks, allowMissingColumns=True)


def runtime_counters(decisions: DataFrame) -> DataFrame:
    """One row of counters over all decisions: reranker outcomes, recoveries, guards."""
    r, p = F.col("reranker_reason"), F.col("punct_reason")
    said = {
        "reranker_called_count": r.startswith("context_") | r.rlike("_context_(unavailable|non_finite|low_margin)"), "reranker_changed_top1_count": r == "context_changed_top1", "reranker_source_preferred_count": r.isin("context_prefers_source", "context_source_veto_relaxed"),
        "context_source_veto_relaxed_count": r == "context_source_veto_relaxed", "split_blocked_by_context_count": (F.col("blocked_reason") == r) & (r.startswith("split_context") | ((r == "context_prefers_source") & F.col("selected_source").isin("split"))),
        "safe_comma_delete_recovery_count": p.isin("safe_comma_delete_recovery", "safe_service_comma_delete_recovery", "safe_date_comma_delete_recovery"), "safe_service_comma_delete_recovery_count": p == "safe_service_comma_delete_recovery",
        "safe_date_comma_delete_recovery_count": p == "safe_date_comma_delete_recovery", "safe_final_period_recovery_count": p == "safe_final_period_recovery",
        "comma_delete_blocked_count": p.startswith("comma_delete") | (p == "low_comma_delete_confidence_or_margin"), "comma_insert_blocked_count": p.startswith("comma_insert"), "entity_guard_blocked_count": F.col("blocked_reason").isin("entity_context_guard", "protected_lexicon_word"),
    }
    return decisions.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in said.items()))


def corrected_lines(lines: DataFrame, decisions: DataFrame, keys: list[str], text_col: str = "line") -> DataFrame:
    """(keys, line, rebuilt, edits, confidence): lines with the decisions applied, gaps kept byte for byte where no mark was changed."""
    ordered = F.array_sort(F.collect_list(F.struct("slot", "output_word", "output_punct", "source_punct", "punct_applied", "applied", "token_confidence"))).alias("d")
    made = decisions.groupBy(*keys).agg(ordered)
    rows = lines.join(made, keys, "left")
    col = lambda n: F.transform("d", lambda x: x[n])
    count = F.coalesce(reduce(lambda a, n: a + F.size(F.filter("d", lambda x: x[n])), ("applied", "punct_applied"), F.lit(0)), F.lit(0))
    rewrite = F.transform(F.filter("d", lambda x: x["punct_applied"]), lambda x: x["slot"])
    rebuilt = T.rebuild_layout(F.col(text_col), T.word_slots(F.col(text_col)), col("output_word"), col("output_punct"), col("source_punct"), rewrite=rewrite)
    seen = F.filter(col("token_confidence"), lambda c: c > 0)
    mean = F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda a, x: a + x) / F.size(seen)).otherwise(1.0)
    rows = rows.withColumn("edits", count)
    return rows.select(*keys, F.col(text_col).alias("line"), F.when(F.col("edits") > 0, rebuilt).otherwise(F.col(text_col)).alias("rebuilt"), "edits", F.coalesce(mean, F.lit(1.0)).alias("confidence"))
