"""Decision tables: every case of the built tables has the outcome that its SQL states."""

import duckdb
import pytest

import __spark_entry__
from lexweave.plans import golden

QUICK = [
    "ru_word_gates", "ru_punctuation_gates", "ru_guard", "ru_pairs", "ru_edit_keys", "ru_benchmark", "ru_similarity", "ru_word_diff", "ru_texts", "ru_gaps", "ru_candidates", "ru_blocked_splits", "ru_mined_confusions", "ru_top_candidates", "ru_keep_candidates", "ru_eligible", "ru_noise",
    "ru_rerank", "ru_decode", "ru_punct_targets", "ru_phrases", "ru_injection_rules", "ru_injection_operators", "ru_generated", "ru_wer", "ru_tensors", "ru_should_check", "window_conflicts",
]


@pytest.mark.parametrize("name", QUICK)
def test_outcomes(spark, name):
    got = __spark_entry__.queries()[name](spark, "")
    want = duckdb.connect().sql(__spark_entry__.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = sorted((tuple(r) for r in got.select(*order).collect()), key=repr)
    assert rows == sorted(want.select(*(f'"{c}"' for c in order)).fetchall(), key=repr)


def test_every_registered_query_with_sql_says_what_it_checks():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and all(q.__doc__ for q in queries.values())
    assert golden.literal("it's") == "'it''s'" and golden.literal(None) == "NULL"


def test_report(spark, tmp_path):
    from lexweave.operators import evaluate, metrics

    rows = metrics.analysis(golden.built(spark, "error_text string, correct_text string, predicted_text string, error_types string", [("кат", "кот", "кот", "a")] * 6 + [("да", "да", "да", "b")]))
    total = evaluate.report(rows, str(tmp_path), ["case_id"], words=golden.decoded(spark)[1])
    assert {r.slice: r.examples for r in total.collect()} == {"all": 7, "clean": 1, "dirty": 6}
    assert {p.name for p in tmp_path.iterdir()} == {"error_analysis", "error_metrics_by_type", "worst_cases", "summary", "word_decision_diagnostics"}
    assert spark.read.json(str(tmp_path / "summary")).count() == 3


def test_model_windows_and_scorer(spark):
    from pyspark.sql import functions as F

    from lexweave.operators import correct, decode

    lines = spark.createDataFrame([(1, 0, "слово " * 200), (2, 0, "да")], "k int, line_no int, line string")
    made = decode.model_windows(correct.slot_rows(lines, "k"), ["k", "line_no"])
    assert sorted((r.k, r.window_id, r.start, len(r.words), len(r.puncts)) for r in made.collect()) == [(1, 0, 0, 128, 128), (1, 1, 104, 96, 96), (2, 0, 0, 1, 1)]
    scored = decode.scored_windows(made.select("k", "window_id", F.size("words").alias("n")), lambda pdf: pdf.assign(n=pdf["n"] * 2), "k int, window_id int, n int", 1)
    assert sorted(r.n for r in scored.collect()) == [2, 192, 256]
