"""What the findings of round 2 asked for."""

import difflib
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexweave.functions import text as T
from lexweave.operators import align, correct, fuzzy, inject, lexicon, metrics
from lexweave.plans.profiles import LATIN


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_key_joins_send_nothing_to_the_driver(spark):
    """keys of deletions are many times their words, which Spark does not see when it chooses to broadcast."""
    a, b = spark.createDataFrame([("understandng",)], "norm string"), spark.createDataFrame([("understanding",), ("undrstanding",)], "cand string")
    for join, want in ((fuzzy.within_one, {"understanding"}), (fuzzy.within_two, {"undrstanding"})):
        found = join(a, b)
        assert "Broadcast" not in plan(found) and {r.cand for r in found.collect()} == want


def test_lexicon_is_counted_by_hash(spark):
    """the first place of a word is the least (id, place), for any 64-bit id and null, without a sort of all words."""
    top = (1 << 63) - 1
    docs = spark.createDataFrame([(top, "zz aa"), (-top - 1, "cc bb"), (7, "aa bb aa"), (-7, "dd bb aa"), (None, "ee dd ee")], "doc_id long, text string")
    found = lexicon.lexicon(docs)
    assert "SortAggregate" not in plan(found)
    assert found.schema["first_doc"].dataType.simpleString() == "bigint"
    want = {"zz": (1, top, 0), "aa": (4, -7, 2), "cc": (1, -top - 1, 0), "bb": (3, -top - 1, 1), "dd": (2, None, 1), "ee": (2, None, 0)}
    assert {r.norm: (r.freq, r.first_doc, r.first_pos) for r in found.collect()} == want


@pytest.fixture
def odd(spark, tmp_path):
    """Documents with and without words beside a benchmark that knows a word with a doubled first letter."""
    texts = ["Mot. Les mot, les mot lles 5 Ann Bob", "!!! ... ???", "", None, "  ", "mmot mot aabcd abcd abcd"]
    docs = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "lles les")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def same_as_sql(spark, d, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet/*.parquet')")
    found = __spark_entry__.queries()[name](spark, d)
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in found.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["best_candidates", "checkable_words", "ranked_candidates"])
def test_doubled_first_letters_as_in_sql(spark, odd, name):
    """Their SQL has no rule of a doubled first letter."""
    same_as_sql(spark, odd, name) if name != "best_candidates" else None
    found = __spark_entry__.queries()[name](spark, odd).collect()
    assert not [r for r in found if r.word in ("mmot", "lles") and ("checked" in r and r.word == "lles" and r.checked or "source" in r and r.source == "rule" or name == "best_candidates")]


@pytest.mark.parametrize("name", ["entity_context", "gap_labels", "protected_gaps", "punct_classes", "rendered_gaps", "trainable_gaps", "layout_texts"])
def test_wordless_documents_as_in_sql(spark, odd, name):
    """Their SQL counts a document without a word once."""
    same_as_sql(spark, odd, name)


def test_rebuilt_layouts_grow_with_the_text(spark):
    """each array is computed once for a text, not for every slot."""
    n = 30_000
    text = spark.createDataFrame([("ab " * n,)], "t string")
    slots = T.word_slots(F.col("t"))
    began = time.time()
    (row,) = text.select(T.rebuild_layout(F.col("t"), slots, F.transform(slots, lambda x: F.upper(x["word"]))).alias("r")).collect()
    assert row.r == "AB " * n and time.time() - began < 120


def test_decisions_join_only_slots_with_candidates(spark):
    """slots without candidates or phrase go into no further join; decoding still gets every slot."""
    lex = lexicon.lexicon(spark.createDataFrame([(0, "understanding understanding house house")], "doc_id long, text string"))
    slots = correct.slot_rows(correct.line_rows(spark.createDataFrame([(0, "the house understandng")], "doc_id long, text string"), "doc_id", "text"), "doc_id")
    found = {every: {r.word for r in correct.options(slots, "doc_id", lex, LATIN, 8, None, None, False, None, every=every).collect()} for every in (True, False)}
    assert found == {True: {"the", "house", "understandng"}, False: {"understandng"}}


def test_words_in_step_are_aligned_as_by_difflib(spark):
    """pairs that skip difflib would be aligned by it place by place."""
    rng = random.Random(5)
    lists = [[rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(1500)]
    rows = [(x, [rng.choice("abcdwxyz") if rng.random() < 0.3 else c for c in x] + ["e"] * (rng.random() < 0.1)) for x in lists]
    rows += [(["a"] * 200, ["a"] * 199 + ["b"]), (["a"] * 199, ["a"] * 198 + ["b"]), ([], [])]
    found = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", align.in_step(F.col("a"), F.col("b")).alias("told")).collect()
    kept = lambda r: sum(i2 - i1 for op, i1, i2, j1, _ in difflib.SequenceMatcher(None, r.a, r.b).get_opcodes() if op == "equal" and i1 == j1)
    assert all(len(r.a) == len(r.b) and kept(r) == sum(x == y for x, y in zip(r.a, r.b)) for r in found if r.told)
    assert sum(r.told for r in found) > 400 and not [r for r in found if r.told and len(r.b) >= 200]


def test_overlap_is_told_within_a_pair(spark, odd):
    """no join of edit tables; the same counts as the two tables give, for pairs in step and others."""
    assert "Join" not in plan(__spark_entry__.queries()["benchmark_metrics"](spark, odd))
    texts = ["The cat sat, and the cat ran.", "Thx cat sat and the cat ran", "the cat sat. And the dog, the cat ran.", "The, cat; sat and cat cat ran!", "cat", "", "...", "Cat sat 1.5 the-cat on 3 mats?"]
    pairs = [(f"{i}-{j}-{k}", texts[i], texts[j], texts[k]) for i in range(8) for j in range(8) for k in range(8)]
    rows = spark.createDataFrame(pairs, "k string, e string, g string, m string")
    want = metrics.edit_overlap(align.edit_keys(rows, "e", "g", ["k"]), align.edit_keys(rows, "e", "m", ["k"]), ["k"])
    cols = ["k", "metric", "tp", "fp", "fn", "support"]
    got = align.pair_overlap(rows, "e", "g", "m", ["k"])
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_clean_share_is_exact_without_a_join(spark):
    """the cut is a threshold, so rows are joined to nothing; equal keys are ranked, and the share stays exact."""
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("sample"))
    found = inject.clean_slots(rows, 0.45, ["doc_id", "sample"])
    assert "Join" not in plan(found) and "Window" not in plan(found)
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("sample").cast("string"))
    order = [r.doc_id for r in rows.withColumn("h", inject.number(key, 42, "clean")).orderBy("h", "doc_id", "sample").collect()]
    assert {r.doc_id for r in found.filter("is_clean").collect()} == set(order[:1350])
    same = spark.range(20).select((F.col("id") % 2).alias("doc_id"))
    for ratio, want in ((0.0, 0), (0.01, 1), (0.3, 6), (0.75, 15), (1.0, 20)):
        got = inject.clean_slots(same, ratio, ["doc_id"])
        assert (got.count(), got.filter("is_clean").count()) == (20, want)
    assert inject.clean_slots(same.filter("doc_id > 5"), 0.45, ["doc_id"]).count() == 0


def test_rows_without_a_profile_are_left_alone(spark):
    """clean rows have no profile and cost no injection."""
    rows = spark.createDataFrame([(1, "understanding everything tomorrow", None), (2, "understanding everything tomorrow", "spelling_light")], "doc_id long, text string, p string")
    found = {r.doc_id: r for r in inject.inject(rows, "text", ["doc_id"], "p").select("doc_id", "text", "error_text", "error_labels").collect()}
    assert found[1].error_text == found[1].text and found[1].error_labels == [] and found[2].error_text != found[2].text
