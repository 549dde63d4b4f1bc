"""Operators on small tables, against expected rows or plain Python."""

import difflib

import pytest
from pyspark.sql import functions as F

from lexweave.functions import gates as G
from lexweave.operators import align, candidates, correct, diff, fuzzy, inject, lexicon, metrics, splits, vectors, windows
from lexweave.plans.profiles import LATIN, RU
from lexweave.sources import io
from lexweave.streaming.correct import unknown_word_stream


def texts(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_lexicon(spark):
    lex = lexicon.lexicon(texts(spark, ["Кот и кот. Пёс", "пес а", None, ""]))
    assert {(r.norm, r.freq, r.len, r.first_doc, r.first_pos) for r in lex.collect()} == {("кот", 2, 3, 0, 0), ("пес", 2, 3, 0, 3)}
    assert [(r.norm, r.word_id) for r in lexicon.vocabulary(lex, 3).collect()] == [("кот", 2)]
    assert lexicon.unknown_words(lexicon.word_rows(texts(spark, ["кот мяу"])), lex).select("word").collect()[0][0] == "мяу"


def osa(a, b):
    """Optimal string alignment distance by its whole matrix."""
    full = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            full[i][j] = min(full[i - 1][j] + 1, full[i][j - 1] + 1, full[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                full[i][j] = min(full[i][j], full[i - 2][j - 2] + 1)
    return full[-1][-1]


def test_osa_columns(spark):
    """Distances of exactly one and two, told by columns, against the whole matrix over all words of up to five of three letters."""
    import itertools
    import random

    words = ["".join(w) for n in range(6) for w in itertools.product("abc", repeat=n)]
    rng = random.Random(3)
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(6000)] + [(w, w) for w in words[:20]] + [("ca", "abc"), ("abcdef", "badcef"), ("abcdef", "bacdfe"), ("bb", "aaaa")]
    for _ in range(3000):
        w = list(rng.choice(words[100:]) + rng.choice(words[100:]))
        v = list(w)
        for _ in range(2):
            i = rng.randrange(len(v) - 1)
            kind = rng.randrange(4)
            v[i : i + 2] = [v[i + 1], v[i]] if kind == 0 else [v[i]] if kind == 1 else [v[i], "x", v[i + 1]] if kind == 2 else ["y", v[i + 1]]
        pairs.append(("".join(w), "".join(v)))
    frame = spark.createDataFrame(pairs, "a string, b string").select("a", "b", G.one_osa(F.col("a"), F.col("b")).alias("one"), G.two_osa(F.col("a"), F.col("b")).alias("two"))
    for r in frame.collect():
        assert (r.one, r.two) == (osa(r.a, r.b) == 1, osa(r.a, r.b) == 2), (r.a, r.b)


def test_distance_joins(spark):
    import itertools
    import random

    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(150)})
    left, right = words[::2], words[1::2]
    a, b = spark.createDataFrame([(w,) for w in left], "norm string"), spark.createDataFrame([(w,) for w in right], "cand string")
    for n, found in ((1, fuzzy.within_one(a, b)), (2, fuzzy.within_two(a, b))):
        want = {(x, y) for x, y in itertools.product(left, right) if osa(x, y) == n}
        rows = [(r.norm, r.cand) for r in found.collect()]
        assert set(rows) == want and len(rows) == len(want)
    pairs = spark.createDataFrame([("aab", "ab"), ("abcd", "abdc"), ("a", "b")], "a string, b string")
    assert [r.x for r in pairs.select(G.safe_edit_shape(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, False]


def lex_of(spark, words):
    return spark.createDataFrame([(w, f, len(w), 0, i) for i, (w, f) in enumerate(words.items())], "norm string, freq long, len int, first_doc long, first_pos int")


def ranked(spark, words, lex, **options):
    found = candidates.candidates(spark.createDataFrame([(w,) for w in words], "word string"), lex_of(spark, lex), RU, **options)
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.word, r["rank"])):
        out.setdefault(r.word, []).append((r.text, r.source))
    return out


def test_candidates(spark):
    found = ranked(spark, ["Инел", "гель", "москва", "паралон", "вобщем", "отеты", "сообщаетсяна", "ллет"], {"интел": 3, "дело": 5, "одеты": 2, "ответы": 8, "сообщается": 4, "на": 9, "лет": 4, "в": 3, "общем": 2}, split=True)
    assert ("Интел", "dictionary") in found["Инел"] and not any(t == "дело" for t, _ in found.get("гель", []))
    assert found["москва"][0] == ("Москва", "rule") and found["паралон"][0] == ("поролон", "rule") and found["вобщем"][0] == ("в общем", "phrase_safe")
    assert [t for t, _ in found["отеты"]].index("ответы") in (0, 1) and found["сообщаетсяна"][0] == ("сообщается на", "split") and found["ллет"][0] == ("лет", "rule")
    mined = spark.createDataFrame([("давольно", "довольно", 2, 1)], "source string, target string, count long, place int")
    assert ("довольно", "mined") in ranked(spark, ["давольно"], {"довольно": 3}, mined=mined)["давольно"]


def test_alignment(spark):
    pairs = spark.createDataFrame([("Превет мир", "Привет мир"), ("по новому делу", "по-новому делу"), ("а б в", "а в"), ("а в", "а б в"), ("Дом стоит", "Дом, стоит")], "error_text string, correct_text string")
    rows = {r.error_text: r for r in align.edit_labels(pairs).collect()}
    actions = lambda t: rows[t].example and [e.action for e in rows[t].example]
    assert actions("Превет мир") == ["REPLACE_0", "KEEP"] and actions("по новому делу") == ["REPLACE_0", "DELETE", "KEEP"] and actions("а б в") == ["KEEP", "DELETE", "KEEP"] and actions("а в") is None
    assert [e.target_punct for e in rows["Дом стоит"].example] == [",", ""]
    edits = align.edit_keys(pairs, "error_text", "correct_text", ["error_text"])
    score = metrics.precision_recall(metrics.edit_overlap(edits, edits, ["error_text"]), ["metric"]).collect()
    assert all(r.f1 == 1.0 and r.fp == r.fn == 0 for r in score) and {r.metric for r in score} == {"spell", "punct"}
    action, punct = vectors.sample_weights(F.col("example"), F.col("is_clean"))
    row = align.edit_labels(pairs).filter("correct_text = 'Дом, стоит'").select(action.alias("a"), punct.alias("p")).first()
    assert row.a == [1.0, 1.0] and row.p == [8.0, 1.0]


def test_mined_confusions(spark):
    pairs = spark.createDataFrame([("он давольно", "он довольно")] * 2 + [("мы кот", "мы пес")], "error_text string, correct_text string")
    assert [(r.source, r.target, r["count"]) for r in align.mined_confusions(pairs, lex_of(spark, {"довольно": 2, "пес": 1})).collect()] == [("давольно", "довольно", 2)]


def test_windows(spark):
    row = spark.range(1).select(windows.window_ranges(F.lit(260)).alias("a"), windows.window_ranges(F.lit(128)).alias("b"), windows.window_ranges(F.lit(0)).alias("c")).first()
    assert [(w.start, w.end) for w in row.a] == [(0, 128), (104, 232), (208, 260)] and [(w.start, w.end) for w in row.b] == [(0, 128)] and row.c == []
    rows = spark.createDataFrame([(1, 0, 3, 0.5, "a"), (1, 1, 3, 0.9, "b"), (1, 2, 1, 0.99, "c"), (2, 0, 2, 0.5, "a"), (2, 1, 2, 0.5, "z")], "i int, window_id int, edge int, confidence double, output string")
    assert {(r.i, r.window_id, r.conflict) for r in windows.resolve_overlaps(rows, ["i"]).collect()} == {(1, 1, True), (2, 0, False)}
    spans = spark.createDataFrame([([(5, 6, "r"), (0, 2, "r"), (3, 4, "r"), (4, 5, "d")],), ([],)], "s array<struct<s:int,e:int,t:string>>")
    assert [[tuple(x) for x in r.m] for r in spans.select(windows.merge_spans(F.col("s")).alias("m")).collect()] == [[(0, 4, "r"), (4, 5, "d"), (5, 6, "r")], []]
    assert spark.range(1).select(windows.margin(F.array(F.lit(0.2), F.lit(0.7), F.lit(0.1))).alias("m")).first().m == pytest.approx(0.5)


def test_splits(spark):
    rows = texts(spark, [f"text {i}" for i in range(100)] + ["text 1", " ", None])
    got = splits.leak_free(rows).collect()
    count = lambda s: sum(r.split == s for r in got)
    assert (count("train"), count("val"), count("test")) == (80, 10, 10) and sorted(map(str, got)) == sorted(map(str, splits.leak_free(rows.repartition(3)).collect()))
    assert inject.clean_slots(texts(spark, [str(i) for i in range(10)]), 0.30, ["doc_id"]).filter("is_clean").count() == 3
    assert splits.in_texts(rows, texts(spark, ["text 1"]).select("text"), "text", keep=False).count() == 101
    with pytest.raises(ValueError):
        splits.cross_pairs(rows, most=10)
    assert splits.cross_pairs(texts(spark, ["a", "b", "c"])).count() == 6 and splits.replicate(rows, 2).count() == 206


def test_injection(spark):
    base = ["Он сказал, что Москва — столица. Мини-футбол стал популярным!", "Если дождь, то «мы» останемся (дома): хлеб; соль...", "кот", ""]
    rows = texts(spark, base * 2).withColumn("p", F.explode(F.array(*(F.lit(p) for p in inject.PROFILES))))
    out = inject.inject(rows, "text", ["doc_id", "p"], "p").collect()
    assert {r.p for r in out} == set(inject.PROFILES) and len(out) == 8 * len(inject.PROFILES)
    assert all(r.error_text != r.text and r.error_labels for r in out if len(r.text) > 3) and all(r.error_text == "" for r in out if r.text == "")
    assert inject.curated(spark).count() == 22
    made = spark.range(64).select(inject.word_error(F.lit("Говорится"), F.element_at(F.array(*(F.lit(k) for k in inject.WORD_OPS)), (F.col("id") % 5 + 1).cast("int")), inject.number(F.col("id").cast("string"))).alias("x")).collect()
    assert {r.x.label.split("_")[1] for r in made} >= {"delete", "swap", "double", "extra"} and all(r.x.word[:1].isupper() for r in made)


def test_metrics(spark):
    pairs = spark.createDataFrame([("кат", "кот", "кот", "a|b"), ("кот", "кот", "кит", "a"), ("", "", "", "b")], "error_text string, correct_text string, predicted_text string, error_types string")
    rows = metrics.analysis(pairs)
    s = metrics.summary(rows).first()
    assert s.examples == 3 and s.improved_rate == pytest.approx(1 / 3, abs=1e-6) and s.clean_overcorrection_rate == 0.5 and s.unchanged_wrong_rate == 0.0
    assert {r.slice: r.examples for r in metrics.summary_slices(rows).collect()} == {"all": 3, "clean": 2, "dirty": 1}
    gained = {r.predicted_text: r.cer_delta for r in rows.collect()}
    assert gained["кот"] == pytest.approx(1 / 3) and gained["кит"] == pytest.approx(-1 / 3) and metrics.worst(rows, ["error_text"], 1).first().predicted_text == "кит"
    assert {r.error_type: r.examples for r in metrics.summary_by_label(rows, min_count=1).collect()} == {"a": 2, "b": 2}
    assert metrics.summary(rows.limit(0)).first().exact_match is None


def test_correct(spark):
    lex = lex_of(spark, {"привет": 9, "мир": 9, "сегодня": 9, "хороший": 5, "день": 5, "погода": 5, "очень": 5})
    docs = texts(spark, ["Сегодня очень хороший день, прривет мир и погода.", "", None, "Сегодня мир\n\nи прривет очень мир день", "!!!"])
    out = {r.doc_id: r for r in correct.correct(docs, lex).collect()}
    assert out[0].corrected == "Сегодня очень хороший день, привет мир и погода." and out[0].edits == 1 and out[0].accepted
    assert out[1].reason == out[2].reason == "empty" and out[4].corrected == "!!!"
    assert out[3].corrected == "Сегодня мир\n\nи привет очень мир день"


def test_diff(spark):
    rows = spark.createDataFrame([("превет мир", "привет мир"), ("а б", "а"), ("", "x y")], "a string, b string").select(diff.word_diff("a", "b").alias("d")).collect()
    assert [tuple(x) for x in rows[0].d.original] == [(2, 3, "replace")] and [tuple(x) for x in rows[1].d.original] == [(2, 3, "delete")] and [tuple(x) for x in rows[2].d.corrected] == [(0, 3, "insert")]
    lines = F.array(*(F.lit(x) for x in ("Первая стро-", "ка текста.", "Новый абзац", "идет дальше", "", "Конец")))
    assert spark.range(1).select(diff.paragraphs(lines).alias("p")).first().p == ["Первая строка текста.", "Новый абзац идет дальше", "Конец"]
    assert spark.createDataFrame([("..,", ".,")], "a string, b string").select(align.similarity("a", "b").alias("r")).first().r == difflib.SequenceMatcher(None, "..,", ".,").ratio()


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"source": "Ёж", "correction": "Еж", "domain": "d"}\n{"incorrect": "б", "correct": "в"}\n{"source": null, "sources": "x", "correct": "y"}\n[1]\n')
    (tmp_path / "b.json").write_text('[{"sources": "г", "corrections": "д"}, 3]')
    got = {(r.error_text, r.correct_text, r.source_dataset, r.source_domain) for r in io.read_pair_files(spark, {"x:train": str(tmp_path / "a.jsonl"), "y": str(tmp_path / "b.json")}).collect()}
    assert got == {("Еж", "Еж", "x:train", "d"), ("б", "в", "x:train", ""), ("г", "д", "y", "")}
    (tmp_path / "c.csv").write_text('error_text,correct_text\n"а, ""б""\nв",кот кот\n')
    (tmp_path / "d.txt").write_text("кот\n\n пес.Дом\n")
    assert io.read_csv(spark, str(tmp_path / "c.csv")).first().error_text == 'а, "б"\nв'
    assert {r.norm: r.freq for r in io.lexicon_sources(spark, [str(tmp_path / n) for n in ("c.csv", "d.txt", "none.txt")]).collect()} == {"кот": 3, "пес": 1, "дом": 1}
    assert [r.text for r in io.read_texts(spark, str(tmp_path / "d.txt")).collect()] == ["кот", "пес. Дом"]
    io.write_summary(spark.createDataFrame([(1, 0.5)], "n int, r double"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().n == 1 and io.first_source(spark, [str(tmp_path / "no"), str(tmp_path / "d.txt")]).endswith("d.txt")


def test_stream(spark, tmp_path):
    texts(spark, ["кот мяу", "пес"]).write.parquet(str(tmp_path / "in"))
    lex = lex_of(spark, {"кот": 1})
    stream = unknown_word_stream(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in")), lex)
    query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert {r.word for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"мяу", "пес"}


def test_latin_profile(spark):
    found = candidates.dictionary(spark.createDataFrame([("helo",), ("wrold",)], "norm string"), lex_of(spark, {"hello": 2, "world": 3, "wold": 1}), LATIN)
    assert {(r.norm, r.cand) for r in found.collect()} == {("helo", "hello"), ("wrold", "world"), ("wrold", "wold")}
