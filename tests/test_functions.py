"""Golden cases of the text functions, gates and guards."""

import pytest
from pyspark.sql import functions as F

from lexweave.functions import gates as G
from lexweave.functions import rules as R
from lexweave.functions import text as T
from lexweave.plans.profiles import RU, STRICTNESS


def one(spark, column, **values):
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return frame.select(column.alias("x")).first()["x"]


def many(spark, column, names, rows):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *names])
    return [r["x"] for r in frame.select("i", column.alias("x")).orderBy("i").collect()]


def test_tokens(spark):
    assert one(spark, T.tokens(F.col("t")), t="Кое-кто, 3.14 и «A»…é_x") == ["Кое-кто", ",", "3.14", "и", "«", "A", "»", "…", "x"]
    kinds = many(spark, T.token_kind(F.col("t")), ["t"], [("слово-а",), ("12:30",), ("»",), ("№",), ("…",)])
    assert kinds == ["word", "number", "punct", "other", "other"]
    assert one(spark, T.normalize_word(F.col("t")), t="ЁЛКА") == "елка"


def test_slots_and_labels(spark):
    slots = one(spark, T.word_slots(F.col("t")), t="  Он сказал: «Да», 5 раз.")
    assert [(s.word, s.gap, s.punct_after, s.is_final) for s in slots] == [("Он", " ", "", False), ("сказал", ": «", ":«", False), ("Да", "», ", "»,", False), ("5", " ", "", False), ("раз", ".", ".", True)]
    assert [(s.prev_word, s.next_word) for s in slots][:2] == [("", "сказал"), ("Он", "Да")]
    assert one(spark, T.word_slots(F.col("t")), t="!") == []
    cases = [("…", "..."), ("–", "—"), ("?!", "?"), (" ,", ","), ("[", ""), (":;", ":"), ("», ", "»,"), ("", "")]
    assert many(spark, T.canonical_label(F.col("t")), ["t"], [(a,) for a, _ in cases]) == [b for _, b in cases]


@pytest.mark.parametrize("gap,word,following,protected", [(". ", "ч", "2", True), (". ", "ст", "286", True), (".", "News", "ru", True), (".", "T", "злоумышленники", True), (":", "4", "2", True), (" ", "слово", "дело", False), (": «", "а", "б", False), ("/", "а", "б", True)])
def test_protected_gaps(spark, gap, word, following, protected):
    assert one(spark, T.protected_gap(F.col("g"), F.col("w"), F.col("n")), g=gap, w=word, n=following) is protected


def test_layout(spark):
    text = "Российская Intel — «Инел А/О» № 143."
    out = T.rebuild_layout(F.col("t"), T.word_slots(F.col("t")), F.array(*(F.lit(w) for w in ("Российская", "Intel", "Интел", "А", "О", "143"))))
    assert one(spark, out, t=text) == "Российская Intel — «Интел А/О» № 143."
    text = 'Он сказал: "Привет".'
    slots = T.word_slots(F.col("t"))
    words = F.transform(slots, lambda s: s["word"])
    out = T.rebuild_layout(F.col("t"), slots, words, F.array(F.lit(""), F.lit(":«"), F.lit("».")))
    assert one(spark, out, t=text) == "Он сказал: «Привет»."
    same = "Обвинения идут по двум статьям: ч. 2 ст. 286."
    assert one(spark, T.rebuild_layout(F.col("t"), slots, words), t=same) == same
    assert one(spark, T.rebuild(F.array(F.lit("Да"), F.lit(""), F.lit("нет")), F.array(F.lit(","), F.lit(""), F.lit("."))), t="") == "Да, нет."


def test_scalars(spark):
    assert one(spark, T.sentences(F.col("t")), t="А б. В?  Г!\nд") == ["А б. ", "В?  ", "Г!\n", "д"]
    assert one(spark, T.sentences(F.col("t")), t="") == [""] and one(spark, T.lines(F.col("t")), t="a\r\n b\n") == ["a", "", "b"]
    assert one(spark, T.raw_spacing(F.col("t")), t="Что случилось?1 марта 2024Впервые сообщили.") == "Что случилось? 1 марта 2024 Впервые сообщили."
    assert one(spark, T.raw_spacing(F.col("t")), t="Дом,который стоял.") == "Дом,который стоял."
    assert one(spark, T.normalize_spacing(F.col("t")), t=" а ,б—в .г") == "а, б — в. г"
    assert many(spark, T.case_like(F.col("c"), F.col("s")), ["c", "s"], [("кот", "КОД"), ("кот", "Код"), ("кот", "код"), ("", "К")]) == ["КОТ", "Кот", "кот", ""]
    assert one(spark, T.labels_of(F.col("t")), t="a|b, a|") == ["a", "b", "a"] and one(spark, T.labels_of(F.col("t")), t="") == ["unknown"]
    assert one(spark, T.case_signature(F.col("t")), t="Аб1") == "ULO"
    assert many(spark, T.replace_rank(F.col("t")), ["t"], [("REPLACE",), ("REPLACE_7",), ("KEEP",), ("REPLACE_x",)]) == [0, 7, None, None]
    assert one(spark, T.generated(F.col("t"), F.col("s"), marker="=>"), t="<s> in =>  out </s>", s="src") == "out" and one(spark, T.generated(F.col("t"), F.col("s")), t="<s>", s="src") == "src"


def test_pair_reasons(spark):
    rows = [("", "а", "empty"), ("а б", "а б", "identical"), ("Привет , мир.", "Привет, мир.", "spacing_only"), ("а" * 241, "б" * 241, "too_long"), ("Мама мыла раму.", "Вчера горел музей.", "heavy_rewrite"), ("!?", "?!", "no_words"), ("превет мир", "привет мир", "")]
    assert many(spark, R.pair_reason(F.col("a"), F.col("b")), ["a", "b"], [r[:2] for r in rows]) == [r[2] for r in rows]
    assert one(spark, T.external_text(F.col("t")), t=" Ёжик идёт. ") == "Ежик идет."


def test_guard(spark):
    rows = [
        ("Он пришел домой.", "Он пришел домой.", "unchanged"), ("Сайт https://a.ru тут.", "Сайт https://b.ru тут.", "protected_value_changed"), ("Он пришел (вчера) домой.", "Он пришел вчера) домой.", "structural_punctuation_changed"),
        ("Он пришел) домой.", "Он пришел домой.", "accepted"), ("Превет мир всем.", "Привет мир всем.", "accepted"), ("а, б, в, г, д, е.", "а б в г д е", "punctuation_drop"), ("кот и пес тут", "кит и лес там", "accepted"), ("аб", "аб вг деж", "length_delta"), ("а б", "а  б", "spacing_only"),
    ]
    found = many(spark, R.guard_reason(F.col("a"), F.col("b"), F.lit(0.9), F.lit(1), max_length_delta_ratio=0.5), ["a", "b"], [r[:2] for r in rows])
    assert found == [r[2] for r in rows]
    assert many(spark, R.balance_error(F.col("t")), ["t"], [("(a) [",), (")(",), ('«"»',), ("",)]) == [1, 2, 1, 0]


@pytest.mark.parametrize("word,following,reason", [("того", "чтобы", "comma_insert_fixed_phrase_guard"), ("дом", "который", ""), ("Иван", "сказал", "comma_insert_subject_predicate_guard"), ("словам", "врача", "comma_insert_source_phrase_guard"), ("дом", "на", "comma_insert_preposition_phrase_guard"), ("News", "сегодня", "comma_insert_protected_token_guard"), ("дом", "также", "comma_insert_before_takzhe_guard"), ("тем", "не", "comma_insert_fixed_phrase_guard")])
def test_comma_insert(spark, word, following, reason):
    assert one(spark, G.comma_insert_guard(F.col("w"), F.col("n")), w=word, n=following) == reason


def test_punctuation(spark):
    def decide(source, predicted, gap, word, following, final, conf, margin):
        reason = G.punctuation_reason(*(F.col(c) for c in "spgwn"), F.col("f"), F.col("c"), F.col("m"), STRICTNESS["strict"])
        return one(spark, reason, s=source, p=predicted, g=gap, w=word, n=following, f=final, c=conf, m=margin)

    assert decide(",", "", ", ", "в", "городе", False, 0.96, 0.91) == "safe_service_comma_delete_recovery"
    assert decide(",", "", ", ", "12", "марта", False, 0.87, 0.71) == "safe_date_comma_delete_recovery"
    assert decide(",", "", ", ", "дом", "который", False, 0.99999, 0.99) == "comma_delete_clause_guard"
    assert decide("", ".", "", "слово", "", True, 0.83, 0.71) == "safe_final_period_recovery"
    assert decide("", ".", " ", "слово", "дело", False, 0.99, 0.99) == "internal_sentence_end"
    assert decide("", ",", "", "слово", "", True, 0.99, 0.99) == "final_non_terminal_punctuation"
    assert decide("", ",", " ", "дом", "который", False, 0.99, 0.99) == "applied"
    assert decide(".", "", ".", "слово", "", True, 0.999, 0.99) == "final_punctuation_delete"


def test_word_gate(spark):
    base = {"source": "отеты", "text": "ответы", "cand_source": "dictionary", "score": 1.5, "distance": 1, "rank": 0, "confidence": 0.9, "margin": 0.25, "prev": "", "next": "", "known": False, "morph": False, "same_lemma": False, "protected": False, "entity": False, "left_known": False, "right_known": False}

    def reason(skip=True, **change):
        values = base | change
        row = {k: F.col(k) for k in values}
        return one(spark, G.word_reason(row, STRICTNESS["normal"], skip_context=skip, context_margin=None if skip else F.lit(0.0)), **values)

    assert reason() == "" and reason(text="отеты") == "same_as_source" and reason(entity=True) == "entity_context_guard" and reason(protected=True) == "protected_lexicon_word"
    assert reason(known=True) == "known_or_dictionary_word" and reason(source="Отеты", text="Ответы", prev="а") == "protected_word_shape" and reason(score=-0.5) == "low_dictionary_score"
    assert reason(skip=False, score=0.5) == "low_score_needs_context_margin" and reason(confidence=0.5, margin=0.05) == "low_action_confidence_or_margin" and reason(confidence=0.6, margin=0.12) == ""
    assert reason(source="сообщаетсяна", text="сообщается", left_known=True) == "dictionary_drops_glued_service_token"
    assert reason(source="президент", text="Президент", cand_source="rule") == "president_case_context_guard" and reason(source="президент", text="Президент", cand_source="rule", next="РФ") == ""
    assert reason(source="говориться", text="говорится", cand_source="orthographic", score=2.0) == "" and reason(source="тот", text="тод", score=2.0) == "too_short"
    assert reason(source="делаться", text="делатся", cand_source="rule", prev="может") == "tsya_context_guard" and reason(cand_source="other") == "unsupported_candidate_source"


def test_neighbours():
    near = RU.neighbours()
    assert near["ф"] == "йцчы" + "я" or set(near["ф"]) == {"й", "ц", "ы", "я", "ч"}
