"""Registered queries over small built tables: decision tables of the Russian profile with the outcome of each case.

A case is a row of the table; its SQL states the outcome.  `*` as an outcome stands for any reason that blocks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gates as G
from ..functions import rules as R
from ..functions import text as T
from ..operators import align, candidates, correct, decode, diff, evaluate, inject, metrics, training, windows
from . import profiles as P
from .queries import QUERIES, SQL, q


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return f"'{q(value)}'" if isinstance(value, str) else f"{value!r}::DOUBLE" if isinstance(value, float) else str(value)


def values(names: list[str], rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(names)})"


def golden(names: list[str], rows: list[tuple]):
    """Register a query whose result is `rows`."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = values(names, rows)
        return f

    return add


def built(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"case_id int, {schema}")


def lexicon(spark: SparkSession, words: dict[str, int] | str) -> DataFrame:
    """A lexicon from counts, or from a text whose words count once each."""
    found: dict[str, int] = {}
    for w, n in words.items() if isinstance(words, dict) else ((w, 1) for w in words.lower().replace("ё", "е").split()):
        found[w] = found.get(w, 0) + n
    return spark.createDataFrame([(w, n, len(w), 0, i) for i, (w, n) in enumerate(found.items())], "norm string, freq long, len int, first_doc long, first_pos int")


def outcomes(rows: list[tuple], at: int = -1) -> list[tuple]:
    return [(i, r[at]) for i, r in enumerate(rows)]


def masked(reason: Column, expected: Column) -> Column:
    """A reason, or `*` for any where only blocking is expected."""
    return F.when((expected == "*") & (reason != ""), "*").otherwise(reason)


# Word gates.  (strictness, least score, context given, source, candidate, its source, distance, score, rank, confidence, margin,
# context margin, words before and after, known words, protected words, words by morphology, lemma pair, outcome).
_GLUED = "сообщается заставляет поражения которые проекта избавиться прошлой словам ссылкой сейчас когда квадратных ездили важно"
_SAFE = "ближайшее структуры финляндии популярности оперативное официальный авиакомпаний добиваться временное"
_RISKY = "структуры финляндии официальных авиакомпаний добраться временно перевел инцидент"


def _gate(source, text, kind="dictionary", distance=1, score=2.0, rank=0, conf=0.99, margin=0.5, ctx=None, prev="", following="", known="", protected="", morph="", lemma=False, least=0.25, skip=False, want=""):
    return (least, skip, source, text, kind, distance, score, rank, conf, margin, ctx, prev, following, known, protected, morph, lemma, want)


WORD_GATES = [
    _gate("президент", "Президент", "rule", score=1.0, following="сказал", known="президент российской федерации", want="president_case_context_guard"),
    _gate("президент", "Президент", "rule", score=1.0, following="РФ", known="президент российской федерации"),
    _gate("Волов", "Волос", score=10.0, known="волос был рядом интел работает", least=1.0, want="*"),
    _gate("интеа", "интел", score=0.9, known="волос был рядом интел работает", least=1.0, want="low_dictionary_score"),
    _gate("интеа", "интел", score=10.0, known="волос был рядом интел работает", least=1.0),
    _gate("летнем", "летним", score=10.0, known="летним днем можно добиться результата", lemma=True, least=1.0, want="same_lemma_inflection"),
    _gate("добисться", "добиться", score=10.0, known="летним днем можно добиться результата", least=1.0),
    _gate("перевез", "перевел", score=10.0, known="перевел инцидент квартире", morph="перевез", least=1.0, want="known_or_dictionary_word"),
    _gate("инцедент", "инцидент", score=10.0, known="перевел инцидент квартире", least=1.0),
    *(_gate(a, b, distance=2, score=3.0, conf=0.999, known=_GLUED, skip=True, want="dictionary_drops_glued_service_token") for a, b in (
        ("сообщаетсяна", "сообщается"), ("незаставляет", "заставляет"), ("ихпоражения", "поражения"), ("которыене", "которые"), ("отпроекта", "проекта"), ("Избавитьсяот", "Избавиться"), ("Напрошлой", "Прошлой"), ("Пословам", "Словам"))),
    *(_gate(a, b, score=3.0, conf=0.999, margin=0.9, known=_GLUED, skip=True) for a, b in (("сссылкой", "ссылкой"), ("ССейчас", "Сейчас"), ("ККогда", "Когда"), ("кквадратных", "квадратных"), ("вездили", "ездили"), ("вважно", "важно"))),
    _gate("готорые", "которые", conf=0.83, margin=0.2, known="которые", least=1.0),
    _gate("готорые", "которые", conf=0.81, margin=0.2, known="которые", least=1.0, want="low_action_confidence_or_margin"),
    *(_gate(a, b, distance=n, score=s, conf=c, margin=m, known=_SAFE) for a, b, n, s, c, m in (
        ("ближуайшее", "ближайшее", 1, 3.7, 0.76, 0.54), ("струхтуры", "структуры", 1, 2.5, 0.58, 0.31), ("Финлятндии", "Финляндии", 1, 3.3, 0.64, 0.29), ("популянрости", "популярности", 2, 1.3, 0.75, 0.51), ("операттивное", "оперативное", 1, 1.3, 0.50, 0.06))),
    *(_gate(a, b, distance=n, score=s, rank=r, conf=0.60, margin=0.12, known=_RISKY, protected="финлятндии", morph="перевез", want="*") for a, b, n, s, r in (
        ("струхтуры", "структуры", 1, 1.19, 0), ("струхтуры", "структуры", 1, 2.5, 1), ("офисиальный", "официальных", 2, 0.61, 0), ("авиакмпании", "авиакомпаний", 2, -0.1, 0), ("добиаться", "добраться", 2, 2.4, 1),
        ("времемное", "временно", 2, 0.7, 0), ("СТРУХТУРЫ", "СТРУКТУРЫ", 1, 2.5, 0), ("strukh", "strukt", 1, 2.5, 0), ("Финлятндии", "Финляндии", 1, 3.3, 0), ("перевез", "перевел", 1, 3.3, 0))),
    _gate("ожет", "может", conf=0.96, margin=0.55, known="может инцидент"),
    _gate("ожет", "может", conf=0.94, margin=0.55, known="может инцидент", want="*"),
    _gate("инцедент", "инцидент", score=-1.0, conf=0.96, margin=0.55, known="может инцидент", want="low_dictionary_score"),
    _gate("инцедент", "инцидент", score=-1.0, conf=0.96, margin=0.55, ctx=0.80, known="может инцидент"),
    _gate("ДДля", "Для", "rule", margin=0.55, known="для", protected="ддля", want="protected_lexicon_word"),
    *(_gate(a, b, k, conf=0.999, margin=0.9, known="подполья судне перерыва дер гота", protected="подпоржья суднев перерва дергота", skip=True, want="protected_lexicon_word") for a, b, k in (
        ("Подпоржья", "Подполья", "dictionary"), ("Суднев", "Судне", "dictionary"), ("Перерва", "Перерыва", "dictionary"), ("дергота", "дер гота", "split"))),
    _gate("При", "Причем", "phrase", distance=0, score=100.0, following="чем", known="причем также", want="phrase_context_guard"),
    _gate("так", "также", "phrase", distance=0, score=100.0, following="же", known="причем также", want="phrase_context_guard"),
    _gate("Риз", "Рис", "rule", following="Уизерспун", known="говорится рис отразится", want="entity_context_guard"),
    _gate("отразиться", "отразится", "rule", prev="может", known="говорится рис отразится", want="tsya_context_guard"),
    _gate("говориться", "говорится", "rule", known="говорится рис отразится"),
    _gate("дом", "дом", want="same_as_source"), _gate("слово", "слова", "original", want="same_as_source"), _gate("слово", "слива", "oracle", want="unsupported_candidate_source"),
    _gate("словоо", "слово", distance=3, known="слово", want="bad_dictionary_distance"), _gate("слово", "слива", known="слово", want="known_or_dictionary_word"), _gate("сло", "слово", conf=0.9, margin=0.2, want="too_short"),
    _gate("город", "гором", prev="в", following="Б", conf=0.83, margin=0.2, score=0.9, want="low_dictionary_confidence"), _gate("тотже", "тот же", "split", distance=0, known="тот же"), _gate("ТОТЖЕ", "ТОТ ЖЕ", "split", distance=0, known="тот же", want="protected_word_shape"),
    _gate("слуво", "слово", score=0.5, known="слово", want="low_score_needs_context_margin"), _gate("слуво", "слово", score=0.5, ctx=0.6, known="слово"), _gate("Маскве", "Москве", prev="городе", known="москве", conf=0.999, want="entity_context_guard"),
    _gate("вуз", "ВУЗ", "rule", conf=0.85, want="low_rule_confidence_or_shape"), _gate("Newsru", "News ru", "split", want="protected_word_shape"),
]


@golden(["case_id", "reason"], outcomes(WORD_GATES))
def ru_word_gates(spark, d):
    """P13 to P26, P32 (strict): the reason why a candidate may not replace its source."""
    rows = built(spark, "least double, skip boolean, source string, text string, cand_source string, distance int, score double, rank int, confidence double, margin double, ctx double, prev string, next string, known string, protected string, morph string, same_lemma boolean, want string", WORD_GATES)
    norm = T.normalize_word(F.col("source"))
    among = lambda c, w: F.array_contains(F.split(c, " "), w)
    left, right = G.glued_parts(norm, T.normalize_word(F.col("text")))
    freq = F.when(among("protected", norm), 1).otherwise(0)
    row = {k: F.col(k) for k in ("source", "text", "cand_source", "distance", "score", "rank", "confidence", "margin", "prev", "next", "same_lemma")}
    row |= {"known": among("known", norm), "morph": among("morph", norm), "protected": G.protected_source(F.col("source"), freq), "entity": G.entity_context(F.col("source"), F.col("prev"), F.col("next"))}
    row |= {"left_known": F.coalesce(among("known", left), F.lit(False)), "right_known": F.coalesce(among("known", right), F.lit(False))}
    strict = P.STRICTNESS["strict"]
    parts = []
    for least, skip, given in sorted({(r[0], r[1], r[10] is not None) for r in WORD_GATES}):
        one = G.word_reason(row, strict, skip, least, F.col("ctx") if given else None)
        mine = rows.filter((F.col("least") == least) & (F.col("skip") == skip) & (F.col("ctx").isNotNull() == given))
        parts.append(mine.select("case_id", masked(one, F.col("want")).alias("reason")))
    return reduce(DataFrame.unionByName, parts)


# Punctuation gates.  (mark, predicted, gap, word, next word, final, confidence, margin, protected gap, applied, reason).
def _mark(source, predicted, gap, word, following, final=False, conf=0.999, margin=0.9, protected=False, applied=False, want="*"):
    return (source, predicted, gap, word, following, final, conf, margin, protected, applied, "applied" if applied and want == "*" else want)


_FIXED = "comma_insert_fixed_phrase_guard"
PUNCT_GATES = [
    _mark(".", "", ".", "", "", True, want="final_punctuation_delete"), _mark(",", "", ", ", "", "Intel"), _mark("", ",", " ", "", "что", applied=True),
    _mark(",", "", ", ", "", "который", conf=1.0, margin=1.0, want="comma_delete_clause_guard"), _mark(",", "", ", ", "", "представленный", conf=1.0, margin=1.0, want="comma_delete_participle_guard"),
    _mark(",", "", ", ", "Брянской", "Орловской", conf=1.0, margin=1.0, want="comma_delete_titlecase_list_guard"), _mark(",", "", ", ", "", "пожалуй", conf=1.0, margin=1.0, want="comma_delete_introductory_guard"),
    _mark("", ".", " ", "", "Wrigley", want="internal_sentence_end"), _mark(".", ",", ". ", "", "что", applied=True), _mark(".", ",", ".", "", "", True, want="final_non_terminal_punctuation"), _mark("", ".", "", "", "", True, applied=True),
    *(_mark(",", "", ", ", a, b, conf=0.99, margin=0.96, applied=True, want="safe_comma_delete_recovery") for a, b in (("на", "мирных"), ("в", "эксплуатацию"), ("до", "приезда"), ("от", "стоимости"), ("по", "фамилии"), ("без", "претензии"))),
    *(_mark(",", "", ", ", a, b, conf=0.95, margin=0.9, applied=True, want="safe_service_comma_delete_recovery") for a, b in (("в", "начале"), ("на", "место"), ("с", "октября"), ("о", "проверке"), ("за", "решение"))),
    *(_mark(",", "", ", ", a, b, conf=0.86, margin=0.7, applied=True, want="safe_date_comma_delete_recovery") for a, b in (("11", "января"), ("27", "марта"), ("1", "мая"))),
    *(_mark(",", "", ", ", a, b, f, c, m, b == "Intel") for a, b, f, c, m in (
        ("на", "который", False, 0.99, 0.96), ("на", "что", False, 0.99, 0.96), ("на", "пожалуй", False, 0.99, 0.96), ("на", "представленный", False, 0.99, 0.96), ("Брянской", "Орловской", False, 0.99, 0.96), ("на", "Intel", False, 0.99, 0.96),
        ("в", "2008", False, 0.99, 0.96), ("О", "война", False, 0.99, 0.96), ("на", "мирных", True, 0.99, 0.96), ("на", "мирных", False, 0.949, 0.96), ("на", "мирных", False, 0.99, 0.899), ("4", "и", False, 0.99, 0.96),
        ("32", "января", False, 0.99, 0.96), ("11", "января", False, 0.859, 0.75), ("11", "января", False, 0.9, 0.699))),
    _mark("", ".", "", "текст", "", True, 0.82, 0.7, applied=True, want="safe_final_period_recovery"), _mark(",", ".", ",", "текст", "", True, 0.82, 0.7, applied=True, want="safe_final_period_recovery"),
    *(_mark(a, b, g, w, n, f, c, m, p) for a, b, g, w, n, f, c, m, p in (
        ("", ".", " ", "текст", "дальше", False, 0.9, 0.8, False), ("", ".", "", "Elec", "", True, 0.9, 0.8, True), ("", "!", "", "текст", "", True, 0.9, 0.8, False), (":", ".", ":", "текст", "", True, 0.9, 0.8, False),
        ("", ".", "", "текст", "", True, 0.819, 0.75, False), ("", ".", "", "текст", "", True, 0.9, 0.699, False), (",", ".", ",", "текст", "", True, 0.819, 0.75, False), (",", ".", ",", "текст", "", True, 0.9, 0.699, False))),
    *(_mark("", ",", " ", a, b) for a, b in (
        ("актуален", "другой"), ("словам", "мужчины"), ("информации", "источника"), ("того", "или"), ("того", "чтобы"), ("того", "самого"), ("тому", "времени"), ("конечно", "же"), ("заявил", "сегодня"), ("добавил", "он"), ("напомнил", "ей"), ("напомнил", "об"),
        ("рассказал", "женам"), ("спросила", "у"), ("договорились", "о"), ("холодных", "стран"), ("баллистических", "ракет"), ("подписных", "листов"), ("эффективное", "средство"), ("утверждают", "производители"), ("утверждалось", "о"), ("башни", "не"),
        ("почерковеды", "работали"), ("очередь", "министр"), ("Ответьте", "же"), ("апрель", "2008"), ("Oxu", "az"), ("традицию", "предавать"), ("Семенова", "выразила"), ("Ласточкин", "добавил"), ("ответьте", "мне"), ("контекст", "достаточно"), ("средство", "освоения"))),
    _mark("", ",", " ", "того", "стоит", want=_FIXED), *(_mark("", ",", " ", w, "что", applied=True) for w in ("сообщил", "сообщалось", "заявил", "также")),
    _mark(";", ":", "; ", "контрабас", "Андрей", want="structural_punctuation_swap_guard"), _mark(":", ";", ": ", "народы", "Как", want="structural_punctuation_swap_guard"), _mark("", ",", " ", "слепок", "с", want="comma_insert_preposition_phrase_guard"),
    _mark("", ",", " ", "эксперта", "на", want="comma_insert_preposition_phrase_guard"), _mark("", ",", " ", "Известно", "также", want="comma_insert_before_takzhe_guard"), _mark("", ",", " ", "сообщалось", "о", want="comma_insert_after_reporting_verb_guard"),
    _mark("", ",", " ", "сообщалось", "ранее", want="comma_insert_after_reporting_verb_guard"), _mark(".", ",", ". ", "", "2", want="structural_gap"), _mark(",", ",", ", ", "да", "нет", want="same_as_source"), _mark("", "%", " ", "да", "нет", want="unsupported_punctuation"),
]


@golden(["case_id", "applied", "reason"], [(i, r[-2], r[-1]) for i, r in enumerate(PUNCT_GATES)])
def ru_punctuation_gates(spark, d):
    """Whether a predicted mark is applied, and why."""
    rows = built(spark, "source string, predicted string, gap string, word string, next string, final boolean, conf double, margin double, protected boolean, applied boolean, want string", PUNCT_GATES)
    c = F.col
    reason = G.punctuation_reason(c("source"), c("predicted"), c("gap"), c("word"), c("next"), c("final"), c("conf"), c("margin"), P.STRICTNESS["strict"], c("protected"))
    applied = G.punctuation_applies(reason)
    return rows.select("case_id", applied.alias("applied"), F.when(c("want") == "*", F.when(applied, reason).otherwise("*")).otherwise(reason).alias("reason"))


# Guard cases (original, corrected, confidence, edits, outcome).
_PAREN = "structural_punctuation_changed"
GUARD = [
    ("Intel — «Интел А/О» № 143.", "Intel Интел А О 143.", 0.99, 4, "*"),
    ('Его итогом стал концертный альбом "Burning Japan Live" (1994).', 'Его итогом стал концертный альбом "Burning Japan Live" (1994.', 0.99, 1, _PAREN),
    ("Об этом сообщает региональное управление Федеральной службы судебных приставов (ФССП).", "Об этом сообщает региональное управление Федеральной службы судебных приставов (ФССП.", 0.99, 1, _PAREN),
    ("По факту возбуждено уголовное дело по статье 213 (хулиганство) УК РФ.", "По факту возбуждено уголовное дело по статье 213 хулиганство) УК РФ.", 0.99, 1, _PAREN),
    ("Похищенные из храма иконы (более 20) и ценности у них изъяты.", "Похищенные из храма иконы (более 20 и ценности у них изъяты.", 0.99, 1, _PAREN),
    ("Он пришел) домой.", "Он пришел домой.", 0.99, 1, "accepted"), ("Он сказал: «пример».", "Он сказал: пример.", 0.99, 1, _PAREN),
    ("Этот вуз открыл лабораторию.", "Этот ВУЗ открыл лабораторию.", 0.99, 1, "accepted"), ("Дом стоит.", "Дом стоит.", 0.99, 0, "unchanged"), ("  ", "а", 0.1, 0, "unchanged"), ("Дом стоит.", "Дом стоял.", 0.3, 1, "low_confidence"),
    ("В 2008 году.", "В 2009 году.", 0.99, 1, "protected_value_changed"), ("Мама мыла раму", "Мама мыла раму и пол", 0.99, 1, "length_delta"), ("Привет , мир.", "Привет, мир.", 0.99, 1, "spacing_only"), ("кот сидит дома", "код сытят рома", 0.99, 1, "too_many_changes"),
    ("Мама мыла раму", "Мама мыло раму", 0.99, 0, "no_edits"), ("Мама мыла раму", "Мама мыло раму", 0.99, 1, "accepted"), ("а, б, в, г, д.", "а б в г д", 0.99, 1, "punctuation_drop"),
]


@golden(["case_id", "reason", "accepted"], [(i, r[-1], r[-1] in ("accepted", "unchanged", "spacing_only", "no_edits")) for i, r in enumerate(GUARD)])
def ru_guard(spark, d):
    """What the quality guard says of a correction."""
    rows = built(spark, "original string, corrected string, confidence double, edits int, want string", GUARD)
    only = lambda c: T.only(F.col(c), P.SIMPLE_PUNCT)
    rows = rows.withColumn("ratio", align.similarity(only("original"), only("corrected")))
    reason = R.guard_reason(F.col("original"), F.col("corrected"), F.col("confidence"), F.col("edits"), F.col("ratio"))
    rows = rows.withColumn("reason", reason)
    return rows.select("case_id", masked(F.col("reason"), F.col("want")).alias("reason"), R.guard_accepts(F.col("reason")).alias("accepted"))


# Pairs with the reason that drops them, their labels and kinds.
PAIRS = [
    ("Это давольно важно.", "Это довольно важно.", "", "REPLACE_0 at 1", "real_spelling"), ("Я думаю что это важно.", "Я думаю, что это важно.", "", "", "real_punctuation"), ("Привет , мир.", "Привет, мир.", "spacing_only", "", "real_other"),
    ("", "Текст.", "empty", None, "real_spelling"), ("Текст.", "Текст.", "identical", "", "real_other"), ("а" * 241, "а" * 240, "too_long", "REPLACE_0 at 0", "real_spelling"), ("Мама мыла раму.", "Вчера горел музей.", "heavy_rewrite", "REPLACE_0 at 0, REPLACE_0 at 1, REPLACE_0 at 2", "real_spelling"),
    ("москва стала центром.", "Москва стала центром.", "", "REPLACE_0 at 0", "real_spelling"), ("Мы сделали по новому.", "Мы сделали по-новому.", "", "REPLACE_0 at 2, DELETE at 3", "real_spelling|real_punctuation"), ("Мини футбол популярен.", "Мини-футбол популярен.", "", "REPLACE_0 at 0, DELETE at 1", "real_spelling"),
    ("Железно-дорожный вокзал открыт.", "Железнодорожный вокзал открыт.", "", "REPLACE_0 at 0", "real_spelling"), ("...", "Да.", "no_words", None, "real_spelling"), ("а б", "а б в г д е", "large_token_count_shift", None, "real_spelling"), ("Он идет домой", "Он идет к домой", "not_edit_compatible", None, "real_spelling"),
    ("вобщем да", "в общем да", "spacing_only", "REPLACE_0 at 0", "real_spelling"),
]


@golden(["case_id", "reason", "changes", "kinds"], [(i, *r[2:]) for i, r in enumerate(PAIRS)])
def ru_pairs(spark, d):
    """Why a pair is dropped, its edit labels other than KEEP, and its kinds of errors."""
    rows = align.edit_labels(built(spark, "error_text string, correct_text string, reason string, changes string, kinds string", PAIRS))
    reason = R.pair_reason(F.col("error_text"), F.col("correct_text"), compatible=F.col("example").isNotNull())
    labels = F.filter(F.transform("example", lambda e, i: F.when(e["action"] != "KEEP", F.concat_ws(" ", e["action"], F.lit("at"), i.cast("string")))), lambda x: x.isNotNull())
    kinds = align.error_types(F.col("example"), F.col("error_text"), F.col("correct_text"))
    return rows.select("case_id", reason.alias("reason"), F.array_join(labels, ", ").alias("changes"), F.array_join(kinds, "|").alias("kinds"))


EDITS = [
    ("Превет мир", "Привет мир", "spell word|0|привет"), ("Дом стоит", "Дом, стоит", "punct gap|0|,"), ("москва стоит", "Москва стоит", "case word|0|Москва"), ("по новому делу", "по-новому делу", "punct replace_span|0|2|, spell replace_span|0|2|по-новому"), ("а б в", "а в", "spell delete_span|1|2"),
    ("а в", "а б в", "spell insert_at|1|б"), ("да, нет", "да нет", "punct gap|0|"), ("кот", "кот", ""),
]


@golden(["case_id", "edits"], outcomes(EDITS))
def ru_edit_keys(spark, d):
    """Spelling, punctuation and case edits of a pair."""
    rows = built(spark, "a string, b string, want string", EDITS)
    found = align.edit_keys(rows, "a", "b", ["case_id"]).groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "metric", "edit_key"))), ", ").alias("edits"))
    return rows.select("case_id").join(found, "case_id", "left").select("case_id", F.coalesce("edits", F.lit("")).alias("edits"))


BENCH = [("d1", "Превет мир", "Привет мир", "Привет мир"), ("d1", "кот сидит", "кот, сидит", "кот сидит"), ("d1", "москва тут", "Москва тут", "МОСКВА тут"), ("d2", "он тут", "он тут", "она тут")]
BENCH_ROWS = [("d1", "case", 0, 1, 1, 1, 0.0, 0.0, 0.0), ("d1", "punct", 0, 0, 1, 1, 0.0, 0.0, 0.0), ("d1", "spell", 1, 0, 0, 1, 1.0, 1.0, 1.0), ("d2", "spell", 0, 1, 0, 0, 0.0, 0.0, 0.0)]


@golden(["dataset", "metric", "tp", "fp", "fn", "support", "precision", "recall", "f1"], BENCH_ROWS)
def ru_benchmark(spark, d):
    """Counts, precision, recall and F1 of each kind of edit, by data set."""
    rows = built(spark, "dataset string, error_text string, correct_text string, predicted_text string", BENCH)
    keys = ["dataset", "case_id"]
    gold, made = align.edit_keys(rows, "error_text", "correct_text", keys), align.edit_keys(rows, "error_text", "predicted_text", keys)
    return metrics.precision_recall(metrics.edit_overlap(gold, made, keys), ["dataset", "metric"])


RATIOS = [("..,", ".,", 0.8), ("", "", 1.0), (",.!", ",.!", 1.0), (",,,", "...", 0.0), (".", "", 0.0), ("?!", "!?", 0.5)]


@golden(["case_id", "ratio"], outcomes(RATIOS))
def ru_similarity(spark, d):
    """The similarity ratio of two strings of marks."""
    return built(spark, "a string, b string, want double", RATIOS).select("case_id", F.round(align.similarity("a", "b"), 9).alias("ratio"))


SPANS = [("превет мир", "привет мир", "2-3", "2-3"), ("а б", "а", "2-3", ""), ("", "x y", "", "0-3"), ("кот и пес", "кот и пес", "", ""), ("кот пил", "кит пел", "1-2 5-6", "1-2 5-6")]


@golden(["case_id", "errors", "corrections"], [(i, r[2], r[3]) for i, r in enumerate(SPANS)])
def ru_word_diff(spark, d):
    """H1, H2: spans that differ, merged."""
    shown = lambda c: F.array_join(F.transform(windows.merge_spans(c), lambda s: F.concat_ws("-", s["s"].cast("string"), s["e"].cast("string"))), " ")
    rows = built(spark, "a string, b string, e string, c string", SPANS).withColumn("x", diff.word_diff("a", "b"))
    return rows.select("case_id", shown(F.col("x.original")).alias("errors"), shown(F.col("x.corrected")).alias("corrections"))


PARAGRAPHS = [("Первая стро-|ка текста.|Новый абзац|идет дальше||Конец", "Первая строка текста.|Новый абзац идет дальше|Конец"), ("одна строка", "одна строка"), ("Начало.|продолжение", "Начало. продолжение"), ("||", "")]


@golden(["case_id", "paragraphs"], outcomes(PARAGRAPHS))
def ru_paragraphs(spark, d):
    """H3: lines of a document joined to paragraphs."""
    return built(spark, "lines string, want string", PARAGRAPHS).select("case_id", F.array_join(diff.paragraphs(F.split("lines", r"\|", -1)), "|").alias("paragraphs"))


# Texts with what each function makes of them.
TEXTS = [
    ("raw", "Что случилось?1 марта 2024Впервые сообщили.", "Что случилось? 1 марта 2024 Впервые сообщили."), ("raw", "Дом,который стоит у дороги.", "Дом,который стоит у дороги."), ("raw", "Конец.Начало", "Конец. Начало"),
    ("external", " Ёжик идёт. ", "Ежик идет."), ("spacing", "Он  пришел ,потом ушел—да", "Он пришел, потом ушел — да"), ("values", "Сайт www.a.ru и почта a@b.ru, 12.5 кг, США и Intel", "www.a.ru a@b.ru 12.5 США Intel"), ("values", "нет ничего", ""),
    ("case", "Москва и США", "ULLLLLOLOUUU"), ("prompt", "текст", "Исправь: текст!"), ("generated", "<pad> Исправлено: Да  нет.</s>", "Да нет."), ("generated", "<pad></s>", "исходный"),
]


@golden(["case_id", "result"], outcomes(TEXTS))
def ru_texts(spark, d):
    """Text functions on Russian text."""
    t = F.col("text")
    made = {
        "raw": T.raw_spacing(t), "external": T.external_text(t), "spacing": T.normalize_spacing(t), "values": F.array_join(T.protected_values(t), " "), "case": T.case_signature(t), "prompt": T.prompt(t, "Исправь: {text}!"),
        "generated": T.generated(t, F.lit("исходный"), marker="Исправлено:"),
    }
    chain = F.lit(None).cast("string")
    for kind, column in made.items():
        chain = F.when(F.col("kind") == kind, column).otherwise(chain)
    return built(spark, "kind string, text string, want string", TEXTS).select("case_id", chain.alias("result"))


# Gaps between two words.
GAPS = [(". ", "ч", "2", True), (". ", "ст", "286", True), (".", "News", "ru", True), (".", "T", "злоумышленники", True), (":", "4", "2", True), (", ", "да", "нет", False), (" ", "2", "3", True), (" ", "да", "3", False), (" — ", "да", "нет", False), (" [", "да", "нет", True), ("", "да", "нет", False), (". ", "конец", "Начало", False)]


@golden(["case_id", "protected"], outcomes(GAPS))
def ru_gaps(spark, d):
    """Gaps that must be kept byte for byte."""
    return built(spark, "gap string, word string, next string, want boolean", GAPS).select("case_id", T.protected_gap(F.col("gap"), F.col("word"), F.col("next")).alias("protected"))


# Texts with words and marks to change.
LAYOUT = [
    ("Российская Intel — «Инел А/О» № 143.", "Инел=Интел", "", "Российская Intel — «Интел А/О» № 143."), ("Обвинения идут по двум статьям: ч. 2 ст. 286.", "", "", "Обвинения идут по двум статьям: ч. 2 ст. 286."),
    ('Он сказал: "Привет".', "", ':"=:«;".=».', "Он сказал: «Привет»."), ("Он сказал да", "", "сказал=,", "Он сказал, да"), ("Привет мир", "", "мир=.", "Привет мир."),
]


@golden(["case_id", "rebuilt"], outcomes(LAYOUT))
def ru_layout(spark, d):
    """Texts rebuilt with words or marks changed and every other byte kept."""
    rows = built(spark, "text string, words string, marks string, want string", LAYOUT)
    slots = T.word_slots(F.col("text"))
    pairs = lambda c, sep: F.filter(F.transform(F.split(c, sep), lambda x: F.split(x, "=", 2)), lambda x: F.size(x) == 2)
    swap = lambda value, table: F.coalesce(F.get(F.filter(table, lambda p: F.get(p, F.lit(0)) == value), F.lit(0)), F.array(value, value))
    words = F.transform(slots, lambda s: F.get(swap(s["word"], pairs("words", ",")), F.lit(1)))
    own = F.transform(slots, lambda s: T.gap_label(s["gap"], s["punct_after"], s["word"], s["next_word"]))

    def label(s: Column, mark: Column) -> Column:
        by_word = F.get(F.filter(pairs("marks", ";"), lambda p: F.get(p, F.lit(0)) == s["word"]), F.lit(0))
        return F.coalesce(F.get(by_word, F.lit(1)), F.get(swap(mark, pairs("marks", ";")), F.lit(1)))

    return rows.select("case_id", T.rebuild_layout(F.col("text"), slots, words, F.zip_with(slots, own, label), own).alias("rebuilt"))


# The words of the candidate cases, and the cases (word, candidate, its source; `-` for one that must not be made).
LEXICON = (
    "москва стала центром президент российской федерации подписал указ этот вуз открыл лабораторию мягкий поролон лежал рядом нужно кардинально изменить подход железнодорожный вокзал открыт рассказать познавательно утренняя зарядка помогает в общем это работает "
    "как будто все спокойно почему-то он пришел сейчас важный момент винные сорта бывают иные варианты довольно интересно тот же из них к ним с крупные европейские машину частями говорить ся мат часть супер ячейки трехсот летней бюджета сказать об зданий от женщин "
    "что быть есть дело лет уже для интел"
)
CANDIDATES = [
    ("москва", "Москва", "rule"), ("президент", "Президент", "rule"), ("вуз", "ВУЗ", "rule"), ("паралон", "поролон", "rule"), ("координально", "кардинально", "rule"), ("железно-дорожный", "железнодорожный", "rule"), ("расказать", "рассказать", "rule"), ("позновательно", "познавательно", "orthographic"),
    ("зарадка", "зарядка", None), ("вобщем", "в общем", "phrase_safe"), ("какбудто", "как будто", "phrase_safe"), ("почемуто", "почему-то", "phrase_safe"), ("ссейчас", "сейчас", None), ("ссейчас", "с сейчас", "-"), ("виные", "в иные", "-"), ("тотже", "тот же", "split"), ("изних", "из них", "split"), ("вних", "в них", "split"),
    ("кним", "к ним", "split"), ("сним", "с ним", "split"), ("крупныеевропейские", "крупные европейские", "split"), ("избюджета", "из бюджета", "split"), ("сказатьоб", "сказать об", "split"), ("зданийот", "зданий от", "split"), ("изженщин", "из женщин", "split"), ("матчасть", "мат часть", "-"), ("суперячейки", "супер ячейки", "-"),
    ("трехсотлетней", "трехсот летней", "-"), ("говориться", "говорить ся", "-"), ("Newsru", "News ru", "-"), ("фсе", "все", "rule"), ("щто", "что", "rule"), ("што", "что", "rule"), ("ыть", "быть", "rule"), ("эсть", "есть", "rule"), ("чтто", "что", "rule"), ("ччто", "что", "rule"), ("дэло", "дело", "rule"), ("ллет", "лет", "rule"),
    ("ууже", "уже", "rule"), ("ДДля", "Для", "rule"), ("ККак", "Как", "rule"), ("давольно", "довольно", "mined"), ("Инел", "Интел", "dictionary"), ("гель", "дело", "-"),
]


@golden(["case_id", "found", "source"], [(i, r[2] != "-", r[2] if r[2] != "-" else None) for i, r in enumerate(CANDIDATES)])
def ru_candidates(spark, d):
    """Candidates that words must and must not have, with the source of those that one stage alone makes."""
    rows = built(spark, "word string, text string, source string", CANDIDATES)
    mined = spark.createDataFrame([("давольно", "довольно", 2, 1)], "source string, target string, count long, place int")
    made = candidates.candidates(rows.select("word").distinct(), lexicon(spark, LEXICON), P.RU, 16, split=True, mined=mined)
    got = made.select("word", "text", F.col("source").alias("by"))
    rows = rows.join(got, ["word", "text"], "left")
    return rows.select("case_id", F.col("by").isNotNull().alias("found"), F.when(F.col("source").isNotNull(), F.col("by")).alias("source"))


BLOCKED = [("ссейчас", 1), ("виные", 1), ("вних", 0), ("водах", 2), ("говориться", 0)]


@golden(["word", "blocked"], BLOCKED)
def ru_blocked_splits(spark, d):
    """How many ways to split a word are refused as unsafe."""
    words = spark.createDataFrame([(w,) for w, _ in BLOCKED], "norm string")
    found = candidates.blocked_splits(words, lexicon(spark, LEXICON), P.RU)
    return words.join(found, "norm", "left").select(F.col("norm").alias("word"), F.coalesce("blocked", F.lit(0)).cast("int").alias("blocked"))


CONFUSIONS = [("он давольно", "он довольно")] * 3 + [("я прешел", "я пришел")] * 2 + [("мы кот", "мы пес"), ("вобщем да", "в общем да"), ("вобщем нет", "в общем нет")]


@golden(["source", "target", "n", "place"], [("давольно", "довольно", 3, 1), ("вобщем", "в общем", 2, 1), ("прешел", "пришел", 2, 1)])
def ru_mined_confusions(spark, d):
    """Confusions mined from pairs; phrases only where they are listed."""
    rows = built(spark, "error_text string, correct_text string", CONFUSIONS)
    found = align.mined_confusions(rows, lexicon(spark, "довольно пес в общем пришел"), 2, 1, P.RU.phrase)
    return found.select("source", "target", F.col("count").cast("int").alias("n"), "place")


# Pairs whose targets have a rank.
TOPK = [("отеты были красными.", "одеты были красными."), ("превет мир.", "превед мир."), ("чисто тут.", "чисто тут."), ("Интереснейшеи дни", "Интереснейшее дни")]
TOPK_ROWS = [
    (0, 0, "ответы одеты", "REPLACE_1", 1, True, False), (0, 1, "были", "KEEP", -1, False, False), (0, 2, "красными", "KEEP", -1, False, False), (1, 0, "превед", "REPLACE_0", 0, False, True), (1, 1, "мир", "KEEP", -1, False, False), (2, 0, "чисто", "KEEP", -1, False, False),
    (2, 1, "тут", "KEEP", -1, False, False), (3, 0, "Интереснейшее", "REPLACE_0", 0, True, False), (3, 1, "дни", "KEEP", -1, False, False),
]


@golden(["case_id", "pos", "candidates", "action", "rank", "hit", "injected"], TOPK_ROWS)
def ru_top_candidates(spark, d):
    """A3, A4: tokens with their ranked candidates, labels by the target's rank, and targets that generation missed."""
    examples = align.edit_labels(built(spark, "error_text string, correct_text string", TOPK))
    lex = lexicon(spark, {"одеты": 2, "были": 10, "красными": 2, "ответы": 8, "неправильными": 8, "мир": 1, "чисто": 1, "тут": 1, "дни": 1})
    out = training.top_candidates(examples, lex, "case_id", P.RU, 8)
    return out.select("case_id", "pos", F.array_join("candidates", " ").alias("candidates"), "action", "rank", "hit", "injected")


@golden(["tokens", "replaced", "hits", "injected", "coverage"], [(9, 3, 2, 1, 0.666667)])
def ru_candidate_statistics(spark, d):
    """Counts over the same tokens."""
    examples = align.edit_labels(built(spark, "error_text string, correct_text string", TOPK))
    lex = lexicon(spark, {"одеты": 2, "были": 10, "красными": 2, "ответы": 8, "неправильными": 8, "мир": 1, "чисто": 1, "тут": 1, "дни": 1})
    return training.candidate_statistics(training.top_candidates(examples, lex, "case_id", P.RU, 8)).select("tokens", "replaced", "hits", "injected", F.round("coverage", 6).alias("coverage"))


@golden(["case_id", "pos", "candidates", "action", "added"], [(0, 0, "летним летнем", "KEEP", True), (0, 1, "вечером", "KEEP", False), (0, 2, "было", "KEEP", False), (0, 3, "тихо", "KEEP", False), (1, 0, "летнем", "REPLACE_0", False)])
def ru_keep_candidates(spark, d):
    """A kept word gets its hardest negative before its candidates, and keeps its label."""
    examples = align.edit_labels(built(spark, "error_text string, correct_text string", [("летнем вечером было тихо.", "летнем вечером было тихо."), ("летнам", "летнем")]))
    out = training.keep_candidates(examples, lexicon(spark, "летним вечером было тихо"), "case_id", P.RU, 1.0, 1.0, 1)
    return out.select("case_id", "pos", F.array_join("candidates", " ").alias("candidates"), "action", "added")


# Words that may get a hard negative.
ELIGIBLE = [("слово", True, True), ("кот", False, False), ("Слово", False, False), ("слово1", False, False), ("worda", False, False), ("делла", True, False), ("перевез", True, False), ("какой-то", True, True), ("ёлочка", True, True)]


@golden(["case_id", "eligible", "noise"], [(i, r[1], r[2]) for i, r in enumerate(ELIGIBLE)])
def ru_eligible(spark, d):
    """Words that may get a hard negative, and those of them that may be noise in clean text."""
    rows = built(spark, "word string, e boolean, n boolean", ELIGIBLE)
    return rows.select("case_id", training.eligible(F.col("word")).alias("eligible"), training.clean_noise(F.col("word"), F.col("word") == "перевез").alias("noise"))


# Clean texts, one of them with a typo.
NOISE = [("Это чистый текст.",), ("Тут готорые люди.",), ("Летнем днем хорошо.",), ("Люди которые пришли.",), (None,)]


@golden(["correct_text", "kept"], [("Это чистый текст.", True), ("Тут готорые люди.", False), ("Летнем днем хорошо.", True), ("Люди которые пришли.", True), (None, True)])
def ru_noise(spark, d):
    """Rows whose clean text holds a likely typo go; another form of the same word is none."""
    rows = built(spark, "correct_text string", NOISE)
    lex = lexicon(spark, {"которые": 20, "чистый": 20, "текст": 20, "люди": 20, "летним": 20, "днем": 20, "хорошо": 20, "пришли": 20})
    lemma = spark.createDataFrame([("летнем", "летним")], "a string, b string")
    kept, _ = training.without_noise(rows, lex, same_lemma=lemma)
    return rows.join(kept.select("case_id", F.lit(True).alias("kept")), "case_id", "left").select("correct_text", F.coalesce("kept", F.lit(False)).alias("kept"))


# Reranking.  (source, candidates, chosen rank, their source, scores, confidence, protected word, text, reason).
RERANK = [
    ("кубца", "кубка;купца", 0, "dictionary", (-4.0, -3.0, -1.0), 0.99, "", "купца", "context_changed_top1"), ("матчасть", "мат часть", 0, "split", (-1.0, -3.0), 0.99, "", None, "context_prefers_source"),
    ("тотже", "тот же", 0, "split", (float("-inf"), float("-inf")), 0.99, "", None, "split_context_non_finite"), ("готорые", "которые", 0, "dictionary", (-1.0, -1.4), 0.99, "", "которые", "context_source_veto_relaxed"),
    ("дергота", "дерготе", 0, "dictionary", (-1.0, -1.4), 0.99, "дергота", None, "context_prefers_source"), ("тотже", "тот же", 0, "split", None, 0.99, "", None, "split_context_disabled"), ("готорые", "которые", 0, "dictionary", None, 0.99, "", "которые", "not_called"),
    ("кубца", "купца", 0, "dictionary", (-1.1, -1.0), 0.99, "", "купца", "context_low_margin"), ("тотже", "тот же", 0, "split", (-1.1, -1.0), 0.99, "", None, "split_context_low_margin"), ("кубца", "купца", 0, "dictionary", (-3.0, -1.0), 0.99, "", "купца", "context_confirmed"),
]


@golden(["case_id", "text", "reason"], [(i, r[-2], r[-1]) for i, r in enumerate(RERANK)])
def ru_rerank(spark, d):
    """What a context reranker makes of a candidate that passed the first check."""
    rows = built(spark, "source string, cands string, rank int, kind string, scores array<double>, confidence double, protected string, text string, reason string", [(*r[:4], None if r[4] is None else [float(x) for x in r[4]], *r[5:]) for r in RERANK])
    texts = F.split("cands", ";")
    none = F.lit("")
    judged = F.transform(texts, lambda t, i: F.struct(i.alias("rank"), t.alias("text"), F.col("kind").alias("cand_source"), F.lit(1).alias("distance"), F.lit(3.0).alias("score"), none.alias("first"), none.alias("second"), none.alias("plain")))
    said = F.transform(F.arrays_zip(F.concat(F.array("source"), texts).alias("t"), F.col("scores").alias("s")), lambda x, i: F.struct(i.alias("place"), x["t"].alias("text"), x["s"].alias("score"), F.lit(True).alias("available"), F.lit("ok").alias("reason")))
    rows = rows.withColumns({"judged": judged, "_s": F.when(F.col("scores").isNotNull(), said)})
    scores = rows.filter("_s is not null").select("case_id", F.lit(0).alias("slot"), F.explode("_s").alias("x")).select("case_id", "slot", "x.*")
    ctx = decode.context_of(scores, ["case_id"]).withColumnRenamed("scores", "said")
    rows = rows.join(ctx, "case_id", "left")
    free = F.col("protected") != F.col("source")
    out = decode.outcome(F.get("judged", F.col("rank")), F.col("judged"), F.col("said"), F.col("ranked"), F.coalesce("context_margin", F.lit(0.0)), F.col("source"), T.normalize_word(F.col("source")), free, F.col("confidence"), 0.25)
    return rows.select("case_id", out["text"].alias("text"), out["reason"].alias("reason"))


DECODE_ACTIONS = ["KEEP", "DELETE", *(f"REPLACE_{i}" for i in range(8))]
DECODE_PUNCTS = ["", ",", ".", "?", "!", ":", ";", "—"]
# Decoding.  (text, {word: (action, confidence)}, {word: (mark, confidence)}, {word: scores}, corrected).
DECODE = [
    ("отеты были.", {0: ("REPLACE_1", 0.99)}, {}, {}, "одеты были."), ("Об этом сообщаетсяна странице.", {2: ("REPLACE_0", 0.99)}, {}, {2: {"сообщаетсяна": -5.0, "сообщается на": -1.0, "сообщается": -4.0}}, "Об этом сообщается на странице."),
    ("Об этом сообщаетсяна странице.", {2: ("REPLACE_0", 0.99)}, {}, {}, "Об этом сообщаетсяна странице."), ("Я думаю что это важно.", {}, {1: (",", 0.999)}, {}, "Я думаю, что это важно."), ("Я думаю что это важно", {}, {4: (".", 0.999)}, {}, "Я думаю что это важно."),
    ("отеты были.", {0: ("REPLACE_7", 0.99)}, {}, {}, "отеты были."), ("отеты были очень красивыми тут.", {2: ("DELETE", 0.999)}, {}, {}, "отеты были  красивыми тут."), ("отеты были.", {0: ("REPLACE_1", 0.5)}, {}, {}, "отеты были."),
]
DECODE_LEXICON = {"ответы": 60, "одеты": 50, "были": 50, "об": 50, "этом": 50, "сообщается": 90, "на": 90, "странице": 50, "я": 50, "думаю": 50, "что": 50, "это": 50, "важно": 50, "очень": 50, "красивыми": 50, "тут": 50}


def decoded(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(lines, decisions) of the decoding cases."""
    lines = built(spark, "line string, want string", [(r[0], r[-1]) for r in DECODE]).withColumn("line_no", F.lit(0))
    lex = lexicon(spark, DECODE_LEXICON)
    slots = correct.slot_rows(lines, "case_id")
    options = correct.options(slots, "case_id", lex, P.RU, 8, None, None, True, None)

    def row(values: dict, classes: list[str], usual: str) -> list[list[float]]:
        out = []
        for i in range(8):
            name, p = values.get(i, (usual, 0.99))
            rest = (1 - p) / (len(classes) - 1)
            out.append([p if c == name else rest for c in classes])
        return out

    probabilities = [(i, 0, 0, 0, row(r[1], DECODE_ACTIONS, "KEEP"), None) for i, r in enumerate(DECODE)]
    model = spark.createDataFrame(probabilities, "case_id int, line_no int, window_id int, start int, action array<array<double>>, punct array<array<double>>")
    # What the model says of marks is the text's own mark unless the case says otherwise.
    said = spark.createDataFrame([(i, k, m, p) for i, r in enumerate(DECODE) for k, (m, p) in r[2].items()], "case_id int, slot int, mark string, p double")
    own = slots.select("case_id", "slot", "label").join(said, ["case_id", "slot"], "left").withColumns({"mark": F.coalesce("mark", "label"), "p": F.coalesce("p", F.lit(0.99))})
    classes = F.array(*(F.lit(c) for c in DECODE_PUNCTS))
    own = own.withColumn("v", F.transform(classes, lambda c: F.when(c == F.col("mark"), F.col("p")).otherwise((1 - F.col("p")) / (len(DECODE_PUNCTS) - 1))))
    marks = own.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "v"))), lambda x: x["v"]).alias("punct"))
    model = model.drop("punct").join(marks, "case_id").withColumn("action", F.slice("action", F.lit(1), F.size("punct")))
    ranks = {0: ["ответы", "одеты"]}
    fixed = options.withColumn("cands", F.when(F.col("norm") == "отеты", F.array(*(F.struct(F.lit(t).alias("text"), F.lit("dictionary").alias("cand_source"), F.lit(1).alias("distance"), F.lit(3.0).alias("score")) for t in ranks[0]))).otherwise(F.col("cands")))
    scores = [(i, 0, k, n, t, s, True, "ok") for i, r in enumerate(DECODE) for k, v in r[3].items() for n, (t, s) in enumerate(v.items())]
    said = spark.createDataFrame(scores, "case_id int, line_no int, slot int, place int, text string, score double, available boolean, reason string")
    keys = ["case_id", "line_no"]
    decisions = decode.decode(fixed, model, keys, lex, P.STRICTNESS["strict"], DECODE_ACTIONS, DECODE_PUNCTS, said)
    return lines, spark.createDataFrame(decisions.collect(), decisions.schema)  # a row for each word of the cases; several tables are made of them


@golden(["case_id", "corrected"], outcomes(DECODE))
def ru_decode(spark, d):
    """Texts corrected by a model's probabilities and a reranker's scores."""
    lines, decisions = decoded(spark)
    return decode.corrected_lines(lines, decisions, ["case_id", "line_no"]).select("case_id", F.col("rebuilt").alias("corrected"))


DECODE_REASONS = [(0, 0, "applied", "одеты"), (1, 2, "applied", "сообщается на"), (2, 2, "split_context_disabled", "сообщаетсяна"), (5, 0, "replace_rank_out_of_range", "отеты"), (6, 2, "applied", ""), (7, 0, "*", "отеты")]


@golden(["case_id", "slot", "reason", "output_word"], DECODE_REASONS)
def ru_decode_reasons(spark, d):
    """The decisions about words that the model wants to change."""
    _, decisions = decoded(spark)
    rows = decode.logged(decisions).filter("predicted_action <> 'KEEP'")
    return rows.select("case_id", "slot", F.when(F.col("case_id") == 7, F.when(F.col("applied"), "applied").otherwise("*")).otherwise(F.col("blocked_reason")).alias("reason"), "output_word")


@golden(["changed", "predicted", "applied", "predicted_but_blocked", "blocked_rate"], [(1, 1, 0, 1, 1.0)])
def ru_punct_targets(spark, d):
    """Marks that a pair expects, beside the marks that were predicted and blocked."""
    pairs = built(spark, "error_text string, correct_text string, predicted_text string", [("Я думаю что это важно.", "Я думаю, что это важно.", "Я думаю что это важно.")])
    decisions = spark.createDataFrame([(0, 1, "думаю", "", ",", False, False, "internal", "low_confidence_or_margin")], "case_id int, slot int, word string, source_punct string, predicted_punct string, punct_applied boolean, protected_gap boolean, position_type string, punct_reason string")
    facts = evaluate.row_facts(metrics.analysis(pairs), "case_id")
    marks = evaluate.punct_facts(decisions, evaluate.expected(pairs, "case_id"), facts, "case_id")
    n = lambda c: F.count_if(f"punct_target_{c}").cast("int").alias(c)
    out = marks.agg(n("changed"), n("predicted"), n("applied"), n("predicted_but_blocked"))
    return out.withColumn("blocked_rate", evaluate.ratio(F.col("predicted_but_blocked"), F.col("predicted")))


COVERAGE = [("отеты были красными.", "одеты были красными."), ("превет мир.", "превед мир."), ("это чисто.", "это чисто.")]


@golden(["candidate_source", "rank", "n"], [("dictionary", 1, 1), (None, -1, 1)])
def ru_coverage(spark, d):
    """At which rank the targets of replaced words stand among their candidates."""
    lex = lexicon(spark, {"одеты": 2, "были": 10, "красными": 2, "ответы": 8, "мир": 1, "это": 1, "чисто": 1})
    covered = evaluate.coverage(built(spark, "error_text string, correct_text string", COVERAGE), lex, "case_id", P.RU, 8)
    return evaluate.rank_histogram(covered).withColumn("n", F.col("n").cast("int"))


# Texts corrected in dictionary mode.
CORRECT = [
    ("Сегодня очень хороший день, прривет мир и погода.", "Сегодня очень хороший день, привет мир и погода.", True, 1), ("", "", True, 0), (None, "", True, 0), ("Сегодня мир\n\nи прривет очень мир день", "Сегодня мир\n\nи привет очень мир день", True, 1), ("!!!", "!!!", True, 0),
    ("Сегодня   день —  «мир»", "Сегодня   день —  «мир»", True, 0),
]


@golden(["case_id", "corrected", "accepted", "edits"], [(i, *r[1:]) for i, r in enumerate(CORRECT)])
def ru_correct(spark, d):
    """Texts corrected line by line in dictionary mode."""
    lex = lexicon(spark, {"привет": 9, "мир": 9, "сегодня": 9, "хороший": 5, "день": 5, "погода": 5, "очень": 5})
    return correct.correct(built(spark, "text string, want string, ok boolean, n int", CORRECT), lex, "case_id").select("case_id", "corrected", "accepted", "edits")


# Texts with listed phrases.
PHRASES = [("Мы по новому пути идем", 1, "по-новому"), ("В виду дождя", 0, "ВВИДУ"), ("так же как", 0, "также"), ("в течении дня", 0, "в"), ("в течении дня", 1, "течение"), ("мини футбол", 0, "мини-футбол"), ("просто слова", 0, None)]


@golden(["case_id", "slot", "text"], [(i, r[1], r[2]) for i, r in enumerate(PHRASES)])
def ru_phrases(spark, d):
    """Listed phrases that stand before a word's candidates."""
    rows = built(spark, "text string, at int, want string", PHRASES)
    slots = correct.slot_rows(correct.line_rows(rows, "case_id", "text"), "case_id")
    found = correct.phrase_options(slots, "case_id", P.RU).select("case_id", F.col("slot").alias("at"), F.col("text").alias("found"))
    return rows.join(found, ["case_id", "at"], "left").select("case_id", F.col("at").alias("slot"), F.col("found").alias("text"))


# Rules of error injection that one place of a text answers.  (operators, text, text with the error, label).
INJECT = [
    ("orth", "Мы сделали по-новому", "Мы сделали по новому", "spelling_compound_joining"), ("orth", "Ввиду дождя", "В виду дождя", "spelling_compound_joining"), ("orth", "Железнодорожный вокзал", "Железно-дорожный вокзал", "spelling_compound_joining"), ("orth", "Люблю мини-футбол", "Люблю мини футбол", "spelling_compound_joining"),
    ("orth", "Здесь Москва", "Здесь москва", "spelling_capitalization"), ("orth", "Президент РФ", "президент РФ", "spelling_capitalization"), ("orth", "Этот ВУЗ", "Этот вуз", "spelling_abbreviation_case"), ("orth", "Мягкий поролон", "Мягкий паралон", "spelling_borrowed_word"), ("orth", "Кардинально иначе", "Координально иначе", "spelling_borrowed_word"),
    ("orth", "Просто текст", "Просто текст", None), ("struct", "да; нет", "да, нет", "punct_list_item_punctuation"), ("struct", "он, она", "он, она", None),
    ("punct", "Да", "Да", None),
]


@golden(["case_id", "text", "label"], [(i, r[2], r[3]) for i, r in enumerate(INJECT)])
def ru_injection_rules(spark, d):
    """The operator that a text answers to, and its error."""
    rows = built(spark, "kind string, text string, error string, label string", INJECT)
    key = F.col("case_id").cast("string")
    made = F.lit(None).cast("struct<text:string,label:string>")
    for kind, operations in (("orth", inject.ORTHOGRAPHY), ("struct", inject.STRUCTURE), ("punct", inject.PUNCTUATION)):
        made = F.when(F.col("kind") == kind, inject.one_operation(F.col("text"), operations, key, kind)).otherwise(made)
    return rows.withColumn("x", made).select("case_id", "x.text", "x.label")


# One place for each operator.
STRUCTURAL = [
    ("punct_quote_style", "Он сказал «да нет»", 'Он сказал "да нет"'), ("punct_remove_quotes", "Он сказал «да нет»", "Он сказал да нет"), ("punct_direct_speech_dash_missing", "Он: — да", "Он: да"), ("punct_direct_speech_inner_punct", "«Привет!»", "«Привет.»"), ("punct_dash_missing", "Он — врач", "Он врач"), ("punct_dash_extra", "Он студент", "Он — студент"),
    ("punct_bracket_missing_close", "Он (вчера) был", "Он (вчера был"), ("punct_ellipsis_extra", "Да...", "Да...."), ("punct_ellipsis_missing", "Да...", "Да"), ("punct_list_missing_colon", "Нужно: хлеб, соль", "Нужно хлеб, соль"), ("punct_list_item_punctuation", "хлеб; соль", "хлеб, соль"), ("punct_quote_punct_order", "«Мир», да", "«Мир,» да"),
    ("punct_wrong_period_to_comma", "Да. нет", "Да, нет"), ("punct_remove_comma_before_clause", "Знаю, что да", "Знаю что да"), ("punct_remove_internal_comma", "да, нет", "да нет"), ("punct_extra_comma", "да и нет", "да, и нет"), ("punct_remove_final", "Да!", "Да"), ("punct_remove_intro_comma", "Конечно, да", "Конечно да"),
    ("punct_wrong", "да: нет", "да; нет"), ("punct_remove_comma", "да, нет", "да нет"), ("punct_remove", "да? нет", "да нет"),
]


@golden(["case_id", "text"], outcomes(STRUCTURAL))
def ru_injection_operators(spark, d):
    """Each punctuation operator on a text with one place for it."""
    rows = built(spark, "name string, text string, want string", STRUCTURAL)
    made = F.lit(None).cast("string")
    for name, (_, (_, op), *_) in (inject.PUNCTUATION | inject.STRUCTURE).items():
        made = F.when(F.col("name") == name, op(F.col("text"), F.col("case_id").cast("long"))).otherwise(made)
    return rows.select("case_id", made.alias("text"))


@golden(["mode", "name", "value"], [(m, n, v) for m, row in {
    "strict": (0.82, 0.18, 0.88, 0.88, 0.995, 0.92, 0.12, 0.995, 0.45, 0.9995, 0.70, 0.70, 0.12, 0.10, 1.0, 0.70), "normal": (0.80, 0.14, 0.90, 0.84, 0.995, 0.94, 0.20, 0.99, 0.40, 0.999, 0.60, 0.65, 0.18, 0.12, 2.0, 0.55),
    "aggressive": (0.70, 0.10, 0.84, 0.78, 0.98, 0.88, 0.14, 0.97, 0.30, 0.995, 0.45, 0.55, 0.28, 0.20, 3.0, 0.45)}.items()
    for n, v in zip(("action", "action_margin", "dictionary_action", "rule_action", "delete", "punct", "punct_margin", "punct_delete", "punct_delete_margin", "comma_delete", "comma_delete_margin", "guard_confidence", "max_change_ratio", "max_length_delta_ratio", "max_simple_punct_drop", "min_punct_similarity"), row)])
def strictness_table(spark, d):
    """Thresholds of each strictness."""
    return spark.createDataFrame([(m, n, float(v)) for m, row in P.STRICTNESS.items() for n, v in row.items()], "mode string, name string, value double")


@golden(["error_text", "correct_text", "error_types", "difficulty", "split"], [(*r, "curated_v10", "val") for r in inject.CURATED])
def curated_pairs(spark, d):
    """The curated pairs of a split."""
    return inject.curated(spark, "val").select("error_text", "correct_text", "error_types", "difficulty", "split")


WIDE = [(0, 3, 0.5, "a"), (1, 3, 0.9, "b"), (2, 1, 0.99, "c")]


@golden(["place", "window_id", "conflict", "margin"], [(1, 1, True, 0.5), (2, 0, False, 1.0)])
def window_conflicts(spark, d):
    """The window that decides, whether it took over from another, and the margin of probabilities."""
    rows = spark.createDataFrame([(1, *r) for r in WIDE] + [(2, 0, 2, 0.5, "a"), (2, 1, 2, 0.5, "z")], "place int, window_id int, edge int, confidence double, output string")
    found = windows.resolve_overlaps(rows, ["place"])
    margins = spark.createDataFrame([(1, [0.2, 0.7, 0.1]), (2, [0.4])], "place int, p array<double>").select("place", F.round(windows.margin(F.col("p")), 9).alias("margin"))
    return found.join(margins, "place").select("place", "window_id", "conflict", "margin")


RUNS = [("a", 10, 0.5), ("b", 20, 0.25)]


@golden(["run", "examples", "exact_match"], RUNS)
def runs_compared(spark, d):
    """One row for each run of a comparison."""
    return metrics.runs_table({n: spark.createDataFrame([(k, x)], "examples int, exact_match double") for n, k, x in RUNS}).select("run", "examples", "exact_match")


GENERATED = [("кот", "кит", "<pad> кит</s>"), ("дом", "дом", "<pad></s>"), ("мир", "мир", "мор")]


@golden(["examples", "exact_match", "improved_rate", "worse_rate", "empty_generation_rate", "fallback_to_source_rate"], [(3, 0.666667, 0.333333, 0.333333, 0.333333, 0.333333)])
def ru_generated(spark, d):
    """A generative model's output cleaned and measured, with the rows that fell back to their source."""
    rows = evaluate.generated_rows(built(spark, "error_text string, correct_text string, raw_text string", GENERATED))
    return evaluate.generated_summary(rows).select(F.col("examples").cast("int").alias("examples"), "exact_match", "improved_rate", "worse_rate", "empty_generation_rate", "fallback_to_source_rate")


WER = [("а  б\tв", "а б в", 0.0), ("кот", "", 1.0), (" ", "", 0.0), ("кат сат", "кот сел", 0.428571), ("", "кот", 1.0)]


@golden(["case_id", "wer"], outcomes(WER))
def ru_wer(spark, d):
    """Character error rates over texts with white space collapsed."""
    return built(spark, "a string, b string, want double", WER).select("case_id", F.round(metrics.wer(F.col("a"), F.col("b")), 6).alias("wer"))


@golden(["case_id", "token_ids", "candidate_ids", "action_ids", "action_weights", "punct_weights"], [(0, "1,4,0", "[2,1],[4,1],[0,0]", "2,0,0", "3.0,1.0,0.0", "8.0,1.0,0.0")])
def ru_tensors(spark, d):
    """V1 to V4: padded ids and weights of an aligned example."""
    from ..operators import vectors

    examples = align.edit_labels(built(spark, "error_text string, correct_text string", [("кат сидит.", "кот, сидит.")]))
    vocab = spark.createDataFrame([("кот", 2), ("пес", 3), ("сидит", 4)], "norm string, word_id int")
    out = vectors.tensors(examples, vocab, "case_id", 3, 2)
    flat = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    lists = F.array_join(F.transform("candidate_ids", lambda x: F.concat(F.lit("["), flat(x), F.lit("]"))), ",")
    return out.select("case_id", flat("token_ids").alias("token_ids"), lists.alias("candidate_ids"), flat("action_ids").alias("action_ids"), flat("action_weights").alias("action_weights"), flat("punct_weights").alias("punct_weights"))


CHECKED = [("слово", False), ("словоо", True), ("кт", False), ("слов1", False), ("москва", True), ("ддом", True), ("прикол", True), ("что", False)]


@golden(["word", "checked"], CHECKED)
def ru_should_check(spark, d):
    """Words worth a search: unknown, or with a rule of their own."""
    words = spark.createDataFrame([(w,) for w, _ in CHECKED], "word string")
    return candidates.should_check(words, lexicon(spark, "слово что дом москва ддом"), P.RU)


EVALUATED = ["одеты были.", "Об этом сообщается на странице.", "Об этом сообщается на странице.", "Я думаю, что это важно.", "Я думаю что это важно.", "одеты были.", "отеты были красивыми тут.", "одеты были."]


@golden(
    ["word_edits", "titled", "present", "not_applied", "not_applied_rate", "absent", "blocked", "splits", "regressions", "marks_changed", "marks_applied", "blocked_marks_rate", "split_edits", "coverage"],
    [(3, 0, 5, 3, 0.6, 0, 3, 2, 0, 2, 2, 0.0, 1, 0.8)],
)
def ru_evaluation(spark, d):
    """Decisions beside what was expected, their ratios, and the rows that a reader would look at."""
    lines, decisions = decoded(spark)
    wanted = spark.createDataFrame(list(enumerate(EVALUATED)), "case_id int, correct_text string")
    made = decode.corrected_lines(lines, decisions, ["case_id", "line_no"]).select("case_id", F.col("line").alias("error_text"), F.col("rebuilt").alias("predicted_text"))
    rows = metrics.analysis(made.join(wanted, "case_id")).withColumn("error_types", F.lit("unknown"))
    facts, goal = evaluate.row_facts(rows, "case_id"), evaluate.expected(rows, "case_id")
    words, marks = evaluate.word_facts(decisions, goal, facts, "case_id"), evaluate.punct_facts(decisions, goal, facts, "case_id")
    changed = evaluate.edit_facts(decode.edits(decisions, ["case_id", "line_no"]), facts, "case_id")
    covered = spark.createDataFrame([(i, 0 if i else -1) for i in range(5)], "case_id int, rank int")
    out = evaluate.ratios(rows, words, marks, covered, changed)
    looked = evaluate.drill_downs(words, marks)
    counts = [changed.agg(F.count("*").cast("int").alias("word_edits"), F.count_if("source_is_title").cast("int").alias("titled"))]
    counts += [looked[k].agg(F.count("*").cast("int").alias(n)) for k, n in (("target_absent", "absent"), ("target_blocked", "blocked"), ("split_decisions", "splits"), ("punct_regressions", "regressions"))]
    for one in counts:
        out = out.join(one)  # one row each
    n = lambda c: F.col(c).cast("int")
    return out.select(
        "word_edits", "titled", n("target_present_count").alias("present"), n("target_present_but_not_applied_count").alias("not_applied"), F.col("target_present_but_not_applied_rate").alias("not_applied_rate"), "absent", "blocked", "splits", "regressions",
        n("punct_target_changed_count").alias("marks_changed"), n("punct_target_applied_count").alias("marks_applied"), F.col("punct_target_predicted_but_blocked_rate").alias("blocked_marks_rate"), n("split_applied_count").alias("split_edits"), F.col("candidate_coverage_rate").alias("coverage"),
    )


@golden(["called", "source_preferred", "disabled", "applied_marks", "lines"], [(1, 0, 1, 2, 8)])
def ru_counters(spark, d):
    """Counters derived from decisions."""
    lines, decisions = decoded(spark)
    counts = decode.runtime_counters(decisions).select(F.col("reranker_called_count").cast("int").alias("called"), F.col("reranker_source_preferred_count").cast("int").alias("source_preferred"))
    more = decisions.agg(F.count_if(F.col("reranker_reason").endswith("_context_disabled")).cast("int").alias("disabled"), F.count_if("punct_applied").cast("int").alias("applied_marks"))
    return counts.join(more).join(lines.agg(F.count("*").cast("int").alias("lines")))  # one row each
