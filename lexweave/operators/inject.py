"""Error injection: every choice is taken from a hash of the row's key, the operator and a seed, so reruns agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LETTERS = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
# Letters and endings that are often mistaken.
MISTAKES = {
    "а": "оя", "о": "а", "е": "иэ", "и": "еый", "ы": "и", "у": "юо", "ю": "у", "я": "ае", "э": "е", "ж": "шз", "ш": "жщ", "ч": "щц", "щ": "чш", "ц": "сч", "з": "сж", "с": "зц",
    "б": "п", "п": "б", "в": "ф", "ф": "в", "г": "кх", "к": "гх", "д": "т", "т": "д", "н": "м", "м": "н",
}
ENDINGS = {"тся": ("ться", "ца"), "ться": ("тся", "ца"), "ого": ("ово",), "его": ("ево",)}
# Weights and ranges of the error profiles (word operators, punctuation, orthography, structure).
WORD_OPS = {"replace": 0.35, "delete": 0.15, "swap": 0.10, "double": 0.20, "extra": 0.20}
PROFILES = {
    "spelling_light": {"words": (1, 1), "rate": 0.18, "punct": (0, 0), "orth": (0, 0), "struct": (0, 0)},
    "spelling_medium": {"words": (1, 3), "rate": 0.30, "punct": (0, 0), "orth": (0, 1), "struct": (0, 0)},
    "orthography_rules": {"words": (0, 0), "rate": 0.0, "punct": (0, 0), "orth": (1, 2), "struct": (0, 0)},
    "punctuation_only": {"words": (0, 0), "rate": 0.0, "punct": (1, 1), "orth": (0, 0), "struct": (0, 0)},
    "punctuation_structural": {"words": (0, 0), "rate": 0.0, "punct": (0, 0), "orth": (0, 0), "struct": (1, 1)},
    "mixed": {"words": (1, 3), "rate": 0.28, "punct": (1, 1), "orth": (0, 1), "struct": (0, 1)},
    "hard": {"words": (3, 5), "rate": 0.45, "punct": (1, 3), "orth": (1, 2), "struct": (1, 2)},
}
#: Weights of each number of spoilt words, from the least; even where a profile has none.
WORD_COUNTS = {"spelling_medium": (0.55, 0.35, 0.10), "mixed": (0.55, 0.35, 0.10), "hard": (0.55, 0.30, 0.15)}
CURRICULUM_TRAIN = {"spelling_light": 0.18, "spelling_medium": 0.16, "orthography_rules": 0.16, "punctuation_only": 0.18, "punctuation_structural": 0.18, "mixed": 0.10, "hard": 0.04}
CURRICULUM_EVAL = {"spelling_light": 0.24, "spelling_medium": 0.13, "orthography_rules": 0.14, "punctuation_only": 0.25, "punctuation_structural": 0.16, "mixed": 0.06, "hard": 0.02}
# The curated seed pairs.
CURATED = [
    ("Мы решили действовать по новому.", "Мы решили действовать по-новому.", "spelling_compound_joining"),
    ("В виду дождя матч перенесли.", "Ввиду дождя матч перенесли.", "spelling_compound_joining"),
    ("Железно-дорожный вокзал закрыли.", "Железнодорожный вокзал закрыли.", "spelling_compound_joining"),
    ("Мини футбол стал популярным.", "Мини-футбол стал популярным.", "spelling_compound_joining"),
    ("москва стала центром конференции.", "Москва стала центром конференции.", "spelling_capitalization"),
    ("президент Российской Федерации подписал указ.", "Президент Российской Федерации подписал указ.", "spelling_capitalization"),
    ("Этот вуз открыл лабораторию.", "Этот ВУЗ открыл лабораторию.", "spelling_abbreviation_case"),
    ("Мягкий паралон лежал на полу.", "Мягкий поролон лежал на полу.", "spelling_borrowed_word"),
    ("Нужно координально изменить подход.", "Нужно кардинально изменить подход.", "spelling_borrowed_word"),
    ('Он сказал: "Привет".', "Он сказал: «Привет».", "punct_quote_style"),
    ("Он сказал: Привет.", "Он сказал: «Привет».", "punct_remove_quotes"),
    ("Он сказал: Привет!", "Он сказал: — Привет!", "punct_direct_speech_dash_missing"),
    ("Он сказал: «Привет.»", "Он сказал: «Привет!»", "punct_direct_speech_inner_punct"),
    ("Москва столица России.", "Москва — столица России.", "punct_dash_missing"),
    ("Он — студент университета.", "Он студент университета.", "punct_dash_extra"),
    ("Он пришел (вчера.", "Он пришел (вчера).", "punct_bracket_missing_close"),
    ("Он пришел (вчера).", "Он пришел вчера.", "punct_bracket_extra"),
    ("Он задумался....", "Он задумался...", "punct_ellipsis_extra"),
    ("Он задумался", "Он задумался...", "punct_ellipsis_missing"),
    ("Нужно купить хлеб, молоко и сыр.", "Нужно купить: хлеб, молоко и сыр.", "punct_list_missing_colon"),
    ("Список: хлеб, молоко, сыр.", "Список: хлеб; молоко; сыр.", "punct_list_item_punctuation"),
    ("Он прочитал «Войну и мир,» затем ушел.", "Он прочитал «Войну и мир», затем ушел.", "punct_quote_punct_order"),
]


def number(*parts: Column | str | int) -> Column:
    """A number from 0 to 2 ** 32 - 1, from the md5 of the parts; other engines compute the same."""
    text = F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def share(*parts: Column | str | int) -> Column:
    return number(*parts) / float(1 << 32)


def pick(options: Column, n: Column) -> Column:
    """The option that the number falls on; null if there is none."""
    return F.get(options, F.pmod(n, F.greatest(F.size(options), F.lit(1))).cast("int"))


def weighted(weights: dict[str, float], u: Column) -> Column:
    """The name whose share of the weights holds `u` (0 to 1)."""
    total, at = sum(weights.values()), 0.0
    names = list(weights)
    chain = None
    for name in names[:-1]:
        at += weights[name] / total
        chain = F.when(u < at, name) if chain is None else chain.when(u < at, name)
    return chain.otherwise(names[-1]) if chain is not None else F.lit(names[0])


def editable_end(word: Column) -> Column:
    n = F.length(word)
    return F.greatest(F.lit(1), n - F.when(n >= 6, 3).otherwise(2))


def before(word: Column, at: Column) -> Column:
    return F.substring(word, F.lit(1), at)


def after(word: Column, at: Column) -> Column:
    return F.substring(word, at + 1, F.length(word))


def delete_char(word: Column, n: Column) -> Column:
    at = F.pmod(n, editable_end(word)).cast("int")
    return F.when(F.length(word) >= 3, F.concat(before(word, at), after(word, at + 1))).otherwise(word)


def double_char(word: Column, n: Column) -> Column:
    at = F.pmod(n, editable_end(word)).cast("int")
    return F.when(F.length(word) >= 3, F.concat(before(word, at + 1), after(word, at))).otherwise(word)


def swap_chars(word: Column, n: Column) -> Column:
    """Two neighbours change places; a short word loses a character instead."""
    most = F.greatest(F.lit(0), F.least(F.length(word) - 4, editable_end(word) - 2))
    at = F.pmod(n, most + 1).cast("int")
    swapped = F.concat(before(word, at), F.substring(word, at + 2, F.lit(1)), F.substring(word, at + 1, F.lit(1)), after(word, at + 2))
    return F.when(F.length(word) > 4, swapped).otherwise(delete_char(word, n))


def extra_char(word: Column, n: Column, letters: str = LETTERS) -> Column:
    at = F.pmod(n, editable_end(word) + 1).cast("int")
    letter = F.substring(F.lit(letters), F.pmod(F.floor(n / 64), F.lit(len(letters))).cast("int") + 1, F.lit(1))
    return F.when(F.length(word) >= 3, F.concat(before(word, at), letter, after(word, at))).otherwise(word)


def replace_char(word: Column, n: Column) -> Column:
    """struct<word, label>: an ending or a letter that is often mistaken; a character is deleted where there is none."""
    low = F.lower(word)
    end_options = F.filter(F.array(*(F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in ENDINGS)), lambda k: k.isNotNull())
    ends = F.create_map(*(F.lit(x) for k, v in ENDINGS.items() for x in (k, "|".join(v))))
    key = pick(end_options, F.floor(n / 8))
    start = F.position(key, low)
    ending = F.concat(before(word, start - 1), pick(F.split(ends[key], r"\|"), F.floor(n / 16)), after(word, start + F.length(key) - 1))
    letters = F.create_map(*(F.lit(x) for k, v in MISTAKES.items() for x in (k, v)))
    spots = F.filter(F.transform(F.sequence(F.lit(0), editable_end(word) - 1), lambda i: F.when(letters[F.substring(low, i + 1, F.lit(1))].isNotNull(), i)), lambda i: i.isNotNull())
    at = pick(spots, F.floor(n / 32))
    options = letters[F.substring(low, at + 1, F.lit(1))]
    letter = F.substring(options, F.pmod(F.floor(n / 512), F.greatest(F.length(options), F.lit(1))).cast("int") + 1, F.lit(1))
    single = F.concat(before(word, at), letter, after(word, at + 1))
    by_end = (F.size(end_options) > 0) & (F.pmod(n, F.lit(10)) < 7)
    label = F.when(key.isin("ого", "его"), "spelling_suffix_pronunciation").otherwise("spelling_tsya")
    return F.when(by_end, F.struct(ending.alias("word"), label.alias("label"))).when(F.size(spots) > 0, F.struct(single.alias("word"), F.lit("spelling_replace").alias("label"))).otherwise(F.struct(delete_char(word, n).alias("word"), F.lit("spelling_delete").alias("label")))


def word_error(word: Column, kind: Column, n: Column) -> Column:
    """struct<word, label>, the first letter's case kept."""
    replaced = replace_char(word, n)
    made = F.when(kind == "replace", replaced["word"]).when(kind == "delete", delete_char(word, n)).when(kind == "swap", swap_chars(word, n)).when(kind == "double", double_char(word, n)).otherwise(extra_char(word, n))
    made = F.when(T.is_upper(F.substring(word, 1, 1)), F.concat(F.upper(F.substring(made, 1, 1)), F.substring(made, F.lit(2), F.length(made)))).otherwise(made)
    return F.struct(made.alias("word"), F.when(kind == "replace", replaced["label"]).otherwise(F.concat(F.lit("spelling_"), kind)).alias("label"))


def word_count(key: Column, least: Column, most: Column, shares: Column | None = None, seed: int = 42) -> Column:
    """A number from `least` to `most`; `shares`: array of the shares up to each number, without which all are as likely."""
    u = share(key, seed, "count")
    even = F.floor(u * (most - least + 1)).cast("int")
    return least + (even if shares is None else F.when(shares.isNull(), even).otherwise(F.least(F.size(F.filter(shares, lambda s: s <= u)), most - least)))


def word_errors(text: Column, key: Column, least: Column, most: Column, rate: Column, seed: int = 42, shares: Column | None = None) -> Column:
    """struct<text, labels>: between `least` and `most` words of a text spoilt, at most `rate` of its words of three letters or more."""
    shape = rf"^([^{T.LETTER}]*)([{T.LETTER}]+)([^{T.LETTER}]*)$"
    wanted = word_count(key, least, most, shares, seed)

    def able(words: Column) -> Column:
        places = F.transform(words, lambda w, i: F.when(w.rlike(shape) & (F.length(F.regexp_extract(w, shape, 2)) > 2), F.struct(number(key, seed, i, "order").alias("h"), i.alias("i"))))
        return F.struct(words.alias("w"), F.array_sort(F.filter(places, lambda x: x.isNotNull())).alias("a"))

    def choice(x: Column) -> Column:
        cap = F.when(rate > 0, F.greatest(F.lit(1), F.bround(F.size(x["a"]) * rate).cast("int"))).otherwise(0)
        return F.struct(x["w"].alias("w"), F.transform(F.slice(x["a"], F.lit(1), F.greatest(F.lit(0), F.least(wanted, cap, most))), lambda y: y["i"]).alias("c"))

    def spoilt(word: Column, i: Column, chosen: Column) -> Column:
        core = F.regexp_extract(word, shape, 2)
        done = word_error(core, weighted(WORD_OPS, share(key, seed, i, "kind")), number(key, seed, i, "place"))
        hit = T.let(F.struct(core.alias("core"), done.alias("done")), lambda y: F.struct(F.concat(F.regexp_extract(word, shape, 1), y["done"]["word"], F.regexp_extract(word, shape, 3)).alias("word"), F.when(y["done"]["word"] != y["core"], y["done"]["label"]).alias("label")))
        return F.when(F.array_contains(chosen, i), hit).otherwise(F.struct(word.alias("word"), F.lit(None).cast("string").alias("label")))

    def finished(made: Column) -> Column:
        labels = F.filter(F.transform(made, lambda x: x["label"]), lambda x: x.isNotNull())
        return F.struct(F.when(F.exists(made, lambda x: x["label"].isNotNull()), F.array_join(F.transform(made, lambda x: x["word"]), " ")).otherwise(text).alias("text"), labels.alias("labels"))

    picked = T.let(T.let(F.split(T.strip(text), T.WHITE), able), choice)
    return T.let(T.let(picked, lambda x: F.transform(x["w"], lambda w, i: spoilt(w, i, x["c"]))), finished)


def replace_one(text: Column, pattern: str, n: Column, make: Callable[[Column], Column]) -> Column:
    """One match of `pattern`, chosen by the number, replaced by `make` of it; the text itself if nothing matches."""
    found, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def chosen(x: Column) -> Column:
        at = F.pmod(n, F.greatest(F.size(x["f"]), F.lit(1))).cast("int")
        return F.struct(F.arrays_zip(x["p"].alias("p"), x["f"].alias("f")).alias("z"), at.alias("at"), F.size(x["f"]).alias("k"))

    def joined(x: Column) -> Column:
        part = lambda y, i: F.concat(F.coalesce(y["p"], F.lit("")), F.when(y["f"].isNull(), "").when(i == x["at"], make(y["f"])).otherwise(y["f"]))
        return F.when(x["k"] > 0, F.array_join(F.transform(x["z"], part), "")).otherwise(text)

    return T.let(T.let(F.struct(found.alias("f"), parts.alias("p")), chosen), joined)


def inside(match: Column, pattern: str, template: str) -> Column:
    return F.regexp_replace(match, pattern, template)


def _sub(pattern: str, template: str, inner: str | None = None):
    """(pattern, operator): one match of the pattern rewritten."""
    return pattern, lambda text, n: replace_one(text, pattern, n, lambda m: inside(m, inner or f"^(?:{pattern})$", template))


def _word(pattern: str, replacement: str, keep_case: bool = True):
    """(pattern, operator): one match replaced by a word, in the match's case."""
    return pattern, lambda text, n: replace_one(text, pattern, n, lambda m: T.case_like(F.lit(replacement), m) if keep_case else F.lit(replacement))


def _first(*choices):
    """(pattern, operator): the first of several operators whose pattern is found."""
    def op(text: Column, n: Column) -> Column:
        chain = None
        for pattern, one in choices:
            chain = F.when(text.rlike(pattern), one(text, n)) if chain is None else chain.when(text.rlike(pattern), one(text, n))
        return chain.otherwise(text)

    return "|".join(f"(?:{pattern})" for pattern, _ in choices), op


# Words around commas, and marks by name and by what they are mistaken for.
CLAUSES = "что|чтобы|если|когда|который|которая|которое|которые|потому что|так как|хотя|поскольку"
INTRODUCTORY = "конечно|однако|например|впрочем|значит|кстати|во-первых|во-вторых|наконец|вероятно|возможно|поэтому|следовательно"
MARKS = {",": "comma", ".": "period", "?": "question", "!": "exclamation", ":": "colon", ";": "semicolon"}
WRONG = {",": ".", ".": ",", "!": ".", "?": ".", ":": ";", ";": ":"}

MARKED = r"(?iuU:(?<![,;:\s])\s+(?=(?:и|а|но|что|как|если|когда|или)\b))"


def extra_comma(text: Column, n: Column) -> Column:
    """A comma before a conjunction, or else in one of the inner gaps of four words or more."""
    marked = replace_one(text, MARKED, n, lambda m: inside(m, r"(?U)\s+", ", "))
    gaps = F.size(F.split(text, r"(?U)\s+", -1)) - 1

    def inner(x: Column) -> Column:
        at = 1 + F.pmod(n, F.greatest(x["k"] - 2, F.lit(1))).cast("int")
        return F.array_join(F.transform(x["z"], lambda y, i: F.concat(F.coalesce(y["p"], F.lit("")), F.when(y["f"].isNull(), "").when(i == at, ", ").otherwise(y["f"]))), "")

    parts = F.struct(F.arrays_zip(F.split(text, r"(?U)\s+", -1).alias("p"), F.regexp_extract_all(text, F.lit(r"(?U)\s+"), F.lit(0)).alias("f")).alias("z"), gaps.alias("k"))
    return F.when(text.rlike(MARKED), marked).when(gaps > 2, T.let(parts, inner)).otherwise(text)


def chosen(text: Column, pattern: str, n: Column) -> Column:
    """The match of `pattern` that `replace_one` rewrites."""
    return pick(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), n)


def named(values: dict[str, str], mark: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[mark]


def _wrong_label(text: Column, n: Column) -> Column:
    return named({m: f"punct_wrong_{MARKS[m]}_to_{MARKS[w]}" for m, w in WRONG.items()}, chosen(text, "[,.!?:;]", n))


def _comma_label(text: Column, n: Column) -> Column:
    return F.when(T.count_of(text, ",") == 1, "punct_remove_all_commas").otherwise("punct_remove_comma")


def _remove_label(text: Column, n: Column) -> Column:
    return named({m: f"punct_remove_{v}" for m, v in MARKS.items()}, chosen(text, "[,.!?:;]", n))


#: Punctuation operators by label with the weight of each (how often the list of operators has it); a label that depends on the mark is
#: made by the function that stands third.
PUNCTUATION = {
    "punct_wrong_period_to_comma": (3, _sub(r"\.(?=\s+[а-яё])(?=.*\S)", ",", r"\.")),
    "punct_remove_comma_before_clause": (6, _sub(rf"(?iuU),\s+(?={CLAUSES}\b)".replace(CLAUSES, f"(?:{CLAUSES})"), " ", r"(?U),\s+")),
    "punct_remove_internal_comma": (2, _sub(r"(?U),(?=\s+\S)", "", ",")),
    "punct_extra_comma": (6, (rf"{MARKED}|(?U:\s+\S+\s+\S+\s+)", extra_comma)),
    "punct_remove_final": (4, _sub(r"(?U)[.?!…](?=\s*$)", "", r"[.?!…]")),
    "punct_wrong": (2, ("[,.!?:;]", lambda text, n: replace_one(text, "[,.!?:;]", n, lambda m: F.translate(m, "".join(WRONG), "".join(WRONG.values())))), _wrong_label),
    "punct_remove_comma": (2, _sub(",", ""), _comma_label),
    "punct_remove_intro_comma": (1, _sub(rf"(?iuU)(?<=\b(?:{INTRODUCTORY})),\s+", " ", r"(?U),\s+")),
    "punct_remove": (1, _sub("[,.!?:;]", ""), _remove_label),
}
ORTHOGRAPHY = {
    "spelling_compound_joining": (1, _first(_word(r"(?iuU)\bпо[-‑]новому\b", "по новому"), _word(r"(?iuU)\bввиду\b", "в виду"), _word(r"(?iuU)\bжелезнодорожный\b", "железно-дорожный"), _word(r"(?iuU)\bмини[-‑]футбол\b", "мини футбол"))),
    "spelling_capitalization": (1, _first(_word(r"(?U)\bМосква\b", "москва", False), _word(r"(?U)\bПрезидент(?=\s+(?:Российской\s+Федерации|РФ)\b)", "президент", False))),
    "spelling_abbreviation_case": (1, _word(r"(?U)\bВУЗ\b", "вуз", False)),
    "spelling_borrowed_word": (1, _first(_word(r"(?iuU)\bпоролон\b", "паралон"), _word(r"(?iuU)\bкардинально\b", "координально"))),
}
STRUCTURE = {
    "punct_quote_style": (1, _sub("«([^»]{2,80})»", '"$1"')), "punct_remove_quotes": (1, _sub("«([^»]{2,80})»", "$1")), "punct_direct_speech_dash_missing": (1, _sub(r"(?U):\s+—\s+", ": ", r"(?U):\s+—\s+")),
    "punct_direct_speech_inner_punct": (1, _sub("([А-Яа-яЁё]+)!»", "$1.»")), "punct_dash_missing": (1, _sub(r"(?U)\s+—\s+", " ", r"(?U)\s+—\s+")), "punct_dash_extra": (1, _sub(r"(?U)\b(Он|Она|Это)\s+([а-яё]{4,})\b", "$1 — $2", r"(?U)(\S+)\s+(\S+)")),
    "punct_bracket_missing_close": (1, _sub(r"\(([^()]{2,40})\)", "($1")), "punct_bracket_extra": (1, _sub(r"(?U)\b([А-Яа-яЁё]{4,})\b", "($1)", "^(.*)$")), "punct_ellipsis_extra": (1, _sub(r"\.\.\.", "....")), "punct_ellipsis_missing": (1, _sub(r"\.\.\.", "")),
    "punct_list_missing_colon": (1, _sub(r"(?U):(?=\s+[А-Яа-яЁё]+[,;])", "", ":")), "punct_list_item_punctuation": (1, _sub(r"(?U);(?=\s+[А-Яа-яЁё]+)", ",", ";")), "punct_quote_punct_order": (1, _sub("»,", ",»")),
}


def one_operation(text: Column, operations: dict, key: Column, step: str | int, seed: int = 42) -> Column:
    """struct<text, label>: of the operators in hashed order (heavier ones earlier), the first whose pattern is found; label null if it changes nothing.

    Only the operator that is chosen is computed.
    """
    tried = []
    for i, (label, (weight, (pattern, _), *_)) in enumerate(operations.items()):
        # A key of u ** (1 / weight) draws without replacement in proportion to the weights.
        rank = -F.pow(share(key, seed, step, label, "order"), F.lit(1.0 / weight))
        tried.append(F.when(text.rlike(pattern), F.struct(rank.alias("rank"), F.lit(i).alias("i"))))
    best = F.array_min(F.filter(F.array(*tried), lambda x: x.isNotNull()))["i"]

    def applied(i: Column) -> Column:
        made, names = F.when(i.isNull(), text), F.when(i.isNull(), F.lit(None).cast("string"))
        for j, (label, (_, (_, op), *name)) in enumerate(operations.items()):
            n = number(key, seed, step, label)
            made = made.when(i == j, op(text, n))
            names = names.when(i == j, name[0](text, n) if name else label)
        return F.struct(made.alias("text"), names.alias("name"))

    return T.let(T.let(best, applied), lambda x: F.struct(x["text"].alias("text"), F.when(x["text"] != text, x["name"]).alias("label")))


def inject(rows: DataFrame, text_col: str, key_cols: list[str], profile_col: str, seed: int = 42) -> DataFrame:
    """`rows` with error_text and error_labels, by the profile of each row: words, punctuation, orthography, structure, at least one error.

    A row without a profile stays as it is.
    """
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in key_cols))

    def of(part: str, side: int | None = None) -> Column:
        pairs = [x for p, v in PROFILES.items() for x in (F.lit(p), F.lit(v[part] if side is None else v[part][side]))]
        return F.create_map(*pairs)[F.col(profile_col)]

    sums = {p: [sum(w[: i + 1]) for i in range(len(w) - 1)] for p, w in WORD_COUNTS.items()}
    shares = F.create_map(*(x for p, v in sums.items() for x in (F.lit(p), F.array(*(F.lit(s) for s in v)))))[F.col(profile_col)]
    kept = F.struct(F.col(text_col).alias("text"), F.when(F.col(text_col).isNotNull(), F.array().cast("array<string>")).alias("labels"))
    done = F.when(of("words", 1) > 0, word_errors(F.col(text_col), key, of("words", 0), of("words", 1), of("rate"), seed, shares)).otherwise(kept)
    rows = rows.withColumn("_e", done).withColumns({"error_text": F.col("_e.text"), "error_labels": F.col("_e.labels")})
    for part, operations, most in (("punct", PUNCTUATION, 3), ("orth", ORTHOGRAPHY, 2), ("struct", STRUCTURE, 2)):
        count = of(part, 0) + F.pmod(number(key, seed, part, "count"), of(part, 1) - of(part, 0) + 1).cast("int")
        for step in range(most):
            rows = rows.withColumn("_e", F.when(count > step, one_operation(F.col("error_text"), operations, key, f"{part}{step}", seed)))
            rows = rows.withColumns({"error_text": F.coalesce("_e.text", "error_text"), "error_labels": F.when(F.col("_e.label").isNotNull(), F.concat("error_labels", F.array("_e.label"))).otherwise(F.col("error_labels"))})
    missing = F.col(profile_col).isNotNull() & (F.col("error_text") == F.col(text_col)) & (T.strip(F.col(text_col)) != "")
    rows = rows.withColumn("_e", F.when(missing, word_errors(F.col(text_col), key, F.lit(1), F.lit(1), F.lit(0.25), seed + 1)))
    rows = rows.withColumns({"error_text": F.coalesce("_e.text", "error_text"), "error_labels": F.coalesce("_e.labels", "error_labels")})
    return rows.drop("_e")


def clean_slots(rows: DataFrame, ratio: float, key_cols: list[str], seed: int = 42) -> DataFrame:
    """`rows` with is_clean: exactly round(n * ratio) of them (half to even, at least 1 if ratio is above 0), by hashed order.

    The cut is found on hash buckets, so that no task sorts all rows: the rows of one bucket of 1,024 are ranked, all others are told by their hash.
    """
    key = F.concat_ws("|", *(F.col(c).cast("string") for c in key_cols))
    bucket, order = F.floor(number(key, seed, "clean") / (1 << 22)), [number(key, seed, "clean"), *(F.col(c) for c in key_cols)]
    buckets = sorted((r["_b"], r["_n"]) for r in rows.groupBy(bucket.alias("_b")).agg(F.count("*").alias("_n")).collect())  # 1,024 rows at most
    n = sum(k for _, k in buckets)
    left = max(1, round(n * ratio)) if ratio > 0 and n else 0
    for cut, k in buckets:
        if left < k:
            break
        left -= k
    else:
        return rows.withColumn("is_clean", F.lit(True))
    if not left:
        return rows.withColumn("is_clean", bucket < cut)
    # The last clean row: its hash, then its key, as rows are ordered. Rows that are no different from it are ranked.
    names = [f"_{i}" for i in range(len(order))]
    place = F.struct(*(c.alias(n) for c, n in zip(order, names)))
    some = rows.filter(bucket == cut)
    after, last = (r["p"] for r in some.select(place.alias("p")).orderBy("p").limit(left + 1).orderBy(F.desc("p")).limit(2).collect())
    if after == last:
        rank = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
        ranked = some.withColumn("_b", bucket).withColumn("is_clean", rank <= left).drop("_b")
        return rows.filter(bucket != cut).withColumn("is_clean", bucket < cut).unionByName(ranked)
    types = [f.dataType for f in rows.select(place.alias("p")).schema["p"].dataType]
    return rows.withColumn("is_clean", place <= F.struct(*(F.lit(v).cast(t).alias(n) for v, t, n in zip(last, types, names))))


def curriculum(texts: DataFrame, text_col: str = "text", key_col: str = "doc_id", samples: int = 3, clean_ratio: float = 0.45, weights: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """Correction pairs: `samples` of each text of at least 10 characters, an exact share of them clean, the others by weighted profiles."""
    weights = weights or CURRICULUM_EVAL
    slots = texts.filter(F.length(text_col) >= 10).select(key_col, F.col(text_col).alias("correct_text"), F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("sample"))
    slots = clean_slots(slots, clean_ratio, [key_col, "sample"], seed)
    profile = weighted(weights, share(F.concat_ws("|", F.col(key_col).cast("string"), F.col("sample").cast("string")), seed, "profile"))
    slots = slots.withColumn("profile", F.when(~F.col("is_clean"), profile))
    made = inject(slots, "correct_text", [key_col, "sample"], "profile", seed)
    types = F.when(F.size("error_labels") > 0, F.array_join("error_labels", "|")).otherwise("unknown")
    return made.select(key_col, "sample", F.when(F.col("is_clean"), F.col("correct_text")).otherwise(F.col("error_text")).alias("error_text"), "correct_text", F.when(F.col("is_clean"), "clean").otherwise(F.col("profile")).alias("difficulty"), F.when(F.col("is_clean"), "clean").otherwise(types).alias("error_types"), F.lit("synthetic").alias("source_kind"), F.lit("synthetic").alias("source_dataset"), F.lit("").alias("source_domain"))


def curated(spark, split: str = "train") -> DataFrame:
    rows = spark.createDataFrame(CURATED, "error_text string, correct_text string, error_types string")
    return rows.withColumns({"difficulty": F.lit("curated_v10"), "source_kind": F.lit("synthetic"), "source_dataset": F.lit("curated_v10"), "source_domain": F.lit(""), "split": F.lit(split)})
