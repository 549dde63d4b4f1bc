"""Language profiles and strictness thresholds: every value the rules depend on, as data."""

from __future__ import annotations

from dataclasses import dataclass, field

# Punctuation classes.
PUNCT_CHARS = '.,!?;:-"()[]{}—–«»'
SIMPLE_PUNCT = ",.!?:;"
STRUCTURAL_PUNCT = '"()[]{}—–«»№/\\'
SIMPLE_LABELS = ("", ",", ".", "?", "!", ":", ";", "—")
STRUCTURAL_LABELS = ("...", "....", ":—", ":«", ':"', "—", "«", '"', "(", ")", ").", ".»", '."', "».", '".', "»,", '",', ",»", ',"', "!»", '!"', "?»", '?"')
ABBREVIATIONS = ("ч", "ст", "п", "пп", "рис", "ул", "г", "им", "т", "д", "млн", "тыс", "руб", "стр", "см")
DOMAIN_ZONES = ("ru", "com", "net", "org", "su", "рф", "by", "kz", "ua", "edu", "gov", "io")

# Scores added by a candidate's source.
SOURCE_BOOSTS = {"rule": 6.0, "phrase_safe": 6.0, "mined": 5.0, "orthographic": 3.5, "keyboard": 3.0, "split": 0.5, "dictionary": 0.0}

# Thresholds by strictness.
STRICTNESS = {
    "strict": {"action": 0.82, "action_margin": 0.18, "dictionary_action": 0.88, "rule_action": 0.88, "delete": 0.995, "punct": 0.92, "punct_margin": 0.12, "punct_delete": 0.995, "punct_delete_margin": 0.45, "comma_delete": 0.9995, "comma_delete_margin": 0.70, "guard_confidence": 0.70, "max_change_ratio": 0.12, "max_length_delta_ratio": 0.10, "max_simple_punct_drop": 1, "min_punct_similarity": 0.70},
    "normal": {"action": 0.80, "action_margin": 0.14, "dictionary_action": 0.90, "rule_action": 0.84, "delete": 0.995, "punct": 0.94, "punct_margin": 0.20, "punct_delete": 0.99, "punct_delete_margin": 0.40, "comma_delete": 0.999, "comma_delete_margin": 0.60, "guard_confidence": 0.65, "max_change_ratio": 0.18, "max_length_delta_ratio": 0.12, "max_simple_punct_drop": 2, "min_punct_similarity": 0.55},
    "aggressive": {"action": 0.70, "action_margin": 0.10, "dictionary_action": 0.84, "rule_action": 0.78, "delete": 0.98, "punct": 0.88, "punct_margin": 0.14, "punct_delete": 0.97, "punct_delete_margin": 0.30, "comma_delete": 0.995, "comma_delete_margin": 0.45, "guard_confidence": 0.55, "max_change_ratio": 0.28, "max_length_delta_ratio": 0.20, "max_simple_punct_drop": 3, "min_punct_similarity": 0.45},
}

# Word lists of the gates.
GLUED_SERVICE = ("в", "во", "на", "не", "ни", "о", "об", "обо", "по", "за", "до", "к", "ко", "с", "со", "из", "от", "их")
PHRASE_JOININGS = (("по", "новому", "по-новому"), ("в", "виду", "ввиду"), ("мини", "футбол", "мини-футбол"))
PRESIDENT_NEXT = ("рф", "российской")
COMMA_SERVICE = ("в", "во", "на", "к", "ко", "с", "со", "от", "до", "из", "за", "по", "при", "для", "без", "у", "о", "об", "обо")
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
DICTIONARY_LIKE = ("dictionary", "keyboard", "orthographic", "mined")
ENTITY_PREVIOUS = ("город", "городе", "города", "городу", "деревня", "деревне", "житель", "жителя", "жительница", "жители", "имени", "крае", "области", "поселке", "поселок", "посёлке", "посёлок", "районе", "республике", "селе", "словам", "улица", "улице")
ENTITY_NEXT = ("области", "края", "района", "улицы")
INFINITIVE_CUES = ("может", "могут", "будет", "будут", "должен", "должна", "должно", "должны", "нужно", "надо", "риск", "риске", "чтобы")
FOREIGN_DOUBLES = ("ьь", "ъъ", "йй", "ёё")
ADJECTIVE_ENDINGS = ("ых", "их", "ого", "его", "ому", "ему", "ым", "им", "ыми", "ими", "ой", "ую", "юю")
VERB_ENDINGS = ("л", "ла", "ло", "ли", "ет", "ют", "ит", "ят", "ется", "ются", "ем", "им", "ете", "ите")
PARTICIPLE_ENDINGS = ("вший", "вшая", "вшее", "вшие", "нный", "нная", "нное", "нные", "енный", "енная", "енное", "енные", "емый", "емая", "емое", "емые", "ющий", "ющая", "ющее", "ющие", "ший", "шая", "шее", "шие", "тый", "тая", "тое", "тые")
INTRODUCTORY = ("пожалуй", "наверное", "конечно", "возможно", "вероятно", "однако", "например")
REPORTED = ("сообщалось", "сообщается", "сообщили", "сообщил", "сообщила", "сообщают", "сообщает")
SPEECH_VERBS = ("утверждают", "утверждалось", "заявил", "заявила", "заявили", "заявляет", "заявляют", "добавил", "добавила", "добавили", "подтвердил", "подтвердила", "подтвердили", "ответил", "ответила", "ответили", "выразил", "выразила", "выразили", "подчеркнул", "подчеркнула", "подчеркнули", "спрашивает", "сказал", "сказала", "сказали", "понимают", "слушают", "сожалею")
FIXED_NEXT = ("или", "чтобы", "самого", "самой", "самое", "самые", "стоит", "времени")
FIXED_PAIRS = (("башни", "не"), ("подвал", "не"), ("словом", "не"), ("прессы", "не"), ("тем", "не"), ("античности", "геммы"), ("очередь", "министр"), ("образом", "биржа"), ("мотивация", "была"), ("почерковеды", "работали"), ("значит", "возраст"), ("работаешь", "сейчас"), ("ответьте", "мне"), ("выяснялись", "отношения"), ("контекст", "достаточно"), ("средство", "освоения"), ("руставели", "их"))
PREPOSITIONS = ("на", "с", "со", "в", "во", "по", "при", "для", "о", "об", "обо", "у", "к", "ко", "от", "до", "из", "за")
DESCRIPTOR_ENDINGS = ("ен", "на", "но", "ны", "ый", "ий", "ая", "ое", "ые")


@dataclass(frozen=True)
class Profile:
    """What candidate generation draws from."""

    alphabet: str
    consonants: str = ""
    vowels: str = ""
    keyboard_rows: tuple[str, ...] = ()
    char_confusions: dict[str, tuple[str, ...]] = field(default_factory=dict)
    exact: dict[str, tuple[str, ...]] = field(default_factory=dict)
    substring: dict[str, tuple[str, ...]] = field(default_factory=dict)
    phrase: dict[str, tuple[str, ...]] = field(default_factory=dict)
    split_prefix_block: tuple[str, ...] = ()
    split_pairs: tuple[tuple[str, str], ...] = ()
    split_short_left: tuple[str, ...] = ()
    split_short_right: tuple[str, ...] = ()
    split_service_left: tuple[str, ...] = ()
    split_service_right: tuple[str, ...] = ()
    split_unsafe_left: tuple[str, ...] = ()
    split_unsafe_right: tuple[str, ...] = ()
    split_endings: tuple[str, ...] = ()
    min_dictionary_length: int = 4
    bucket: int = 5000
    long_length: int = 8
    long_bucket: int = 2000

    def neighbours(self) -> dict[str, str]:
        """Keyboard neighbours of each key: keys at most one row and one column away, in code-point order."""
        at = {c: (r, i) for r, row in enumerate(self.keyboard_rows) for i, c in enumerate(row)}
        return {c: "".join(sorted(o for o, (q, j) in at.items() if o != c and abs(r - q) <= 1 and abs(i - j) <= 1)) for c, (r, i) in at.items()}


# Russian tables.
RU = Profile(
    alphabet="абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
    consonants="бвгджзйклмнпрстфхцчшщ",
    vowels="аеёиоуыэюя",
    keyboard_rows=("йцукенгшщзхъ", "фывапролджэ", "ячсмитьбю"),
    char_confusions={"а": ("о", "я"), "о": ("а",), "я": ("а",), "е": ("и",), "и": ("е",), "э": ("е",), "ю": ("у",), "у": ("ю",), "ы": ("и",)},
    exact={
        "фсе": ("все",), "щто": ("что",), "што": ("что",), "ыть": ("быть",), "эсть": ("есть",), "чтто": ("что",), "ччто": ("что",), "дэло": ("дело",), "ллет": ("лет",), "ууже": ("уже",),
        "паралон": ("поролон",), "координально": ("кардинально",), "расказать": ("рассказать",), "расчитать": ("рассчитать",), "железно-дорожный": ("железнодорожный",),
        "москва": ("Москва",), "президент": ("Президент",), "вуз": ("ВУЗ",),
    },
    substring={"тся": ("ться",), "ться": ("тся",), "ого": ("ово",), "его": ("ево",), "пре": ("при",), "при": ("пре",), "без": ("бес",), "бес": ("без",), "раз": ("рас",), "рас": ("раз",), "из": ("ис",), "ис": ("из",)},
    phrase={
        "также": ("так же",), "так же": ("также",), "чтобы": ("что бы",), "что бы": ("чтобы",), "зато": ("за то",), "за то": ("зато",), "причем": ("при чем",), "при чем": ("причем",), "притом": ("при том",),
        "при том": ("притом",), "вследствие": ("в следствие",), "в течение": ("в течении",), "в течении": ("в течение",), "по новому": ("по-новому",), "в виду": ("ввиду",), "мини футбол": ("мини-футбол",),
        "вобщем": ("в общем",), "вообщем": ("в общем",), "какбудто": ("как будто",), "почемуто": ("почему-то",), "потомучто": ("потому что",), "таккак": ("так как",), "несмотряна": ("несмотря на",), "изза": ("из-за",),
    },
    split_prefix_block=("само", "сверх", "пост", "супер", "тур", "мат", "зам", "зампред", "трехсот", "много", "спец", "гос", "авто", "кино", "фото", "радио", "теле", "евро", "мини", "микро"),
    split_pairs=(("из", "них"), ("в", "них"), ("к", "ним"), ("с", "ним"), ("тот", "же"), ("так", "же")),
    split_short_left=("в", "во", "к", "ко", "с", "со", "о", "об", "от", "из", "на", "по", "при", "за", "до"),
    split_short_right=("об", "от", "из", "их", "им", "ей", "её", "ее", "его", "же", "ли", "бы"),
    split_service_left=("не", "ни", "их"),
    split_service_right=("в", "во", "на", "не", "ни", "о", "об", "обо", "по", "за", "до", "к", "ко", "с", "со", "из", "от"),
    split_unsafe_left=("в", "во", "к", "ко", "с", "со", "о", "об", "у"),
    split_unsafe_right=("в", "к", "с", "о", "у"),
    split_endings=("ться", "тся", "ся"),
)

#: A neutral profile for Latin text: an alphabet, vowels and a keyboard, and no word lists.
LATIN = Profile(
    alphabet="abcdefghijklmnopqrstuvwxyz",
    consonants="bcdfghjklmnpqrstvwxz",
    vowels="aeiouy",
    keyboard_rows=("qwertyuiop", "asdfghjkl", "zxcvbnm"),
    char_confusions={"a": ("e",), "e": ("a", "i"), "i": ("e", "y"), "o": ("u",), "u": ("o",), "y": ("i",)},
)
