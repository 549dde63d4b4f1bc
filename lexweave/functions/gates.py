"""Word and punctuation gates: ordered rule chains over a wide row of a token, a candidate and their neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import profiles as P
from . import text as T


def ends_with(word: Column, endings: tuple[str, ...]) -> Column:
    return word.rlike(f"(?:{'|'.join(endings)})$")


def title(word: Column) -> Column:
    return T.is_upper(F.substring(word, 1, 1))


def pair_in(a: Column, b: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return F.concat_ws(" ", a, b).isin([" ".join(p) for p in pairs])


def adjective_like(norm: Column) -> Column:
    return (F.length(norm) >= 5) & ends_with(norm, P.ADJECTIVE_ENDINGS)


def finite_verb(norm: Column) -> Column:
    return (F.length(norm) >= 5) & ends_with(norm, P.VERB_ENDINGS)


def participle(norm: Column) -> Column:
    return ends_with(norm, P.PARTICIPLE_ENDINGS)


def protected_next(word: Column) -> Column:
    return (word != "") & (T.has_digit(word) | T.has_latin(word) | T.is_upper(word))


def looks_synthetic(word: Column) -> Column:
    """Two or more doubled letters, or a double that no word has (yo is folded first)."""
    norm = T.normalize_word(word)
    return (F.length(norm) >= 5) & ((F.regexp_count(norm, F.lit(r"(.)(?=\1)")) >= 2) | norm.rlike("|".join(P.FOREIGN_DOUBLES)))


def protected_source(word: Column, freq: Column) -> Column:
    """A word of the trusted lexicon that must not be changed."""
    return (freq > 0) & ~looks_synthetic(word) & (T.is_title(word) | (F.length(T.normalize_word(word)) >= 6) | (freq <= 3))


def entity_context(word: Column, prev: Column, following: Column) -> Column:
    before, after, norm = T.normalize_word(prev), T.normalize_word(following), T.normalize_word(word)
    near = T.is_title(word) & (T.is_title(prev) | T.is_title(following) | after.isin(*P.ENTITY_NEXT))
    return ((before == "по") & (norm == "словам")) | before.isin(*P.ENTITY_PREVIOUS) | near


def name_context(source: Column, prev: Column, following: Column) -> Column:
    return title(source) & (title(prev) | title(following))


def one_extra_letter(longer: Column, shorter: Column) -> Column:
    """`longer` is `shorter` with one letter put in."""
    return (F.length(longer) == F.length(shorter) + 1) & (F.levenshtein(longer, shorter, 1) == 1)


def letters(word: Column) -> Column:
    """The letters of a word in order of the alphabet, as two words that differ by a swap have the same: cheaper than to look for its place."""
    return F.sort_array(F.split(word, ""))


def transposed(a: Column, b: Column) -> Column:
    """Equal but for two neighbouring letters that changed places."""
    n = F.length(a)
    swap = F.exists(
        F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
        lambda i: (F.substring(a, F.lit(1), i - 1) == F.substring(b, F.lit(1), i - 1)) & (F.substring(a, i, F.lit(1)) == F.substring(b, i + 1, F.lit(1)))
        & (F.substring(a, i + 1, F.lit(1)) == F.substring(b, i, F.lit(1))) & (F.substring(a, i + 2, n) == F.substring(b, i + 2, n)),
    )
    return (n == F.length(b)) & (n >= 2) & (a != b) & (F.levenshtein(a, b, 2) == 2) & (letters(a) == letters(b)) & swap


def safe_edit_shape(a: Column, b: Column) -> Column:
    """Same first and last letter, and one letter put in, left out, changed, or two neighbours swapped."""
    ends = (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (F.substring(a, -1, 1) == F.substring(b, -1, 1))
    return (a != "") & (b != "") & ends & ((a != b) & (F.levenshtein(a, b, 1) == 1) | transposed(a, b))


def one_osa(a: Column, b: Column) -> Column:
    """Optimal string alignment distance of exactly 1."""
    return (a != b) & (F.coalesce(F.levenshtein(a, b, 1), F.lit(-1)) == 1) | transposed(a, b)


def first_swap(a: Column, b: Column) -> Column:
    """Where two words first differ, two neighbours changed places, and what follows is at optimal string alignment distance 1."""
    least = F.least(F.length(a), F.length(b))
    at = F.array_position(F.transform(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))), True).cast("int")
    crossed = (F.substring(a, at, F.lit(1)) == F.substring(b, at + 1, F.lit(1))) & (F.substring(a, at + 1, F.lit(1)) == F.substring(b, at, F.lit(1)))
    rest = [F.substring(w, at + 2, F.length(w)) for w in (a, b)]
    return (at > 0) & (at < least) & crossed & one_osa(*rest)


def two_osa(a: Column, b: Column) -> Column:
    """Optimal string alignment distance of exactly 2.

    Two edits without a swap are Levenshtein distance 2; of two edits with one, the swap is the first edit from the left or from the right.
    """
    far = first_swap(a, b) | first_swap(F.reverse(a), F.reverse(b))
    # Beside the swap one letter is put in, left out or changed, or none.
    like = F.levenshtein(F.array_join(letters(a), ""), F.array_join(letters(b), ""), 2) >= 0
    return F.coalesce(F.when(F.levenshtein(a, b, 2) == 2, ~transposed(a, b)).when((F.levenshtein(a, b, 4) >= 3) & like, far), F.lit(False))


def shape(source: Column, prev: Column, following: Column) -> dict[str, Column]:
    """What `word_reason` reads of a source and its neighbours alone."""
    return {"norm": T.normalize_word(source), "latin": T.has_latin(source), "upper": T.is_upper(source), "lower": F.lower(source) == source, "title": title(source), "named": name_context(source, prev, following)}


def word_reason(row: dict[str, Column], thresholds: dict[str, float], skip_context: bool = True, min_dictionary_score: float = 0.0, context_margin: Column | None = None) -> Column:
    """Why a candidate may not replace its source, '' if it may.

    `row`: source, text, cand_source, score, distance, rank, confidence, margin, prev, next, known, morph (is a word by morphology),
    same_lemma, protected, entity, left_known and right_known (whether what stands left and right of the dropped part of a glued word is known);
    what `shape` says of the source may be there too, where a source has many candidates.
    """
    g = row.__getitem__
    source, text, kind, score, distance, conf, margin, prev, following = (g(k) for k in ("source", "text", "cand_source", "score", "distance", "confidence", "margin", "prev", "next"))
    seen = {k: row.get(k, v) for k, v in shape(source, prev, following).items()}
    norm, cand = seen["norm"], T.normalize_word(text)
    n, rank = F.length(norm), F.greatest(g("rank"), F.lit(0))
    known, latin, upper, lower, titled_source, named = g("known") | g("morph"), seen["latin"], seen["upper"], seen["lower"], seen["title"], seen["named"]
    like, entity, protected = kind.isin(*P.DICTIONARY_LIKE), g("entity"), g("protected")
    two_words = F.contains(text, F.lit(" "))
    near = (distance == 1) | ((distance == 2) & (n >= 8))
    no_context = F.lit(context_margin is None)
    context = context_margin if context_margin is not None else F.lit(0.0)

    def dirty(short: bool, titled: bool) -> Column:
        base = ~known & ~protected & ~entity & ~two_words & ~latin & ~upper & (F.lit(short) | (n >= 5))
        if not titled:
            return base & lower
        return base & (lower | (titled_source & (prev == "") & ~named & title(text) & ~T.is_upper(text)))

    signal = ((conf >= 0.55) & (margin >= 0.10)) | (one_extra_letter(norm, cand) & (conf >= 0.45) & (margin >= 0.05))
    low_action = like & (rank == 0) & (norm != cand) & (n >= 5) & ~two_words & (score >= 1.2) & near & dirty(False, True) & ~g("same_lemma") & signal & safe_edit_shape(norm, cand)
    dirty_recovery = like & (rank <= 1) & (distance == 1) & (score >= 1.0) & (conf >= thresholds["action"]) & dirty(False, False)
    short = like & n.between(3, 4) & (rank <= 1) & (distance == 1) & (score >= 1.0) & (conf >= 0.95) & (margin >= 0.50) & (no_context | (context >= 0.50)) & dirty(True, True)
    low_score = like & (rank <= 1) & (score >= -1.5) & (conf >= 0.95) & (margin >= thresholds["action_margin"]) & near & (F.lit(skip_context) | (~no_context & (context >= 0.75))) & dirty(False, False)
    title_dictionary = like & (conf >= 0.995) & (F.lit(skip_context) | (~no_context & (context >= 0.75))) & ~named & ~entity & ~two_words & titled_source & ~upper & title(text) & ~T.is_upper(text)
    parts = F.split(text, " ")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    rest = F.substring(source, F.lit(2), F.length(source))
    title_split = (kind == "split") & (prev == "") & titled_source & ~upper & (F.lower(rest) == rest) & ~latin & ~T.has_latin(text) & (F.size(parts) == 2) & title(first) & ~T.is_upper(first) & (F.lower(second) == second)
    collapses = (following != "") & (cand == T.normalize_word(F.concat(source, following)))
    joining = F.concat_ws("|", norm, T.normalize_word(following), cand).isin(["|".join(x) for x in P.PHRASE_JOININGS])

    lexical = (
        F.when(entity, "entity_context_guard").when(protected, "protected_lexicon_word").when(like & drops_glued(norm, cand, two_words, g("left_known"), g("right_known")), "dictionary_drops_glued_service_token")
        .when((conf < thresholds["dictionary_action"]) & ~(dirty_recovery | short | low_action), "low_dictionary_confidence").when(like & (score < min_dictionary_score) & ~low_score, "low_dictionary_score")
        .when(like & (score < 1.0) & F.lit(not skip_context) & (no_context | (context < 0.50)) & ~low_score, "low_score_needs_context_margin").when(known, "known_or_dictionary_word")
        .when(like & (~lower | latin | upper) & ~(short | low_action | title_dictionary), "protected_word_shape").when((kind == "split") & (latin | upper | (~lower & ~title_split)), "protected_word_shape")
        .when((n < 5) & ~short, "too_short").when(like & ~near, "bad_dictionary_distance").when(g("same_lemma"), "same_lemma_inflection").otherwise("")
    )
    case_rule = (kind == "rule") & (source != text) & (norm == cand)
    rules = (
        F.when((conf < thresholds["rule_action"]) | latin | upper, "low_rule_confidence_or_shape")
        .when(case_rule, F.when((norm == "президент") & (text == "Президент") & ~T.normalize_word(following).isin(*P.PRESIDENT_NEXT), "president_case_context_guard").otherwise(""))
        .when(entity, "entity_context_guard").when(protected, "protected_lexicon_word").when((kind != "rule") & collapses & ~joining, "phrase_context_guard")
        .when((norm == "так") & (cand == "также") & (T.normalize_word(following) == "же"), "phrase_context_guard").when(named, "name_context_guard")
        .when(norm.endswith("ться") & cand.endswith("тся") & T.normalize_word(prev).isin(*P.INFINITIVE_CUES), "tsya_context_guard").otherwise("")
    )
    return (
        F.when((kind == "original") | (text == source), "same_as_source")
        .when(((conf < thresholds["action"]) | (margin < thresholds["action_margin"])) & ~low_action, "low_action_confidence_or_margin")
        .when(like | (kind == "split"), lexical).when(kind.isin("rule", "phrase", "phrase_safe"), rules).otherwise("unsupported_candidate_source")
    )


def glued_parts(norm: Column, cand: Column) -> tuple[Column, Column]:
    """(left, right) of a glued word of which `cand` is the start or else the end; nulls if neither."""
    front, back = norm.startswith(cand), norm.endswith(cand)
    rest = F.length(norm) - F.length(cand)
    left = F.when(front, cand).when(back, F.substring(norm, F.lit(1), rest))
    right = F.when(front, F.substring(norm, F.length(cand) + 1, rest)).when(back, cand)
    return left, right


def _service(left: Column, right: Column) -> tuple[Column, Column]:
    """Whether the left, or else the right, part of a glued word is a service word that may have been dropped."""
    return left.isin(*P.GLUED_SERVICE) & (F.length(left) >= 2) & (F.length(right) >= 3), right.isin(*P.GLUED_SERVICE) & (F.length(right) >= 2) & (F.length(left) >= 5)


def asked_part(norm: Column, cand: Column) -> Column:
    """The part of a glued word that `drops_glued` asks the lexicon for; null for nearly all."""
    left, right = glued_parts(norm, cand)
    first, second = _service(left, right)
    return F.when(first, right).when(second, left)


def drops_glued(norm: Column, cand: Column, two_words: Column, left_known: Column, right_known: Column) -> Column:
    left, right = glued_parts(norm, cand)
    doubled = (F.length(norm) >= 2) & (F.substring(norm, 1, 1) == F.substring(norm, 2, 1)) & (cand == F.substring(norm, F.lit(2), F.length(norm)))
    first, second = _service(left, right)
    pair = F.when(first, right_known).when(second, left_known).otherwise(False)
    return F.coalesce((norm != "") & (cand != "") & ~two_words & ~doubled & (F.length(cand) >= 5) & (F.length(norm) > F.length(cand)) & pair, F.lit(False))


def comma_delete_guard(word: Column, following: Column) -> Column:
    after = T.normalize_word(following)
    return (
        F.when(after == "", "").when(after.startswith("котор") | after.isin("что", "чтобы"), "comma_delete_clause_guard").when(after.isin(*P.INTRODUCTORY), "comma_delete_introductory_guard")
        .when(participle(after), "comma_delete_participle_guard").when(title(word) & title(following), "comma_delete_titlecase_list_guard").otherwise("")
    )


def comma_insert_guard(word: Column, following: Column) -> Column:
    w, after = T.normalize_word(word), T.normalize_word(following)
    about = ("о", "об", "обо")

    def both(words: str, nexts: str | tuple[str, ...]) -> Column:
        return w.isin(*words.split()) & after.isin(*(nexts.split() if isinstance(nexts, str) else nexts))

    fixed, argument, tail = "comma_insert_fixed_phrase_guard", "comma_insert_verb_argument_guard", "comma_insert_reporting_tail_guard"
    rules = [
        (after == "", ""), ((w == "того") & (after == "чтобы"), fixed), (T.has_latin(word) | T.has_digit(following), "comma_insert_protected_token_guard"),
        (after.startswith("котор") | after.isin("что", "чтобы"), ""), (title(word) & finite_verb(after), "comma_insert_subject_predicate_guard"),
        (w.isin(*P.REPORTED) & after.isin(*about, "ранее"), "comma_insert_after_reporting_verb_guard"), (w.isin("словам", "данным", "информации", "источника"), "comma_insert_source_phrase_guard"),
        (w.isin("того", "тому") & after.isin(*P.FIXED_NEXT), fixed), (after == "же", fixed), (pair_in(w, after, P.FIXED_PAIRS), fixed), (w.isin(*P.SPEECH_VERBS), argument),
        (both("заявил заявила заявили заявляет заявляют", "сегодня вчера ранее тогда"), tail), (both("добавил добавила добавили", "он она они"), tail),
        (both("напомнил напомнила напомнили", "ей ему им о об обо"), argument), (both("рассказал рассказала рассказали", "женам жене мужу детям ему ей им"), argument),
        (both("спросил спросила спросили", "у"), argument), (both("договорился договорилась договорились", about), argument), (after == "также", "comma_insert_before_takzhe_guard"),
        (after.isin(*P.PREPOSITIONS), "comma_insert_preposition_phrase_guard"), (adjective_like(after), "comma_insert_adjective_phrase_guard"),
        ((F.length(after) >= 5) & ends_with(after, ("ть", "ти")), "comma_insert_infinitive_argument_guard"), (after.startswith("друг"), "comma_insert_descriptor_guard"),
        (adjective_like(w) & (F.length(after) >= 4), "comma_insert_adjective_phrase_guard"), (ends_with(w, P.DESCRIPTOR_ENDINGS) & (F.length(after) >= 4), "comma_insert_descriptor_guard"),
    ]
    return reduce(lambda chain, rule: chain.when(*rule), rules[1:], F.when(*rules[0])).otherwise("")


def comma_recovery(word: Column, following: Column, is_final: Column, conf: Column, margin: Column) -> Column:
    """The reason why a comma may go below the usual thresholds, '' if there is none."""
    w, after, source = T.normalize_word(word), T.normalize_word(following), T.strip(word)
    day = F.when(w.rlike(r"^\d{1,9}$"), w.try_cast("int"))
    date = F.coalesce(day.between(1, 31), F.lit(False)) & after.isin(*P.MONTHS) & (conf >= 0.86) & (margin >= 0.70)
    return (
        F.when(is_final | (source == "О") | protected_next(following), "").when(date, "safe_date_comma_delete_recovery").when(~w.isin(*P.COMMA_SERVICE) | (after == ""), "")
        .when((conf >= 0.985) & (margin >= 0.95), "safe_comma_delete_recovery").when((F.lower(source) == source) & (conf >= 0.95) & (margin >= 0.90), "safe_service_comma_delete_recovery").otherwise("")
    )


def punctuation_reason(source: Column, predicted: Column, gap: Column, word: Column, following: Column, is_final: Column, conf: Column, margin: Column, thresholds: dict[str, float], protected: Column | None = None, mode: str = "conservative") -> Column:
    """The reason that decides about a predicted label; `punctuation_applies` tells which apply it."""
    delete, comma_delete, comma_insert = predicted == "", (source == ",") & (predicted == ""), (source == "") & (predicted == ",")
    guard_delete, guard_insert = comma_delete_guard(word, following), comma_insert_guard(word, following)
    recovery = comma_recovery(word, following, is_final, conf, margin)
    final_period = is_final & (predicted == ".") & source.isin("", ",") & (conf >= 0.82) & (margin >= 0.70)
    need = F.when(comma_delete, thresholds["comma_delete"]).when(delete, thresholds["punct_delete"]).otherwise(thresholds["punct"])
    need_margin = F.when(comma_delete, thresholds["comma_delete_margin"]).when(delete, thresholds["punct_delete_margin"]).otherwise(thresholds["punct_margin"])
    low = (conf < need) | (margin < need_margin)
    return (
        F.when(F.lit(mode != "conservative"), "mode_disabled").when(predicted == source, "same_as_source").when(~predicted.isin(*P.SIMPLE_LABELS, *P.STRUCTURAL_LABELS), "unsupported_punctuation")
        .when(protected if protected is not None else F.lit(False), "protected_gap").when(~T.trainable_gap(gap, word, following), "structural_gap")
        .when(is_final & predicted.isin(",", ":", ";", "—", ":—", ":«", ':"', "«", '"', "("), "final_non_terminal_punctuation").when(~is_final & predicted.isin(".", "?", "!"), "internal_sentence_end")
        .when(((source == ":") & (predicted == ";")) | ((source == ";") & (predicted == ":")), "structural_punctuation_swap_guard")
        .when(comma_delete & (guard_delete != ""), guard_delete).when(comma_insert & (guard_insert != ""), guard_insert)
        .when(low & comma_delete, F.when(recovery != "", recovery).otherwise("low_comma_delete_confidence_or_margin")).when(low & final_period, "safe_final_period_recovery").when(low, "low_confidence_or_margin")
        .when(is_final & source.isin(".", "!", "?") & delete, "final_punctuation_delete").when(is_final & (predicted != "") & ~predicted.rlike("[.?!]"), "final_non_terminal_punctuation")
        .when((source != "") & delete & protected_next(following), "delete_before_protected").otherwise("applied")
    )


def punctuation_applies(reason: Column) -> Column:
    return reason.isin("applied", "safe_final_period_recovery", "safe_comma_delete_recovery", "safe_date_comma_delete_recovery", "safe_service_comma_delete_recovery")
