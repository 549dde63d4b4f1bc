"""Tokenisation and scalar text projections as column functions (no Python runs on the data)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import profiles as P

LETTER = "A-Za-zА-Яа-яЁё"
WORD = rf"[{LETTER}]+(?:-[{LETTER}]+)*"
NUMBER = r"\p{Nd}+(?:[.,:/-]\p{Nd}+)*"
#: Words, numbers and single marks; the classes are spelt out so that both Spark and DuckDB agree.
TOKEN = rf"{WORD}|{NUMBER}|[^\p{{L}}\p{{N}}_\s]"
SLOT = rf"{WORD}|{NUMBER}"
SENTENCE = r"(?s).*?[.!?]+(?:(?U:\s)+|$)|.+$"
LINE = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
WHITE = r"(?U)\s+"


def char_class(chars: str, negate: bool = False) -> str:
    return "[" + "^" * negate + "".join("\\" + c if c in r"\[]^-&~" else c for c in chars) + "]"


def literal(column: Column, value: str) -> Column:
    return F.contains(column, F.lit(value))


def any_of(column: Column, chars: str) -> Column:
    return column.rlike(char_class(chars))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_word(token: Column) -> Column:
    return token.rlike(f"^(?:{WORD})$")


def has_digit(token: Column) -> Column:
    return token.rlike(r"\p{Nd}")


def token_kind(token: Column) -> Column:
    """word, number, punct or other."""
    return F.when(is_word(token), "word").when(has_digit(token), "number").when(token.rlike(f"^{char_class(P.PUNCT_CHARS)}*$"), "punct").otherwise("other")


def normalize_yo(text: Column) -> Column:
    return F.translate(text, "Ёё", "Ее")


def normalize_word(word: Column) -> Column:
    return F.lower(normalize_yo(word))


def external_text(text: Column) -> Column:
    """Yo folded, no-break spaces made spaces, white space stripped."""
    return strip(F.translate(normalize_yo(text), "\u00a0", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_spacing(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, "")


def word_tokens(text: Column, numbers: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(SLOT if numbers else WORD), F.lit(0))


def word_slots(text: Column) -> Column:
    """Words and numbers in order, each with the gap up to the next one (or the end).

    array<struct<word, gap, punct_after, next_word, prev_word, is_final>>; what stands before the first slot is `leading_gap`.
    """
    words, gaps = F.regexp_extract_all(text, F.lit(SLOT), F.lit(0)), F.split(text, SLOT, -1)

    def slot(x: Column) -> Column:
        gap = x["gap"]
        return F.struct(
            x["word"].alias("word"), gap.alias("gap"), F.regexp_replace(gap, char_class(P.PUNCT_CHARS, True), "").alias("punct_after"),
            F.coalesce(x["next"], F.lit("")).alias("next_word"), x["prev"].alias("prev_word"), x["next"].isNull().alias("is_final"),
        )

    # Zipped first: an array that a lambda refers to from outside is computed anew for every element.
    def zipped(w: Column) -> Column:
        rest = F.slice(w["w"], 2, 1 << 30)
        return F.arrays_zip(w["w"].alias("word"), F.slice(w["g"], 2, 1 << 30).alias("gap"), rest.alias("next"), F.concat(F.array(F.lit("")), w["w"]).alias("prev"))

    both = let(F.struct(words.alias("w"), gaps.alias("g")), zipped)
    return F.transform(F.filter(both, lambda x: x["word"].isNotNull()), slot)


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def leading_gap(text: Column) -> Column:
    return F.get(F.split(text, SLOT, 2), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces that end after `.`, `!` or `?` runs and the white space behind them; they join back to the text."""
    return F.when(text == "", F.array(F.lit(""))).when(~text.rlike(r"(?U)\S"), F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)))


def lines(text: Column) -> Column:
    """Lines as universal newlines and Unicode separators end them; no empty line after a final break."""
    parts = F.split(text, LINE, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def canonical_label(punct: Column) -> Column:
    """The trainable label of a gap's punctuation, or '' for none."""
    compact = F.replace(F.translate(without_spacing(F.coalesce(punct, F.lit(""))), "–", "—"), F.lit("…"), F.lit("..."))
    rule = F.when(compact.isin(*P.SIMPLE_LABELS, *P.STRUCTURAL_LABELS), compact).when(any_of(compact, P.STRUCTURAL_PUNCT), "")
    for mark in "?!.,:;":
        rule = rule.when(literal(compact, mark), mark)
    return rule.otherwise("")


def has_latin(text: Column) -> Column:
    return text.rlike("[A-Za-z]")


def is_upper(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_lower(text: Column) -> Column:
    return (F.lower(text) == text) & (F.upper(text) != text)


def is_title(word: Column) -> Column:
    """An upper-case first letter, but not all upper case."""
    return is_upper(F.substring(word, 1, 1)) & ~is_upper(word)


def untrainable(gap: Column) -> Column:
    return any_of(gap, "[]{}№/\\")


def structural_label(gap: Column) -> Column:
    return canonical_label(gap).isin(*P.STRUCTURAL_LABELS) & ~untrainable(gap)


def protected_gap(gap: Column, word: Column, next_word: Column) -> Column:
    """Whether a gap must be kept byte for byte: structural marks, abbreviations, initials, domains, figures."""
    norm, following = (F.regexp_replace(normalize_word(w), r"^\.+|\.+$", "") for w in (word, next_word))
    dot, colon = literal(gap, "."), literal(gap, ":")
    inside = (
        any_of(gap, P.STRUCTURAL_PUNCT)
        | (dot & norm.isin(*P.ABBREVIATIONS))
        | (dot & (F.length(word) == 1) & (is_upper(word) | has_latin(word)))
        | (dot & (has_latin(word) | has_latin(next_word)))
        | (dot & following.isin(*P.DOMAIN_ZONES))
        | (dot & has_digit(next_word))
        | (colon & (has_digit(word) | has_digit(next_word)))
        | (has_digit(word) & has_digit(next_word))
    )
    # Nearly all gaps are one space, of which only figures on both sides ask anything.
    return F.when(gap == "", False).when(gap == " ", has_digit(word) & has_digit(next_word)).otherwise(~structural_label(gap) & inside)


def gap_label(gap: Column, punct: Column, word: Column, next_word: Column) -> Column:
    """The label of a gap, '' where the gap is protected."""
    seen = F.when(gap == "", punct).otherwise(gap)
    label = canonical_label(seen)
    return F.when(seen.isin("", " "), "").when(label.isin(*P.STRUCTURAL_LABELS) & ~untrainable(seen), label).when(protected_gap(seen, word, next_word), "").otherwise(label)


def simple_gap(gap: Column) -> Column:
    return structural_label(gap) | ~gap.rlike(rf"(?U)[^\s{P.SIMPLE_PUNCT}]")


def trainable_gap(gap: Column, word: Column, next_word: Column) -> Column:
    return ~protected_gap(gap, word, next_word)


def render_gap(label: Column, is_final: Column) -> Column:
    """The text of a gap that carries `label`."""
    label = canonical_label(label)
    spaced = F.when(is_final, label).otherwise(F.concat(label, F.lit(" ")))
    return (
        F.when(label == "", F.when(is_final, "").otherwise(" "))
        .when(label == "—", F.when(is_final, " —").otherwise(" — "))
        .when(label == ":—", ": — ").when(label == ":«", ": «").when(label == ':"', ': "')
        .when(label.isin("«", '"', "("), F.when(is_final, label).otherwise(F.concat(F.lit(" "), label)))
        .otherwise(spaced)
    )


def normalize_spacing(text: Column) -> Column:
    text = strip(F.regexp_replace(text, WHITE, " "))
    text = F.regexp_replace(text, r"(?U)\s+([,.;:!?])", "$1")
    text = F.regexp_replace(text, rf"([,.;:!?])(?=[{LETTER}0-9])", "$1 ")
    text = F.regexp_replace(text, r"(?U)\s*([—–])\s*", " $1 ")
    return strip(F.regexp_replace(text, WHITE, " "))


def case_like(candidate: Column, source: Column) -> Column:
    """`candidate` in upper case, or with an upper-case first letter, if `source` is so."""
    first = F.concat(F.upper(F.substring(candidate, 1, 1)), F.substring(candidate, 2, 1 << 30))
    return F.when(is_upper(source), F.upper(candidate)).when(is_upper(F.substring(source, 1, 1)), first).otherwise(candidate)


def rebuild(words: Column, puncts: Column) -> Column:
    """Words with their punctuation, empty words left out, spacing normalised."""
    joined = F.filter(F.zip_with(words, puncts, lambda w, p: F.when(w != "", F.concat(w, F.coalesce(p, F.lit(""))))), lambda x: x.isNotNull())
    return normalize_spacing(F.array_join(joined, " "))


def rebuild_layout(text: Column, slots: Column, words: Column, labels: Column | None = None, source_labels: Column | None = None, mode: str = "conservative", rewrite: Column | None = None) -> Column:
    """`text` with slot words replaced and every gap kept byte for byte, unless its label changed and it is trainable.

    `words`, `labels` and `source_labels` are arrays beside `slots`; `rewrite` lists slots whose gap is rendered anyway.
    """

    def part(x: Column, i: Column) -> Column:
        slot, word = x["slot"], F.coalesce(x["new"], F.lit(""))
        gap = slot["gap"]
        if labels is None or mode != "conservative":
            return F.concat(word, gap)
        own = x["own"] if source_labels is not None else gap_label(gap, slot["punct_after"], slot["word"], slot["next_word"])
        changed = x["label"] != own
        if rewrite is not None:
            changed = changed | F.array_contains(rewrite, i)
        return F.concat(word, F.when(changed & trainable_gap(gap, slot["word"], slot["next_word"]), render_gap(x["label"], slot["is_final"])).otherwise(gap))

    # Zipped first, as in `word_slots`: each array is computed once and not for every slot.
    beside = {"new": words, "label": labels, "own": source_labels}
    zipped = F.arrays_zip(slots.alias("slot"), *(F.coalesce(v, F.array().cast("array<string>")).alias(k) for k, v in beside.items() if v is not None))
    parts = F.transform(F.filter(zipped, lambda x: x["slot"].isNotNull()), part)
    rebuilt = F.when(F.size(slots) == 0, text).otherwise(F.concat(leading_gap(text), F.array_join(parts, "")))
    return normalize_spacing(rebuilt) if mode == "legacy" else rebuilt


def protected_values(text: Column) -> Column:
    """Urls, addresses, Latin identifiers, numbers and capitals, which a correction must not change."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.-]+|[A-Za-z][A-Za-z0-9._/-]*|\b\d[\d.,:/-]*\b|[A-ZА-ЯЁ]{2,})"), F.lit(0))


def only(text: Column, chars: str) -> Column:
    return F.regexp_replace(text, char_class(chars, True), "")


def count_of(text: Column, value: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(value), F.lit("")))


def case_signature(text: Column) -> Column:
    """U, L or O for each character."""
    classed = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?s)[^\p{Lu}\p{Ll}]", "0"), r"\p{Ll}", "1"), r"\p{Lu}", "2")
    return F.translate(classed, "012", "OLU")


def labels_of(types: Column) -> Column:
    """The labels of a `|` or `,` delimited string, trimmed, duplicates kept; 'unknown' if there is none."""
    found = F.filter(F.transform(F.split(F.coalesce(types, F.lit("")), "[|,]", -1), strip), lambda x: x != "")
    return F.when(F.size(found) == 0, F.array(F.lit("unknown"))).otherwise(found)


def candidate_list(values: Column) -> Column:
    kept = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(kept) == 0, F.array(F.lit(""))).otherwise(kept)


def replace_rank(action: Column) -> Column:
    """The rank in REPLACE_n; REPLACE is rank 0, anything else null."""
    return F.when(action == "REPLACE", 0).when(action.startswith("REPLACE_"), F.substring(action, 9, 32).try_cast("int"))


def replace_action(rank: Column) -> Column:
    return F.concat(F.lit("REPLACE_"), rank.cast("string"))


def raw_spacing(text: Column) -> Column:
    """Spaces missing before dates, years and capitals are put in."""
    months = "января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря"
    text = F.regexp_replace(strip(text), rf"(?iuU)([.!?])(?=\d{{1,2}}\s+(?:{months})\b)", "$1 ")
    text = F.regexp_replace(text, r"(?U)([.!?])(?=\d{4}\b)", "$1 ")
    text = F.regexp_replace(text, r"(?U)(\b\d{4})(?=[A-ZА-ЯЁ])", "$1 ")
    return F.regexp_replace(text, r"([.!?])(?=[A-ZА-ЯЁ])", "$1 ")


def prompt(text: Column, template: str) -> Column:
    """The text in a prompt: in place of `{text}`, or after it."""
    return F.replace(F.lit(template), F.lit("{text}"), text) if "{text}" in template else F.concat(F.lit(template), text)


def generated(text: Column, source: Column, special: str = r"<[^<>\s]+>", marker: str | None = None) -> Column:
    """Model output without special tokens, cut after `marker`, white space collapsed; the source where nothing is left."""
    text = F.regexp_replace(text, special, " ")
    if marker:
        text = F.coalesce(F.get(F.split(text, re.escape(marker), 2), F.lit(1)), text)
    text = strip(F.regexp_replace(text, WHITE, " "))
    return F.when(text == "", source).otherwise(text)
