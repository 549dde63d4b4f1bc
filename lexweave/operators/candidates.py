"""Spelling candidates: one stage for each source, merged, scored and ranked for every distinct word.

Candidates of equal score keep the order in which the stages and the edits within them come; `ord` carries it.  Every stage is computed for
distinct normalised words and joined with the lexicon by equality.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.profiles import RU, SOURCE_BOOSTS, Profile
from . import fuzzy
from .lexicon import ranked_by_length

STAGES = ("rule", "mined", "orthographic", "keyboard", "dictionary", "long", "split")


def _ord(stage: str, *parts: Column | int) -> Column:
    parts = [*parts, *[0] * (3 - len(parts))]
    return F.array(*(p.cast("int") if isinstance(p, Column) else F.lit(p) for p in (STAGES.index(stage), *parts))).alias("ord")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv)) if values else F.create_map().cast("map<string,string>")


def _rows(words: DataFrame, items: Column) -> DataFrame:
    """(norm, cand, source, distance, ord) from an array<struct<cand, source, ord>>."""
    return words.select("norm", F.explode(items).alias("x")).select("norm", "x.cand", "x.source", F.lit(1).alias("distance"), "x.ord")


def _seq(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def _with(word: Column, at: Column, length: int, new: Column) -> Column:
    """`word` with `length` characters from place `at` (from 1) replaced."""
    return F.concat(F.substring(word, F.lit(1), at - 1), new, F.substring(word, at + length, F.length(word)))


def rules(words: DataFrame, lex: DataFrame, profile: Profile, doubled_first: bool = True) -> DataFrame:
    """Word lists, a doubled first letter of a short word (if `doubled_first`), and substring swaps at every place."""
    norm, n = F.col("norm"), F.length("norm")
    parts = []
    for i, (table, source) in enumerate(((profile.exact, "rule"), (profile.phrase, "phrase_safe"))):
        if not table:
            continue
        found = F.split(_map({k: "\x1f".join(v) for k, v in table.items()})[norm], "\x1f")
        parts.append(_rows(words, F.transform(found, _listed(i, source))))
    doubled = words.filter(F.lit(doubled_first) & n.between(4, 5) & (F.substring(norm, 1, 1) == F.substring(norm, 2, 1))).select("norm", F.substring(norm, 2, 9).alias("cand"))
    doubled = doubled.join(lex.select(F.col("norm").alias("cand")), "cand", "left_semi")
    parts.append(doubled.select("norm", "cand", F.lit("rule").alias("source"), F.lit(1).alias("distance"), _ord("rule", 2)))
    for k, (key, values) in enumerate(profile.substring.items()):
        for value in values:
            parts.append(_rows(words, F.transform(F.filter(_seq(n - len(key) + 1), _begins(norm, key)), _swapped(norm, key, value, k))))
    return reduce(DataFrame.unionByName, parts)


def _listed(i: int, source: str):
    return lambda c, j: F.struct(c.alias("cand"), F.lit(source).alias("source"), _ord("rule", i, j))


def _begins(norm: Column, key: str):
    return lambda i: F.substring(norm, i, F.lit(len(key))) == key


def _swapped(norm: Column, key: str, value: str, k: int):
    return lambda i: F.struct(_with(norm, i, len(key), F.lit(value)).alias("cand"), F.lit("orthographic").alias("source"), _ord("rule", 3 + k, i))


def orthographic(words: DataFrame, profile: Profile) -> DataFrame:
    """Letters often mistaken, a consonant doubled, a double consonant made single."""
    norm, n = F.col("norm"), F.length("norm")
    letter = lambda i: F.substring(norm, i, F.lit(1))
    others = _map({k: "".join(v) for k, v in profile.char_confusions.items()})
    consonant = lambda c: F.contains(F.lit(profile.consonants), c)
    made = lambda cand, kind, i, j=0: F.struct(cand.alias("cand"), F.lit("orthographic").alias("source"), _ord("orthographic", kind, i, j))
    swapped = F.flatten(F.transform(_seq(n), lambda i: F.transform(F.filter(F.split(F.coalesce(others[letter(i)], F.lit("")), ""), lambda c: c != ""), lambda c, j: made(_with(norm, i, 1, c), 0, i, j))))
    doubled = F.transform(F.filter(_seq(n), lambda i: consonant(letter(i))), lambda i: made(_with(norm, i, 0, letter(i)), 1, i))
    single = F.transform(F.filter(_seq(n - 1), lambda i: consonant(letter(i)) & (letter(i) == letter(i + 1))), lambda i: made(_with(norm, i, 1, F.lit("")), 2, i))
    return _rows(words, F.concat(swapped, doubled, single))


def keyboard(words: DataFrame, profile: Profile) -> DataFrame:
    """A letter replaced by a neighbour on the keyboard."""
    norm, near = F.col("norm"), _map(profile.neighbours())
    made = lambda i: F.transform(F.filter(F.split(F.coalesce(near[F.substring(norm, i, F.lit(1))], F.lit("")), ""), lambda c: c != ""), lambda c, j: F.struct(_with(norm, i, 1, c).alias("cand"), F.lit("keyboard").alias("source"), _ord("keyboard", i, j)))
    return _rows(words, F.flatten(F.transform(_seq(F.length("norm")), made)))


def _edit(norm: Column, cand: Column, profile: Profile) -> tuple[Column, Column, Column]:
    """(kind, at, letter) of the one edit between two words: 0 a letter left out, 1 put in, 2 changed, 3 swapped with the next; `letter` is 0 if it is not of the alphabet."""
    n, m = F.length(norm), F.length(cand)
    cut = lambda w, k: F.transform(_seq(k), lambda i: _with(w, i, 1, F.lit("")))
    removed = F.array_position(cut(norm, n), cand)
    added = F.array_position(cut(cand, m), norm)
    differs = F.array_position(F.transform(_seq(n), lambda i: F.substring(norm, i, F.lit(1)) != F.substring(cand, i, F.lit(1))), True)
    swapped = F.levenshtein(norm, cand) == 2
    at = F.when(m < n, removed).when(m > n, added).otherwise(differs)
    letter = F.when((m > n) | ((m == n) & ~swapped), F.position(F.substring(cand, at.cast("int"), F.lit(1)), F.lit(profile.alphabet))).otherwise(1)
    return F.when(m < n, 0).when(m > n, 1).when(swapped, 3).otherwise(2), at, letter


def dictionary(words: DataFrame, lex: DataFrame, profile: Profile) -> DataFrame:
    """Known words one edit away; letters put in or changed must be of the alphabet."""
    pairs = fuzzy.within_one(words.select("norm"), lex.select(F.col("norm").alias("cand")))
    kind, at, letter = _edit(F.col("norm"), F.col("cand"), profile)
    return pairs.filter(letter > 0).select("norm", "cand", F.lit("dictionary").alias("source"), F.lit(1).alias("distance"), _ord("dictionary", kind, at, letter))


def near_words(norms: DataFrame, lex: DataFrame, profile: Profile, include_known: bool, long_oov: bool, doubled_first: bool) -> DataFrame:
    """What `orthographic`, `keyboard`, `dictionary`, `long_words` (if `long_oov`) and the rule of a doubled first letter make of `norms` (norm), known words only, with freq.

    All but the long ones are one edit away, so one join with the lexicon finds them; which stages make a pair is read off its edit.
    """
    norm, cand, n = F.col("norm"), F.col("cand"), F.length("norm")
    rows = norms.join(lex.select("norm", F.lit(True).alias("_known")), "norm", "left").select("norm", F.col("_known").isNull().alias("unknown"))
    asked = (F.lit(include_known) | F.col("unknown")) & (n >= profile.min_dictionary_length)
    doubled = F.lit(doubled_first) & n.between(4, 5) & (F.substring(norm, 1, 1) == F.substring(norm, 2, 1))
    rows = rows.withColumn("first", ~(F.col("unknown") | asked)).filter(~F.col("first") | doubled).withColumn("long", F.lit(long_oov) & asked & (n >= profile.long_length))
    if long_oov:
        place = F.col("bucket_rank")
        known = ranked_by_length(lex, None).select(norm.alias("cand"), "freq", F.when((place <= min(profile.bucket, profile.long_bucket)) & (n >= profile.long_length - 2), place).alias("place"))
    else:
        known = lex.select(norm.alias("cand"), "freq", F.lit(None).cast("int").alias("place"))
    pairs = fuzzy.near(rows, known.withColumn("top", F.col("place").isNotNull()))
    kind, at, letter = _edit(norm, cand, profile)
    pairs = pairs.withColumns({"_kind": F.when(F.col("distance") == 1, kind), "_at": F.when(F.col("distance") == 1, at).cast("int"), "_letter": F.when(F.col("distance") == 1, letter)})
    kind, at, letter = (F.col(c) for c in ("_kind", "_at", "_letter"))
    own, new = F.substring(norm, at, F.lit(1)), F.substring(cand, at, F.lit(1))
    place = lambda values: F.position(new, F.coalesce(_map(values)[own], F.lit("")))
    confused, beside = place({k: "".join(v) for k, v in profile.char_confusions.items()}), place(profile.neighbours())
    item = lambda when, source, order: F.when(when, F.struct(F.lit(source).alias("source"), order))
    consonant = F.contains(F.lit(profile.consonants), own)
    items = [
        item(doubled & (cand == F.substring(norm, F.lit(2), n)), "rule", _ord("rule", 2)),
        item(F.col("unknown") & (kind == 2) & (confused > 0), "orthographic", _ord("orthographic", 0, at, confused - 1)),
        item(F.col("unknown") & (kind == 1) & (own == new) & consonant, "orthographic", _ord("orthographic", 1, at)),
        item(F.col("unknown") & (kind == 0) & (own == F.substring(norm, at + 1, F.lit(1))) & consonant, "orthographic", _ord("orthographic", 2, at)),
        item(F.col("unknown") & (kind == 2) & (beside > 0), "keyboard", _ord("keyboard", at, beside - 1)),
        item(asked & (letter > 0), "dictionary", _ord("dictionary", kind, at, letter)),
        item(F.col("distance") == 2, "dictionary", _ord("long", F.length(cand), F.col("place"))),
    ]
    made = pairs.select("norm", "cand", "distance", "freq", F.explode(F.array_compact(F.array(*items))).alias("x"))
    return made.select("norm", "cand", "x.source", "distance", "x.ord", "freq")


def long_words(words: DataFrame, ranked: DataFrame, profile: Profile) -> DataFrame:
    """Frequent words two edits away from long words."""
    top = ranked.filter(F.col("bucket_rank") <= profile.long_bucket).select(F.col("norm").alias("cand"), "bucket_rank")
    pairs = fuzzy.within_two(words.filter(F.length("norm") >= profile.long_length).select("norm"), top.select("cand").filter(F.length("cand") >= profile.long_length - 2))
    return pairs.join(top, "cand").select("norm", "cand", F.lit("dictionary").alias("source"), "distance", _ord("long", F.length("cand"), F.col("bucket_rank")))


def allowed_pair(left: Column, right: Column, left_known: Column, right_known: Column, profile: Profile) -> Column:
    """Whether a service word may be split off."""
    n, m = F.length(left), F.length(right)
    listed = F.concat_ws(" ", left, right).isin([" ".join(p) for p in profile.split_pairs] or ["\0"])
    has = lambda c, values: c.isin(list(values) or ["\0"])
    free = (has(left, profile.split_service_left) & (m >= 5) & right_known) | (has(right, profile.split_service_right) & (n >= 5) & left_known)
    free = free | (has(left, profile.split_short_left) & (m >= 3) & right_known) | (has(right, profile.split_short_right) & (n >= 3) & left_known)
    return listed | (~has(left, profile.split_prefix_block) & free)


def split_points(words: DataFrame, lex: DataFrame, profile: Profile) -> DataFrame:
    """Every way to write a word as two, with what is known of the parts: (norm, at, left, right, left_known, right_known, allowed, unsafe)."""
    points = words.filter(F.length("norm") >= 4).select("norm", F.explode(F.sequence(F.lit(1), F.length("norm") - 2)).alias("at"))
    points = points.select("norm", "at", F.expr("substring(norm, 1, at)").alias("left"), F.expr("substring(norm, at + 1)").alias("right"))
    for side in ("left", "right"):
        points = points.join(lex.select(F.col("norm").alias(side), F.lit(True).alias(f"{side}_known")), side, "left").withColumn(f"{side}_known", F.coalesce(f"{side}_known", F.lit(False)))
    left, right = F.col("left"), F.col("right")
    has = lambda c, values: c.isin(list(values) or ["\0"])
    vowel = F.contains(F.lit(profile.vowels), F.substring(right, 1, 1))
    unsafe = (has(left, profile.split_unsafe_left) & ((F.length(right) < 5) | vowel)) | (has(right, profile.split_unsafe_right) & (F.length(left) < 5))
    listed = F.concat_ws(" ", left, right).isin([" ".join(p) for p in profile.split_pairs] or ["\0"])
    return points.withColumns({"allowed": allowed_pair(left, right, F.col("left_known"), F.col("right_known"), profile), "unsafe": unsafe & ~listed})


def safe_splits(words: DataFrame, lex: DataFrame, profile: Profile) -> DataFrame:
    """Two-word candidates of words that do not end like a reflexive verb or begin with a doubled letter of a known word."""
    doubled = words.filter(F.substring("norm", 1, 1) == F.substring("norm", 2, 1)).select("norm", F.expr("substring(norm, 2)").alias("_rest")).join(lex.select(F.col("norm").alias("_rest")), "_rest", "left_semi").select("norm")
    ending = F.col("norm").rlike(f"(?:{'|'.join(profile.split_endings)})$") if profile.split_endings else F.lit(False)
    points = split_points(words.filter(~ending & ~T.has_digit(F.col("norm"))).join(doubled, "norm", "left_anti"), lex, profile)
    left, right = F.col("left"), F.col("right")
    plain = (F.length(left) >= 3) & (F.length(right) >= 3) & ~left.isin(list(profile.split_prefix_block) or ["\0"]) & ~right.isin("ся", "сь") & F.col("left_known") & F.col("right_known")
    kept = points.filter(~F.col("unsafe") & (F.col("allowed") | plain))
    return kept.select("norm", F.concat_ws(" ", left, right).alias("cand"), F.lit("split").alias("source"), F.lit(1).alias("distance"), _ord("split", F.col("at")), "allowed")


def candidates(words: DataFrame, lex: DataFrame, profile: Profile = RU, top: int = 8, min_freq: int = 1, split: bool = False, mined: DataFrame | None = None, include_known: bool = False, long_oov: bool = True, doubled_first: bool = True) -> DataFrame:
    """(word, norm, text, score, source, distance, rank): the `top` candidates of each distinct word of `words` (word).

    Rules hold for any word; everything else for words that the lexicon does not know, dictionary candidates for known words too if
    `include_known`.  Words under three letters or with digits have none.
    """
    # That words are not null is said everywhere alike, so that Spark computes the words and the lexicon once for all their uses.
    lex = lex.filter((F.col("freq") >= min_freq) & F.col("norm").isNotNull())
    cased = words.select("word").distinct().withColumn("norm", T.normalize_word(F.col("word"))).filter(F.col("norm").isNotNull() & (F.length("norm") >= 3) & ~T.has_digit(F.col("norm")))
    norms = cased.groupBy("norm").agg(F.count("*").alias("_n")).filter("_n > 0").select("norm")
    near = near_words(norms, lex, profile, include_known, long_oov, doubled_first)
    scored = near.select("norm", "cand", "source", "distance", "ord", F.lit(False).alias("allowed"), F.log1p("freq").alias("base"), F.col("freq").alias("least"))
    parts = []
    if profile.exact or profile.phrase or profile.substring:
        parts.append(rules(norms, lex, profile, doubled_first=False))
    unknown = norms.join(lex.select("norm"), "norm", "left_anti")
    if mined is not None:
        parts.append(unknown.join(mined.select(F.col("source").alias("norm"), F.col("target").alias("cand"), "place"), "norm").select("norm", "cand", F.lit("mined").alias("source"), F.lit(1).alias("distance"), _ord("mined", F.col("place"))))
    parts = [p.withColumn("allowed", F.lit(False)) for p in parts]
    if split:
        # Only words in lower case, or with a capital first letter, are split.
        plain = cased.filter((F.lower("word") == F.col("word")) | (T.is_title(F.col("word")) & (F.lower(F.expr("substring(word, 2)")) == F.expr("substring(word, 2)")))).filter(~T.has_latin(F.col("word"))).select("norm").distinct()
        parts.append(safe_splits(plain.join(unknown, "norm", "left_semi"), lex, profile))
    if parts:
        made = reduce(DataFrame.unionByName, parts)
        parts_of = made.filter(F.col("cand") != "").withColumn("_p", F.explode(F.split("cand", " "))).withColumn("_n", T.normalize_word(F.col("_p")))
        freq = parts_of.join(lex.select(F.col("norm").alias("_n"), "freq"), "_n", "left")
        whole = freq.groupBy("norm", "cand", "source", "distance", "ord", "allowed").agg(F.sum(F.log1p(F.coalesce("freq", F.lit(0)))).alias("base"), F.min(F.coalesce("freq", F.lit(0))).alias("least"))
        scored = scored.unionByName(whole.filter(F.col("source").isin("rule", "phrase_safe") | F.col("allowed") | (F.col("least") >= min_freq)))
    boost = _map({k: str(v) for k, v in SOURCE_BOOSTS.items()})[F.col("source")].cast("double")
    score = F.col("base") - 2.0 * F.col("distance") + boost + F.when(F.col("allowed"), 3.0).otherwise(0.0)
    if mined is not None:
        counts = mined.select(F.col("source").alias("norm"), F.col("target").alias("cand"), F.lit("mined").alias("source"), F.col("count").alias("_count"))
        scored = scored.join(counts, ["norm", "cand", "source"], "left")
        score = score + 0.5 * F.log1p(F.coalesce("_count", F.lit(0)))
    scored = scored.withColumn("score", score)
    rows = cased.join(scored, "norm").withColumn("text", T.case_like(F.col("cand"), F.col("word")))
    merged = rows.groupBy("word", "norm", "text").agg(F.min("ord").alias("ord"), F.max_by(F.struct("source", "distance"), F.struct("score", F.transform("ord", lambda x: -x))).alias("b"), F.max("score").alias("score"))
    merged = merged.filter(F.col("text") != F.col("word"))
    order = Window.partitionBy("word").orderBy(F.desc("score"), "ord")
    return merged.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < top).select("word", "norm", "text", "score", "b.source", "b.distance", "rank")


def blocked_splits(words: DataFrame, lex: DataFrame, profile: Profile) -> DataFrame:
    """(norm, blocked): how many ways to split each word the rules refuse as unsafe; a doubled first letter of a known word refuses it once."""
    letters = words.filter((F.length("norm") >= 4) & ~T.has_digit(F.col("norm")))
    if profile.split_endings:
        letters = letters.filter(~F.col("norm").rlike(f"(?:{'|'.join(profile.split_endings)})$"))
    rest = letters.filter(F.substring("norm", 1, 1) == F.substring("norm", 2, 1)).select("norm", F.expr("substring(norm, 2)").alias("_rest"))
    doubled = rest.join(lex.select(F.col("norm").alias("_rest")), "_rest", "left_semi").select("norm", F.lit(1).cast("long").alias("blocked"))
    points = split_points(letters.join(doubled, "norm", "left_anti"), lex, profile)
    return points.groupBy("norm").agg(F.count_if("unsafe").alias("blocked")).unionByName(doubled)


def best(found: DataFrame, least: float = 0.0) -> DataFrame:
    """The first candidate of each word, if its score is at least `least`."""
    return found.filter((F.col("rank") == 0) & (F.col("score") >= least))


def should_check(words: DataFrame, lex: DataFrame, profile: Profile = RU, min_freq: int = 1, doubled_first: bool = True) -> DataFrame:
    """`words` (word) with checked: words of three letters or more that the lexicon does not know or that a rule is for (`doubled_first`: as in `rules`)."""
    norm = T.normalize_word(F.col("word"))
    rows = words.withColumns({"_norm": norm, "_rest": F.when(F.lit(doubled_first) & F.length(norm).between(4, 5) & (F.substring(norm, 1, 1) == F.substring(norm, 2, 1)), F.substring(norm, F.lit(2), F.length(norm)))})
    known = lex.filter(F.col("freq") >= min_freq).select("norm")
    rows = rows.join(known.select(F.col("norm").alias("_norm"), F.lit(True).alias("_known")), "_norm", "left").join(known.select(F.col("norm").alias("_rest"), F.lit(True).alias("_doubled")), "_rest", "left")
    listed = F.col("_norm").isin([*profile.exact, *profile.phrase] or ["\0"])
    holds = F.col("_norm").rlike("|".join(profile.substring)) if profile.substring else F.lit(False)
    rule = listed | F.coalesce("_doubled", F.lit(False)) | holds
    asked = (F.length("_norm") >= 3) & ~T.has_digit(F.col("_norm")) & T.is_word(F.col("word")) & (F.col("_known").isNull() | rule)
    return rows.withColumn("checked", asked).select(*words.columns, "checked")
