"""Training tables: eligible words, hard negatives, ranked candidates for labels, KEEP augmentation, audits of clean text, the corpus build.

Every search is done once for each distinct word and joined back; choices are taken from hashes of the row's key and the word's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gates as G
from ..functions import text as T
from ..plans.profiles import RU, Profile
from . import inject, splits
from .candidates import candidates, dictionary
from .inject import share

# Parts of foreign names.
FOREIGN_PARTS = ("делла", "де", "ди", "фон", "ван", "дер", "ле", "ла", "аль", "ибн")
#: A dictionary score under which a candidate is weak.
WEAK = 0.25


def eligible(word: Column, profile: Profile = RU) -> Column:
    """A word in lower case of five letters or more, all of the profile's script."""
    foreign = "[A-Za-z]" if "а" in profile.alphabet else "[А-Яа-яЁё]"
    return (F.length(T.normalize_word(word)) >= 5) & T.is_word(word) & (F.lower(word) == word) & ~T.is_upper(word) & ~word.rlike(foreign)


def clean_noise(word: Column, morph: Column, profile: Profile = RU) -> Column:
    """An eligible word that is no part of a foreign name and no word by morphology."""
    return eligible(word, profile) & ~T.normalize_word(word).isin(*FOREIGN_PARTS) & ~morph


def hard_negatives(words: DataFrame, lex: DataFrame, profile: Profile = RU, same_lemma: DataFrame | None = None, least: float = WEAK, min_freq: int = 1) -> DataFrame:
    """(norm, text, score, distance, same_lemma): for each eligible word the known word one edit away that is hardest to tell from it.

    Another form of the same word (`same_lemma`: a, b) comes first, then weak candidates, then the best score, then the order of edits.
    """
    known = lex.filter(F.col("freq") >= min_freq)
    asked = words.filter(eligible(F.col("word"), profile)).select(T.normalize_word(F.col("word")).alias("norm")).distinct()
    found = dictionary(asked, known, profile).filter("cand <> norm").join(known.select(F.col("norm").alias("cand"), "freq"), "cand")
    if same_lemma is not None:
        pairs = same_lemma.select(F.col("a").alias("norm"), F.col("b").alias("cand"), F.lit(True).alias("same_lemma")).distinct()
        found = found.join(pairs, ["norm", "cand"], "left").withColumn("same_lemma", F.coalesce("same_lemma", F.lit(False)))
    else:
        found = found.withColumn("same_lemma", F.lit(False))
    found = found.withColumn("score", F.log1p("freq") - 2.0)
    order = F.struct((~F.col("same_lemma")).alias("a"), (F.col("score") >= least).alias("b"), (-F.col("score")).alias("c"), "ord")
    return found.groupBy("norm").agg(F.min_by(F.struct(F.col("cand").alias("text"), "score", "distance", "same_lemma"), order).alias("x")).select("norm", "x.*")


def tokens_of(examples: DataFrame, key: str) -> DataFrame:
    """(key, is_clean, pos, source, candidates, action, source_punct, target_punct, target): one row for each token of aligned examples."""
    # An outer generator keeps the optimiser from asking for the examples twice, once to tell which are null.
    rows = examples.select(key, "is_clean", F.posexplode_outer("example").alias("pos", "e")).filter("pos is not null")
    return rows.select(key, "is_clean", "pos", "e.*")


def all_words(examples: DataFrame, key: str) -> DataFrame:
    """(word): every source word and candidate text of the examples, repeats kept."""
    return tokens_of(examples, key).select(F.explode(F.concat(F.array("source"), "candidates")).alias("word"))


def top_candidates(examples: DataFrame, lex: DataFrame, key: str, profile: Profile = RU, k: int = 16) -> DataFrame:
    """(key, is_clean, pos, source, target, candidates, action, rank, hit, injected): tokens with generated candidates and labels by their rank.

    A token that is replaced takes the rank of its target among the first `k` candidates.  A target that was not generated is put behind
    them, or in the last place: as a hit if the source is an unknown long word at most two edits away, as an injected one otherwise.  Tokens without
    candidates keep their own.
    """
    rows = tokens_of(examples, key)
    found = candidates(rows.select(F.col("source").alias("word")).distinct(), lex, profile, k, long_oov=False)
    found = found.filter(T.normalize_word(F.col("text")) != F.col("norm"))
    lists = found.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda c: c["text"]).alias("items"))
    norm, goal = T.normalize_word(F.col("source")), T.normalize_word(F.col("target"))
    rows = rows.join(lists, rows["source"] == lists["word"], "left").drop("word").join(lex.select(F.col("norm").alias("_n"), F.lit(True).alias("known")), norm == F.col("_n"), "left")
    rows = rows.withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    replaced = T.replace_rank(F.col("action")).isNotNull() & (F.col("target") != "")
    at = F.array_position(F.transform("items", T.normalize_word), goal).cast("int") - 1
    close = (norm == goal) | G.one_osa(norm, goal) | G.two_osa(norm, goal)
    long_word = F.col("known").isNull() & (F.length(norm) >= profile.long_length) & (F.abs(F.length(norm) - F.length(goal)) <= 2) & close
    rows = rows.withColumns({"_replaced": replaced, "_at": F.when(replaced, at)})
    rows = rows.withColumns({"hit": F.coalesce(F.col("_replaced") & ((F.col("_at") >= 0) | long_word), F.lit(False)), "_missing": F.coalesce(F.col("_replaced") & (F.col("_at") < 0), F.lit(False))})
    room = F.size("items") < k
    items = F.when(F.col("_missing"), F.when(room, F.concat("items", F.array("target"))).otherwise(F.concat(F.slice("items", 1, k - 1), F.array("target")))).otherwise(F.col("items"))
    rank = F.when(F.col("_missing"), F.least(F.size("items"), F.lit(k - 1))).when(F.col("_replaced"), F.col("_at")).otherwise(-1)
    rows = rows.withColumns({"rank": rank, "injected": F.col("_missing") & ~F.col("hit"), "_items": items})
    own = T.candidate_list(F.col("candidates"))
    return rows.select(
        key, "is_clean", "pos", "source", "target", F.slice(F.when(F.size("_items") == 0, own).otherwise(F.col("_items")), 1, k).alias("candidates"),
        F.when(F.col("_replaced"), T.replace_action(F.col("rank"))).otherwise(F.col("action")).alias("action"), "rank", "hit", "injected",
    )


def candidate_statistics(tokens: DataFrame) -> DataFrame:
    """One row: tokens, replaced tokens, hits, injected targets, the share of hits (1 where nothing is replaced), and a map of ranks."""
    ranks = tokens.filter("rank >= 0").groupBy("rank").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("string"), "n")))).alias("ranks"))
    hits, replaced = F.count_if("hit"), F.count_if(F.col("hit") | F.col("injected"))
    out = tokens.agg(F.count("*").alias("tokens"), replaced.alias("replaced"), hits.alias("hits"), F.count_if("injected").alias("injected"), F.when(replaced == 0, 1.0).otherwise(hits / replaced).alias("coverage"))
    return out.join(F.broadcast(ranks))  # one row each


def keep_candidates(examples: DataFrame, lex: DataFrame, key: str, profile: Profile = RU, probability: float = 0.35, dirty: float | None = None, most: int = 3, clean_only: bool = True, budget: int = 8000, same_lemma: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """(key, is_clean, pos, source, candidates, action, added): tokens of which some that are kept get a hard negative before their candidates.

    Of the eligible kept tokens of an example those whose hash falls under `probability` (a third of it for changed examples) are taken in hashed
    order, `most` of them that have a hard negative.  Words are searched for at most `budget` distinct ones, in hashed order.
    """
    rows = tokens_of(examples, key)
    place = F.concat_ws("|", F.col(key).cast("string"), F.col("pos").cast("string"))
    chance = F.when(F.col("is_clean"), probability).otherwise(probability / 3 if dirty is None else dirty)
    free = (F.col("action") == "KEEP") & eligible(F.col("source"), profile) & (share(place, seed, "keep") <= chance) & (F.col("is_clean") | F.lit(not clean_only))
    rows = rows.withColumns({"norm": T.normalize_word(F.col("source")), "_free": free, "_order": share(place, seed, "order")})
    asked = splits.ranked(rows.filter("_free").select("norm").distinct(), ["norm"], seed).filter(F.col("place") < budget).select(F.col("norm").alias("word"))
    hard = hard_negatives(asked, lex, profile, same_lemma).select("norm", F.col("text").alias("hard"))
    rows = rows.join(hard, "norm", "left").withColumn("_free", F.col("_free") & F.col("hard").isNotNull())
    turn = F.row_number().over(Window.partitionBy(key, "_free").orderBy("_order", "pos"))  # the tokens of one example
    rows = rows.withColumn("added", F.col("_free") & (turn <= most))
    own = T.candidate_list(F.col("candidates"))
    kept = F.filter(own, lambda c: T.normalize_word(c) != T.normalize_word(F.col("hard")))
    text = T.case_like(F.col("hard"), F.col("source"))
    return rows.select(key, "is_clean", "pos", "source", F.when(F.col("added"), F.concat(F.array(text), kept)).otherwise(own).alias("candidates"), "action", "added")


def suspicious(texts: DataFrame, lex: DataFrame, text_col: str = "correct_text", profile: Profile = RU, least: float = WEAK, same_lemma: DataFrame | None = None, morphology: DataFrame | None = None, noise: bool = False) -> DataFrame:
    """(text, pos, word, candidate, score, distance, known): words of distinct clean texts that have a strong known neighbour of another lemma.

    `noise`: leave out parts of foreign names and words by morphology (`morphology`: norm).
    """
    rows = texts.select(T.strip(F.col(text_col)).alias("text")).filter("text <> ''").distinct().select("text", F.posexplode(T.word_tokens(F.col("text"))).alias("pos", "word"))
    rows = rows.filter(eligible(F.col("word"), profile)).withColumn("norm", T.normalize_word(F.col("word")))
    if noise:
        rows = rows.filter(~F.col("norm").isin(*FOREIGN_PARTS))
        rows = rows if morphology is None else rows.join(morphology.select("norm").distinct(), "norm", "left_anti")
    hard = hard_negatives(rows.select("word").distinct(), lex, profile, same_lemma, least).filter((F.col("score") >= least) & ~F.col("same_lemma"))
    found = rows.join(hard.select("norm", F.col("text").alias("candidate"), "score", "distance"), "norm").join(lex.select("norm", F.lit(True).alias("known")), "norm", "left")
    return found.select("text", "pos", "word", T.case_like(F.col("candidate"), F.col("word")).alias("candidate"), "score", "distance", F.coalesce("known", F.lit(False)).alias("known"))


def without_noise(rows: DataFrame, lex: DataFrame, text_col: str = "correct_text", **options) -> tuple[DataFrame, DataFrame]:
    """(`rows` without those whose text holds a suspicious word, the first such word of each text)."""
    found = suspicious(rows, lex, text_col, noise=True, **options)
    first = found.groupBy("text").agg(F.min_by(F.struct("word", "candidate", "score", "distance"), "pos").alias("x")).select("text", "x.*")
    gone = first.select(F.col("text").alias("_text"))
    return rows.join(gone, T.strip(rows[text_col]) == gone["_text"], "left_anti"), first


def corpus(texts: DataFrame, text_col: str = "text", samples: int = 3, clean: float = 0.45, clean_later: float = 0.35, weights: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """The whole corpus: distinct texts split 80/10/10, then pairs of each split by its curriculum, and the curated pairs in every split.

    Train texts give `samples` pairs each, `clean` of them clean; validation and test texts one, `clean_later` of them clean.
    """
    parts = splits.leak_free(texts, text_col, seed=seed).withColumn("key", F.md5("text"))
    out = []
    for name, times, ratio in (("train", samples, clean), ("val", 1, clean_later), ("test", 1, clean_later)):
        made = inject.curriculum(parts.filter(F.col("split") == name), "text", "key", times, ratio, weights, seed).drop("key", "sample")
        out += [made.withColumn("split", F.lit(name)), inject.curated(texts.sparkSession, name)]
    return splits.union_all(*out)
