"""What the findings of round 3 asked for."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexweave.operators import candidates, correct, lexicon
from lexweave.plans.profiles import LATIN, RU

D = "/root/testdata/sf0.001"


def count(frame, what):
    return frame._jdf.queryExecution().optimizedPlan().toString().count(what)


@pytest.mark.parametrize("profile", [LATIN, RU])
def test_one_join_finds_what_the_stages_make(spark, profile):
    """candidates come from one join with the lexicon instead of texts made for every stage; the same words, sources, distances and order."""
    draw, letters = random.Random(7), profile.alphabet[:7]
    made = sorted({"".join(draw.choice(letters) for _ in range(draw.choice((2, 3, 4, 5, 9, 10)))) for _ in range(400)})

    def edited(w):
        at, c = draw.randrange(len(w)), draw.choice(letters)
        return draw.choice((w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w[:at] + w[at : at + 2][::-1] + w[at + 2 :], w[:at] + w[at] + w[at:]))

    asked = sorted({w for w in {edited(w) for w in made} | {edited(edited(w)) for w in made} | set(made[:80]) if len(w) >= 3})
    norms = spark.createDataFrame([(w,) for w in asked], "norm string").cache()
    lex = lexicon.lexicon(spark.createDataFrame([(0, " ".join(w for i, w in enumerate(made) for _ in range(1 + i % 3)))], "doc_id long, text string")).cache()
    unknown = norms.join(lex, "norm", "left_anti")
    long = unknown.filter(F.length("norm") >= profile.min_dictionary_length)
    rules = candidates.rules(norms, lex, profile).filter("source = 'rule' and ord[1] = 2")
    stages = [rules, candidates.orthographic(unknown, profile), candidates.keyboard(unknown, profile), candidates.dictionary(long, lex, profile), candidates.long_words(long, lexicon.ranked_by_length(lex, profile.bucket), profile)]
    known = {r.norm: r.freq for r in lex.collect()}
    want = {}
    for r in (r for s in stages for r in s.select("norm", "cand", "source", "distance", "ord").collect() if r.cand in known):
        # Places that make the same word of the same stage: the first one counts.
        at = (r.norm, r.cand, r.source, r.distance, r.ord[0])
        want[at] = min(want.get(at, r.ord), r.ord)
    got = {(r.norm, r.cand, r.source, r.distance, r.ord[0]): (r.ord, r.freq) for r in candidates.near_words(norms, lex, profile, False, True, True).collect()}
    assert {k: o for k, (o, _) in got.items()} == want and all(f == known[k[1]] for k, (_, f) in got.items())
    assert {k[4] for k in want} == {0, 2, 3, 4, 5} and len(want) > 400


def test_decisions_read_the_documents_a_few_times(spark):
    """words and lexicon are computed once for all their uses that can share them."""
    assert count(__spark_entry__.queries()["word_decisions"](spark, D), "Relation [") <= 8


def test_glued_parts_are_looked_up_once(spark):
    """one join tells what is known of a glued word's parts, with no null keys that would meet in one task."""
    assert count(__spark_entry__.queries()["word_decisions"](spark, D), "Join") <= 6
    lex = lexicon.lexicon(spark.createDataFrame([(0, "работе мы вчера")], "doc_id long, text string"))
    made = correct.word_decisions(spark.createDataFrame([(1, "мы наработе вчераа")], "doc_id long, text string"), lex)
    assert {(r.word, r.text, r.reason == "dictionary_drops_glued_service_token") for r in made.collect()} == {("наработе", "работе", True), ("вчераа", "вчера", False)}


def test_corrections_gather_edits_only(spark):
    """neither slots nor texts are joined a second time; lines are corrected in place, confidence is the mean over the words of the line."""
    found = __spark_entry__.queries()["correct_texts"](spark, D)
    assert count(found, "Relation [") <= 9 and count(found, "Join") <= 8
    lex = lexicon.lexicon(spark.createDataFrame([(0, "сегодня хороший день, погода и мир; привет очень " * 3)], "doc_id long, text string"))
    text = "Сегодня очень хороший день, прривет мир и погода.\n\nСегодня мир 1.5 и (мир)\r\nОчень хороший день, прривет мир и погода, прривет очень хороший мир сегодня!"
    (row,) = correct.correct(spark.createDataFrame([(1, text), (None, "прривет")], "doc_id long, text string"), lex).collect()
    assert (row.original, row.corrected, row.edits, row.accepted) == (text, text.replace("прривет", "привет").replace("\r\n", "\n"), 3, True)
    assert row.confidence == pytest.approx(((7 * 0.9 + 0.55) / 8 + 1.0 + 0.9 + (10 * 0.9 + 2 * 0.55) / 12) / 4)
