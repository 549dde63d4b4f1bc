"""Sequence alignment of correction pairs: difflib's opcodes in an Arrow function, everything on top of them as columns."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K
from pyspark.sql.functions import pandas_udf

from ..functions import gates as G
from ..functions import text as T

OPCODES = K.ArrayType(K.StructType([K.StructField("op", K.StringType()), *(K.StructField(n, K.IntegerType()) for n in ("i1", "i2", "j1", "j2"))]))


@pandas_udf(OPCODES)
def opcodes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Opcodes that turn the first sequence of strings into the second."""
    return pd.Series([[dict(zip(("op", "i1", "i2", "j1", "j2"), o)) for o in difflib.SequenceMatcher(None, list(x), list(y)).get_opcodes()] if x is not None and y is not None else None for x, y in zip(a, b)])


@pandas_udf(K.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of two strings."""
    return pd.Series([None if x is None or y is None else 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def slots_of(pairs: DataFrame, error_col: str = "error_text", correct_col: str = "correct_text") -> DataFrame:
    """`pairs` with src and tgt slots, their labels and the opcodes between their normalised words."""

    def norm(slots: str) -> Column:
        return F.transform(slots, lambda s: T.normalize_word(s["word"]))

    def labels(slots: str) -> Column:
        return F.transform(slots, lambda s: T.gap_label(s["gap"], s["punct_after"], s["word"], s["next_word"]))

    out = pairs.withColumns({"src": T.word_slots(F.col(error_col)), "tgt": T.word_slots(F.col(correct_col))})
    return out.withColumns({"src_labels": labels("src"), "tgt_labels": labels("tgt"), "ops": opcodes(norm("src"), norm("tgt"))})


def edit_labels(pairs: DataFrame, error_col: str = "error_text", correct_col: str = "correct_text", max_tokens: int = 128) -> DataFrame:
    """`pairs` with `example`: array<struct<source, candidates, action, source_punct, target_punct, target>>, null where a pair is not made of edits.

    Equal and equally long runs give KEEP or REPLACE_0 for each word; one word for up to three, or several for one (the others DELETE),
    one REPLACE_0; left out words DELETE.  Inserted words and other shapes are no edits.
    """
    rows = slots_of(pairs, error_col, correct_col)
    src, tgt, sp, tp = (F.col(c) for c in ("src", "tgt", "src_labels", "tgt_labels"))

    def token(source: Column, target: Column, action: Column, punct: Column, target_punct: Column, candidate: Column | None = None) -> Column:
        return F.struct(source.alias("source"), F.array(candidate if candidate is not None else target).alias("candidates"), action.alias("action"), punct.alias("source_punct"), target_punct.alias("target_punct"), target.alias("target"))

    def word(slots: Column, i: Column) -> Column:
        return F.get(slots, i)["word"]

    def span(o: Column, to: str = "i") -> Column:
        return F.when(o[f"{to}2"] > o[f"{to}1"], F.sequence(o[f"{to}1"], F.greatest(o[f"{to}2"] - 1, o[f"{to}1"]))).otherwise(F.array().cast("array<int>"))

    def each(o: Column) -> Column:
        def one(i: Column) -> Column:
            j = i - o["i1"] + o["j1"]
            return token(word(src, i), word(tgt, j), F.when(word(src, i) == word(tgt, j), "KEEP").otherwise("REPLACE_0"), F.get(sp, i), F.get(tp, j))

        return F.transform(span(o), one)

    def deleted(first: Column, o: Column) -> Column:
        return F.transform(F.filter(span(o), lambda i: i >= first), lambda i: token(word(src, i), F.lit(""), F.lit("DELETE"), F.get(sp, i), F.lit(""), word(src, i)))

    def of(o: Column) -> Column:
        n, m = o["i2"] - o["i1"], o["j2"] - o["j1"]
        joined = F.array_join(F.transform(F.slice(tgt, o["j1"] + 1, m), lambda s: s["word"]), " ")
        one_to_many = F.array(token(word(src, o["i1"]), joined, F.lit("REPLACE_0"), F.get(sp, o["i1"]), F.get(tp, o["j2"] - 1)))
        many_to_one = F.concat(F.array(token(word(src, o["i1"]), word(tgt, o["j1"]), F.lit("REPLACE_0"), F.get(sp, o["i1"]), F.get(tp, o["j1"]))), deleted(o["i1"] + 1, o))
        return (
            F.when((o["op"] == "equal") | ((o["op"] == "replace") & (n == m)), each(o)).when((o["op"] == "replace") & (n == 1) & m.between(1, 3), one_to_many)
            .when((o["op"] == "replace") & (m == 1), many_to_one).when(o["op"] == "delete", deleted(o["i1"], o))
        )

    runs = F.transform("ops", of)
    flat = F.flatten(runs)
    fits = (F.size("src") > 0) & (F.size("tgt") > 0) & ~F.exists(runs, lambda r: r.isNull())
    rows = rows.withColumn("example", F.when(fits, flat))
    rows = rows.withColumn("example", F.when((F.size("example") > 0) & (F.size("example") <= max_tokens), F.col("example")))
    return rows.withColumn("is_clean", T.strip(F.col(error_col)) == T.strip(F.col(correct_col))).drop("src", "tgt", "src_labels", "tgt_labels", "ops")


def error_types(example: Column, error: Column, correct: Column) -> Column:
    """real_spelling, real_punctuation, or real_other."""
    a, b = (F.transform(T.word_tokens(x, True), T.normalize_word) for x in (error, correct))
    spelling = F.when(example.isNotNull(), F.exists(example, lambda e: e["action"] != "KEEP")).otherwise(a != b)
    punctuation = F.coalesce(F.exists(example, lambda e: e["source_punct"] != e["target_punct"]), F.lit(False))
    found = F.filter(F.array(F.when(spelling, "real_spelling"), F.when(punctuation, "real_punctuation")), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("real_other"))).otherwise(found)


@pandas_udf(OPCODES)
def word_opcodes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Opcodes between the words of two strings, each words joined by spaces."""
    return pd.Series([[dict(zip(("op", "i1", "i2", "j1", "j2"), o)) for o in difflib.SequenceMatcher(None, x.split(), y.split()).get_opcodes()] if x is not None and y is not None else None for x, y in zip(a, b)])


# Results are fixed; marked so that the optimiser computes them once, where they stand.
word_opcodes = word_opcodes.asNondeterministic()


def plain_slots(text: Column) -> Column:
    """array<struct<word, gap, next>>: `T.word_slots` without what follows from these; `next` is null at the end."""
    found = F.struct(T.word_tokens(text, True).alias("w"), F.split(text, T.SLOT, -1).alias("g"))
    return T.let(found, lambda x: F.arrays_zip(x["w"].alias("word"), F.slice(x["g"], 2, 1 << 30).alias("gap"), F.slice(x["w"], 2, 1 << 30).alias("next")))


def slot_words(slots: Column) -> Column:
    """The normalised words of slots, joined by spaces, which no word holds."""
    return T.normalize_word(F.array_join(slots["word"], " "))


def in_step(a: Column, b: Column) -> Column:
    """Whether difflib is sure to align two lists of words place by place.

    It is if they are as long and no word that differs from its counterpart is anywhere in the other list: then each longest
    block is a run of places that agree.  From 200 words on difflib leaves out frequent ones, so these are not told here.
    """
    differ = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] != x["b"])
    apart = T.let(differ, lambda d: (F.size(d) == 0) | ~(F.arrays_overlap(d["a"], b) | F.arrays_overlap(d["b"], a)))
    return F.when((F.size(a) == F.size(b)) & (F.size(b) < 200), apart).otherwise(False)


def edits(src: Column, tgt: Column, ops: Column) -> Column:
    """array<struct<metric, edit_key>>: spelling, punctuation and case edits between plain slots; no edit is there twice, each key names its place."""
    key = lambda *parts: F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    edit = lambda metric, k: F.struct(F.lit(metric).alias("metric"), k.alias("edit_key"))
    # Labels are computed where slots differ and nowhere else.
    label = lambda x: T.gap_label(x["gap"], F.lit(""), x["word"], F.coalesce(x["next"], F.lit("")))

    def of(o: Column) -> Column:
        n, m = o["i2"] - o["i1"], o["j2"] - o["j1"]
        targets = F.array_join(F.transform(F.slice(tgt, o["j1"] + 1, m), lambda s: T.normalize_word(s["word"])), " ")
        spans = F.array(F.slice(src, o["i1"] + 1, n), F.slice(tgt, o["j1"] + 1, m))

        def one(x: Column) -> Column:
            i, a, b = x["i"], x["a"], x["b"]
            same = T.normalize_word(a["word"]) == T.normalize_word(b["word"])
            return F.array(
                F.when(~same, edit("spell", key("word", i, T.normalize_word(b["word"])))), F.when(same & (T.case_signature(a["word"]) != T.case_signature(b["word"])), edit("case", key("word", i, b["word"]))),
                T.let(F.transform(F.array(a, b), label), lambda p: F.when(p[0] != p[1], edit("punct", key("gap", i, p[1])))),
            )

        beside = F.arrays_zip(F.slice(src, o["i1"] + 1, n).alias("a"), F.slice(tgt, o["j1"] + 1, m).alias("b"))
        differ = F.filter(F.transform(beside, lambda x, k: F.when(~x["a"].eqNullSafe(x["b"]), F.struct((o["i1"] + k).alias("i"), x["a"].alias("a"), x["b"].alias("b")))), lambda x: x.isNotNull())
        has = lambda x: F.exists(x, lambda p: p != "")

        def changed(p: Column) -> Column:
            marks = F.array_join(p[1], "\x1f")
            return (
                F.when(o["op"] == "replace", F.array(edit("spell", key("replace_span", o["i1"], o["i2"], targets)), F.when(p[0] != p[1], edit("punct", key("replace_span", o["i1"], o["i2"], marks)))))
                .when(o["op"] == "delete", F.array(edit("spell", key("delete_span", o["i1"], o["i2"])), F.when(has(p[0]), edit("punct", key("delete_span", o["i1"], o["i2"])))))
                .otherwise(F.array(edit("spell", key("insert_at", o["i1"], targets)), F.when(has(p[1]), edit("punct", key("insert_at", o["i1"], marks)))))
            )

        in_place = (o["op"] == "equal") | ((o["op"] == "replace") & (n == m))
        return F.when(in_place, F.flatten(F.transform(differ, one))).otherwise(T.let(F.transform(spans, lambda s: F.transform(s, label)), changed))

    return F.filter(F.flatten(F.transform(ops, of)), lambda x: x.isNotNull())


def with_edits(rows: DataFrame, outputs: dict[str, tuple[str, Column]], source_col: str) -> DataFrame:
    """`rows` with a column of `edits` from source to output for each name in `outputs` (name: output column, where it is asked); null elsewhere.

    Only pairs that are not in step go through difflib.
    """
    text, none = F.col(source_col), F.lit(None)
    asked = {n: F.when(wanted & (text != F.col(c)), F.col(c)) for n, (c, wanted) in outputs.items()}
    # The source has slots where at least one output is compared to it.
    rows = rows.withColumn("_src", F.when(F.coalesce(*asked.values()).isNotNull(), plain_slots(text)))
    rows = rows.withColumns({f"_{n}": F.when(c.isNotNull(), plain_slots(F.col(outputs[n][0]))) for n, c in asked.items()})
    rows = rows.withColumn("_src_words", slot_words(F.col("_src"))).withColumns({f"_{n}_words": slot_words(F.col(f"_{n}")) for n in outputs})
    listed = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))
    step = lambda n: T.let(F.struct(listed("_src_words").alias("a"), listed(f"_{n}_words").alias("b")), lambda x: in_step(x["a"], x["b"]))
    rows = rows.withColumns({f"_{n}_step": F.when(F.col(f"_{n}").isNotNull(), step(n)) for n in outputs})
    rows = rows.withColumns({f"_{n}_ops": word_opcodes(*(F.when(~F.col(f"_{n}_step"), F.col(c)).otherwise(none) for c in ("_src_words", f"_{n}_words"))) for n in outputs})
    size = F.size("_src")
    whole = F.array(F.struct(F.lit("equal").alias("op"), F.lit(0).alias("i1"), size.alias("i2"), F.lit(0).alias("j1"), size.alias("j2")))
    pairs = F.array(*(F.struct(F.col("_src").alias("s"), F.col(f"_{n}").alias("t"), F.when(F.col(f"_{n}_step"), whole).otherwise(F.col(f"_{n}_ops")).alias("o")) for n in outputs))
    rows = rows.withColumn("_all", F.transform(pairs, lambda x: edits(x["s"], x["t"], x["o"])))
    empty = F.array().cast("array<struct<metric:string,edit_key:string>>")
    made = {n: F.when(wanted & (text == F.col(c)), empty).otherwise(F.col("_all")[k]) for k, (n, (c, wanted)) in enumerate(outputs.items())}
    return rows.withColumns(made).drop("_all", "_src", "_src_words", *(f"_{n}{x}" for n in outputs for x in ("", "_words", "_step", "_ops")))


def edit_keys(pairs: DataFrame, source_col: str, output_col: str, keys: list[str]) -> DataFrame:
    """(keys, metric, edit_key): spelling, punctuation and case edits from source to output."""
    rows = with_edits(pairs.select(*keys, F.col(source_col).alias("_s"), F.col(output_col).alias("_o")), {"_found": ("_o", F.lit(True))}, "_s")
    return rows.select(*keys, F.explode_outer("_found").alias("e")).filter("e is not null").select(*keys, "e.metric", "e.edit_key")


def pair_overlap(pairs: DataFrame, source_col: str, gold_col: str, made_col: str, keys: list[str]) -> DataFrame:
    """(keys, metric, tp, fp, fn, support): as `metrics.edit_overlap` of the two tables of `edit_keys`, told within each pair, so nothing is shuffled."""
    rows = pairs.select(*keys, F.col(source_col).alias("_s"), F.col(gold_col).alias("_g"), F.col(made_col).alias("_m"))
    # An output that is the wanted text makes the wanted edits.
    rows = with_edits(rows, {"_gold": ("_g", F.lit(True)), "_made": ("_m", ~F.col("_m").eqNullSafe(F.col("_g")))}, "_s")
    none = F.array().cast("array<struct<metric:string,edit_key:string>>")
    gold = F.coalesce("_gold", none)
    made = F.when(F.col("_m").eqNullSafe(F.col("_g")), gold).otherwise(F.coalesce("_made", none))
    rows = rows.select(*keys, gold.alias("g"), made.alias("p"))

    def counts(x: Column) -> Column:
        def of(metric: str) -> Column:
            tp, p, g = (F.size(F.filter(x[c], lambda e: e["metric"] == metric)) for c in ("b", "p", "g"))
            found = F.struct(tp.alias("tp"), p.alias("p"), g.alias("g"))
            return T.let(found, lambda n: F.when(n["p"] + n["g"] > 0, F.struct(F.lit(metric).alias("metric"), n["tp"].cast("long").alias("tp"), (n["p"] - n["tp"]).cast("long").alias("fp"), (n["g"] - n["tp"]).cast("long").alias("fn"), n["g"].cast("long").alias("support"))))

        return F.filter(F.array(*(of(m) for m in ("spell", "punct", "case"))), lambda x: x.isNotNull())

    both = F.struct(F.array_intersect("g", "p").alias("b"), F.col("g").alias("g"), F.col("p").alias("p"))
    # An inner `explode` would have the optimiser filter on its array, and so compute the edits twice.
    return rows.select(*keys, F.explode_outer(T.let(both, counts)).alias("e")).filter("e is not null").select(*keys, "e.*")


def mined_confusions(pairs: DataFrame, lex: DataFrame, min_count: int = 2, min_freq: int = 1, phrases: dict[str, tuple[str, ...]] | None = None, top: int = 8) -> DataFrame:
    """(source, target, count, place): words that pairs replace by one to three words, often enough and alike enough."""
    words = lambda c: F.transform(T.word_tokens(F.col(c)), T.normalize_word)
    rows = pairs.select(words("error_text").alias("a"), words("correct_text").alias("b")).withColumn("o", F.explode(opcodes("a", "b")))
    rows = rows.filter((F.col("o.op") == "replace") & (F.col("o.i2") - F.col("o.i1") == 1) & (F.col("o.j2") - F.col("o.j1")).between(1, 3))
    rows = rows.select(F.get("a", F.col("o.i1")).alias("source"), F.array_join(F.slice("b", F.col("o.j1") + 1, F.col("o.j2") - F.col("o.j1")), " ").alias("target"))
    found = rows.groupBy("source", "target").agg(F.count("*").alias("count")).filter((F.col("count") >= min_count) & (F.length("source") >= 3) & ~T.has_digit(F.col("source")) & (F.col("source") != F.col("target")))
    freq = lex.select(F.col("norm"), "freq")
    found = found.join(freq.filter(F.col("freq") >= min_freq).select(F.col("norm").alias("source")), "source", "left_anti")
    found = found.join(freq.withColumnRenamed("norm", "target"), "target", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    allowed = F.concat_ws("|", "source", "target").isin([f"{k}|{v}" for k, vs in (phrases or {}).items() for v in vs] or ["\0"])
    ends = (F.substring("source", 1, 2) == F.substring("target", 1, 2)) & (F.substring("source", -2, 2) == F.substring("target", -2, 2))
    single = found.filter(~F.contains("target", F.lit(" ")) & (F.col("freq") >= min_freq) & (F.abs(F.length("source") - F.length("target")) <= 2)).filter(G.one_osa(F.col("source"), F.col("target")) | G.two_osa(F.col("source"), F.col("target")) | ends)
    phrase = found.filter(F.contains("target", F.lit(" ")) & allowed)
    from pyspark.sql import Window

    order = Window.partitionBy("source").orderBy(F.desc("count"), F.desc(F.log1p("freq")), "target")
    return single.unionByName(phrase).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).select("source", "target", "count", "place")
