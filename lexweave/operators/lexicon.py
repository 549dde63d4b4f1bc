"""Lexicon aggregates: word frequencies, length buckets, vocabularies, membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..functions import text as T


def word_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", numbers: bool = False) -> DataFrame:
    """(id_col, pos, word, norm) of every word of every document."""
    return docs.select(id_col, F.posexplode(T.word_tokens(F.col(text_col), numbers)).alias("pos", "word")).withColumn("norm", T.normalize_word(F.col("word")))


def lexicon(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 2) -> DataFrame:
    """(norm, freq, len, first_doc, first_pos): words with at least `min_length` characters; the first place breaks ties."""
    words = word_rows(docs, id_col, text_col).filter(F.length("norm") >= min_length)
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, K.IntegralType):
        found = words.groupBy("norm").agg(F.count("*").alias("freq"), F.min(F.struct(F.col(id_col).alias("doc"), "pos")).alias("first"))
        return found.select("norm", "freq", F.length("norm").alias("len"), F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"))
    # A place is one number, exact for any 64-bit id, as the least struct would take a sort of all words in memory; a null id comes first, as in a struct.
    places = F.lit(1 << 31).cast("decimal(10,0)")
    place = F.coalesce(F.col(id_col).cast("decimal(20,0)"), F.lit(str(-(1 << 63) - 1)).cast("decimal(20,0)")) * places + F.col("pos")
    found = words.groupBy("norm").agg(F.count("*").alias("freq"), F.min(place.cast("decimal(32,0)")).alias("first"))
    pos = F.pmod("first", places)
    doc = F.expr("try_cast(_doc AS " + kind.simpleString() + ")")
    found = found.select("norm", "freq", F.length("norm").alias("len"), pos.cast("int").alias("first_pos"), ((F.col("first") - pos) / places).cast("decimal(20,0)").alias("_doc"))
    return found.select("norm", "freq", "len", doc.alias("first_doc"), "first_pos")


def ranked_by_length(lex: DataFrame, top: int | None = 5000) -> DataFrame:
    """`lex` with bucket_rank: the `top` most frequent words of each length, or all."""
    order = Window.partitionBy("len").orderBy(F.desc("freq"), "first_doc", "first_pos")
    ranked = lex.withColumn("bucket_rank", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("bucket_rank") <= top)


def vocabulary(lex: DataFrame, size: int = 80_000) -> DataFrame:
    """(norm, freq, word_id): the most frequent words, ids from 2 (0 pads, 1 is unknown); earlier words first among ties."""
    top = lex.orderBy(F.desc("freq"), "first_doc", "first_pos").limit(size - 2)
    return top.withColumn("word_id", F.row_number().over(Window.orderBy(F.desc("freq"), "first_doc", "first_pos")) + 1).select("norm", "freq", "word_id")


def known(words: DataFrame, lex: DataFrame, min_freq: int = 1) -> DataFrame:
    """`words` with freq (0 if unknown) and known."""
    return words.join(lex.select("norm", "freq"), "norm", "left").withColumns({"freq": F.coalesce("freq", F.lit(0)), "known": F.coalesce(F.col("freq") >= min_freq, F.lit(False))})


def unknown_words(words: DataFrame, lex: DataFrame, min_freq: int = 1) -> DataFrame:
    return words.join(lex.filter(F.col("freq") >= min_freq).select("norm"), "norm", "left_anti")


def ordered_distinct(rows: DataFrame, text_col: str, order_col: str) -> DataFrame:
    """(text, first): distinct stripped texts that are not empty, with the first place of each."""
    return rows.select(T.strip(F.col(text_col)).alias("text"), F.col(order_col).alias("first")).filter("text <> ''").groupBy("text").agg(F.min("first").alias("first"))
