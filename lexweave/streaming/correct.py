"""Row-local stages over a stream, against a static lexicon; no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def unknown_word_stream(docs: DataFrame, lex: DataFrame, key: str = "doc_id", text_col: str = "text", min_freq: int = 1) -> DataFrame:
    """(key, pos, word) of words that the lexicon does not know; works on a streaming or a static frame."""
    words = docs.select(key, F.posexplode(T.word_tokens(F.col(text_col))).alias("pos", "word")).withColumn("norm", T.normalize_word(F.col("word")))
    known = lex.filter(F.col("freq") >= min_freq).select("norm", F.lit(True).alias("known"))
    return words.join(known, "norm", "left").filter("known is null").select(key, "pos", "word")


def sentence_stream(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(T.sentences(F.col(text_col))).alias("pos", "sentence"))
