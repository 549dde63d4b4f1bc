"""The corpus pipeline: quality filter, exact and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir), where docs is a Parquet scan of what the stage before kept, and works on all of it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import exact_dedup, mixing, near_dedup, packing, quality
from lexweave.llm.staging import staged

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorer, fitted on these documents, does not reject."""
    return quality.keep_good(docs, quality.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dedup.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and offset."""
    return packing.pack(packing.token_pieces(docs, TOKENIZER)).withColumnRenamed("id", "doc_id")


STAGES = [("quality", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mix", mix_sources), ("pack", pack_sequences)]
#: Not expressible in SQL: a fitted model, a sampled signature and a search; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each on what the one before kept.

    Null, empty and wordless texts go in the first stage; of texts with the same words one stays, whatever their ids; rows that share an id
    but not the text are mixed one by one and packed apart; an empty table gives no rows; other columns stay until the last stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
