"""Registered queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, html_extract, mixing, near_dedup, packing, quality, substring_dedup, url_filter, warc

#: The url rules of query op1.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by URL_RULES; null, malformed and repeated urls as `url_filter.judge_urls` says."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its group; nulls, ties and repeated rows as `exact_dedup.exact_groups` says."""
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weak label, score and class by a scorer fitted on these documents; nulls and empty tables as `quality.fit` and `quality.classified` say."""
    docs = table(spark, sf_dir, "documents")
    return quality.classified(docs, quality.fit(docs)).withColumnRenamed("id", "doc_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without what earlier ones hold; nulls, ties and repeated rows as `substring_dedup.drop_repeats` says."""
    return substring_dedup.drop_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all; invalid vectors, ties and empty tables as `ann.nearest_neighbours` says."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.filter("vec_id % 20 = 0"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; null, empty, unclosed and repeated pages as `html_extract.extract` says."""
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes; nulls, repeated rows and empty tables as `mixing.mix` says."""
    taken = mixing.mix(table(spark, sf_dir, "documents"))
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequence and offset; nulls, empty texts and empty tables as `packing.token_pieces` and `packing.pack` say."""
    import public_tokenizers

    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces).withColumnRenamed("id", "doc_id")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near copies; nulls, repeated ids and empty tables as `near_dedup.near_classes` says."""
    found = near_dedup.near_classes(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id").withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back; nulls, repeated rows and empty tables as `warc.write_archives` and `warc.read_records` say."""
    folder = warc.archive_folder(spark)
    index = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_records(index, folder).drop("url", "payload")


OP1_SQL = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
r(rhost, rpath, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
d AS (SELECT DISTINCT host, path FROM u),
m AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule, arg_max(action, length(rhost || rpath) * 1000 + length(rhost)) AS action
  FROM d JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT page_id, u.host, u.path, m.rule, coalesce(m.action, 'allow') AS verdict FROM u LEFT JOIN m ON u.host = m.host AND u.path = m.path
"""

OP2_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
h AS (SELECT doc_id, n, sha256(norm) AS text_sha256 FROM t),
w AS (SELECT doc_id, text_sha256, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER g AS rn
      FROM h WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM w
"""

OP10_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT h, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (1 + ((('0x' || substr(h, (1 + 10 * (i // 8))::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31))::INT, 1)), 'string_agg', '') AS payload_digest
      FROM (SELECT DISTINCT h FROM p)),
w AS (SELECT *, row_number() OVER g AS rn, first_value(page_id) OVER g AS response FROM p WINDOW g AS (PARTITION BY h ORDER BY page_id DESC))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN rn = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN rn > 1 THEN response END AS refers_to
FROM w JOIN d USING (h)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_url_filter, op2_exact_dedup, op3_quality, op4_substring_dedup, op5_neighbours, op6_html_text, op7_mix_sources, op8_pack, op9_near_dedup, op10_warc)}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op10_warc": OP10_SQL}
