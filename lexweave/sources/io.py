"""Sources and sinks: text, CSV, JSON and JSONL, pair files, lexicon sources, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.lexicon import word_rows

PAIR_FIELDS = {"error_text": ("source", "sources", "incorrect"), "correct_text": ("correction", "corrections", "correct"), "source_domain": ("domain", "source_domain")}
MANIFEST = "clean_sources array<struct<name:string,seen:bigint,accepted:bigint,rejected:bigint>>, source_counts map<string,map<string,bigint>>, rejection_reason_counts map<string,map<string,bigint>>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.globStatus(p)) if any(c in path for c in "*?[{") else fs.exists(p)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text): lines that are not blank, spacing repaired.  Line numbers grow within a file."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value"))
    return rows.filter(T.strip(F.col("value")) != "").select("line_no", T.raw_spacing(F.col("value")).alias("text"))


# Sentences of the sample corpus.
SAMPLE = (
    "Машинное обучение - это раздел искусственного интеллекта.",
    "Нейронные сети позволяют решать сложные задачи.",
    "Python является популярным языком программирования.",
    "Глубокое обучение требует большого количества данных.",
    "Нейросетевые модели хорошо работают с последовательностями.",
    "Обработка естественного языка - интересная область.",
    "Курсовая работа требует серьезного подхода.",
    "Анализ данных помогает находить закономерности.",
    "Важно правильно подготовить данные для обучения.",
    "Качество модели зависит от качества данных.",
)


def sample_texts(spark: SparkSession) -> DataFrame:
    """(line_no, text): the sample sentences, and each of them followed by each other one."""
    base = spark.createDataFrame(list(enumerate(SAMPLE)), "i int, text string")
    both = base.alias("a").join(F.broadcast(base.alias("b")), F.col("a.i") != F.col("b.i"))  # ten rows
    n = len(SAMPLE)
    pairs = both.select((F.col("a.i") * n + F.when(F.col("b.i") < F.col("a.i"), F.col("b.i") + 1).otherwise(F.col("b.i"))).cast("long").alias("line_no"), F.concat_ws(" ", "a.text", "b.text").alias("text"))
    return base.select((F.col("i") * n).cast("long").alias("line_no"), "text").unionByName(pairs)


def texts_or_sample(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a text file, or the sample corpus where there is no such file."""
    return read_texts(spark, path) if exists(spark, path) else sample_texts(spark)


def read_column(spark: SparkSession, path: str, column: str = "correct_text") -> DataFrame:
    """One column of a CSV file; the parser reads no other."""
    return read_csv(spark, path).select(column)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record: map<string,string>): objects of a JSON array, a JSON object or JSON lines; whatever is no object is left out.

    Files are read whole to tell the forms apart; a file of lines that is too large for one task is read with `read_json_lines`.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("value"))
    stripped = F.ltrim(F.regexp_replace("value", r"^[\s﻿]+", ""))
    as_list = F.transform(F.from_json("value", "array<string>", {"mode": "PERMISSIVE"}), lambda x: F.from_json(x, "map<string,string>", {"mode": "PERMISSIVE"}))
    as_one = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    by_line = F.transform(F.filter(F.split("value", T.LINE), lambda x: F.trim(x) != ""), lambda x: F.from_json(x, "map<string,string>", {"mode": "PERMISSIVE"}))
    single = ~F.trim("value").rlike(r"\}\s*[\r\n]+\s*\{")
    found = F.when(stripped.startswith("["), as_list).when(single & as_one.isNotNull(), F.array(as_one)).otherwise(by_line)
    return files.select(F.explode(found).alias("record")).filter("record is not null")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"}).alias("record")).filter("record is not null")


def pairs(records: DataFrame, dataset: str) -> DataFrame:
    """(error_text, correct_text, source_dataset, source_domain): the first key that a record has counts, even if its value is null."""
    record = F.col("record")

    def first(names: tuple[str, ...]):
        return reduce(lambda chain, n: chain.when(F.map_contains_key(record, n), record[n]), names[1:], F.when(F.map_contains_key(record, names[0]), record[names[0]]))

    out = records.select(*(first(v).alias(k) for k, v in PAIR_FIELDS.items()), F.lit(dataset).alias("source_dataset")).filter("error_text is not null and correct_text is not null")
    return out.select(T.external_text(F.col("error_text")).alias("error_text"), T.external_text(F.col("correct_text")).alias("correct_text"), "source_dataset", F.coalesce("source_domain", F.lit("")).alias("source_domain"))


def read_pair_files(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Pairs of several files, each under its own provenance name."""
    return reduce(DataFrame.unionByName, (pairs(read_records(spark, path), name) for name, path in files.items()))


def lexicon_sources(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(norm, freq) over the sources that exist: the `correct_text` of CSV files, every line of others."""
    frames = []
    for i, path in enumerate(p for p in paths if exists(spark, p)):
        rows = read_csv(spark, path) if path.lower().endswith(".csv") else spark.read.text(path).withColumnRenamed("value", "correct_text")
        if "correct_text" in rows.columns:
            frames.append(rows.select(F.lit(i).alias("doc_id"), F.col("correct_text").alias("text")))
    if not frames:
        return spark.createDataFrame([], "norm string, freq bigint")
    return word_rows(reduce(DataFrame.unionByName, frames)).groupBy("norm").agg(F.count("*").alias("freq"))


def first_source(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists."""
    return next((p for p in paths if exists(spark, p)), None)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source, reason, n): rejection counts of an ingestion manifest."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return rows.select(F.explode("rejection_reason_counts").alias("source", "m")).select("source", F.explode("m").alias("reason", "n"))


def save_lexicon(lex: DataFrame, mined: DataFrame | None, path: str) -> None:
    """A lexicon, and the confusions mined with it, as two tables."""
    write_table(lex, f"{path}/lexicon")
    if mined is not None:
        write_table(mined, f"{path}/mined")


def load_lexicon(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """What `save_lexicon` wrote; a folder without mined confusions gives None for them."""
    return spark.read.parquet(f"{path}/lexicon"), spark.read.parquet(f"{path}/mined") if exists(spark, f"{path}/mined") else None


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): plain text documents, one row each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON object a row."""
    summary.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, form: str = "parquet") -> None:
    writer = rows.write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(form).save(path)
