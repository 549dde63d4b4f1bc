"""Exact deduplication as a stateful stream with disk-backed state.

1. Every text is normalised and digested where it is read (built-in functions); a slim table of digest,
   stable identifier, length and content locator (file, row) goes to the shared folder.
2. A Structured Streaming aggregation keyed by the digest consumes it.  Its RocksDB state never
   expires and retains, for each digest, the identifier and locator of the row that stays and a count;
   updated keys are appended to a table, of which the last version of each key counts.
3. Rows of digests that were hit more than once are checked on their full bytes against the text at the
   retained locator.  Groups in which any byte differs are grouped again by the whole normalised text.

Hot digests meet nowhere as rows: the stream sums map-side first, and the check spreads the copies over
(digest, salt) with as many copies of the retained text as salts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import fresh_path, located, sieved, staged

WHITE = r"[\x20\x09-\x0D]+"
#: Copies checked against one copy of the retained text.
COPIES_A_SALT = 256
#: State on disk; without preallocation, which takes megabytes for each of many small state partitions.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def streamed_groups(slim: DataFrame, files_per_trigger: int | None = None) -> tuple[DataFrame, str]:
    """(digest, best, n) after the stream has consumed the staged table `slim`, and the path of that table."""
    spark = slim.sparkSession
    path, sink, state = (fresh_path(spark, f"exact-{k}") for k in ("slim", "groups", "state"))
    slim.write.parquet(path)
    reader = spark.readStream.schema(slim.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    kept = (reader.parquet(path).groupBy("digest")
            .agg(F.max(F.struct("n_points", (-F.col("id")).alias("neg_id"), "_file", "_row")).alias("best"), F.count("*").alias("n")))
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = (kept.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", state)
                 .foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{sink}/b={n}")).start())
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    schema = f"digest binary, best {slim.select(F.struct('n_points', F.lit(0).cast('long').alias('neg_id'), '_file', '_row').alias('x')).schema['x'].dataType.simpleString()}, n long, batch long, b long"
    versions = spark.read.schema(schema).parquet(sink) if query.lastProgress and _exists(spark, sink) else spark.createDataFrame([], schema)
    return versions.groupBy("digest").agg(F.max_by("best", "batch").alias("best"), F.max_by("n", "batch").alias("n")), path


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None, files_per_trigger: int | None = None) -> DataFrame:
    """One row for each row of `docs`: id, keep_id, group_size, kept, digest, _file, _row.

    Texts are equal when the same bytes remain after deleting `[\\x20\\x09-\\x0D]`.  Of equal texts the
    one with most code points stays, then the smallest id (null ids last), then the first row in the file; exactly one row of a
    group is kept, also among repeated rows.  Null texts count as empty; texts of any length are compared whole.  An empty table gives no
    rows; other columns, whatever their names, are not read.  Tables that are no Parquet scan are staged first.
    `digest`: Column -> binary Column; a weak one is only slower, since hits are checked on bytes.
    """
    rows, file, row = located(docs.select(id_col, text_col))
    return _groups(rows.withColumnsRenamed({file: "_file", row: "_row"}), id_col, text_col, digest, files_per_trigger)


def _groups(rows: DataFrame, id_col: str, text_col: str, digest=None, files_per_trigger: int | None = None) -> DataFrame:
    digest = digest or (lambda t: F.unhex(F.sha2(t, 256)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), "_file", "_row")
    slim = rows.select("id", F.length(F.coalesce("text", F.lit(""))).alias("n_points"), digest(normalised(F.col("text"))).alias("digest"), "_file", "_row")
    groups, path = streamed_groups(slim, files_per_trigger)
    groups = staged(groups, "exact-state")
    slim = slim.sparkSession.read.schema(slim.schema).parquet(path)
    found = slim.join(groups, "digest").withColumn("kept", (F.col("_file") == F.col("best._file")) & (F.col("_row") == F.col("best._row")))
    found = staged(found.select("id", "digest", "n_points", "n", "kept", "_file", "_row", (-F.col("best.neg_id")).alias("keep_id")), "exact-found")
    texts = _hit_texts(rows, found)
    wrong = _mismatched(texts)
    sure = found.select("id", "keep_id", F.col("n").alias("group_size"), "kept", "digest", "_file", "_row")
    if wrong.isEmpty():
        return sure
    return sure.join(wrong, "digest", "left_anti").select(*sure.columns).unionByName(_regrouped(texts, wrong))


def _hit_texts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of digests that were hit more than once, with their normalised texts; few other texts are moved or normalised."""
    many = found.filter("n > 1")
    place = ["_file", "_row"]
    texts = sieved(rows.select(*place, "text"), many.select(*place), place).join(many, place)
    return staged(texts.withColumn("norm", normalised(F.col("text"))).drop("text"), "exact-hits")


def _mismatched(texts: DataFrame) -> DataFrame:
    """Digests of groups in which a copy's bytes differ from those at the retained locator."""
    salts = F.ceil(F.col("n") / COPIES_A_SALT).cast("int")
    held = texts.filter("kept").select("digest", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("norm").alias("held"))
    hits = texts.filter("not kept").select("digest", F.pmod(F.xxhash64("_file", "_row"), salts).cast("int").alias("salt"), "norm")
    return staged(hits.join(held, ["digest", "salt"]).filter("norm <> held").select("digest").distinct(), "exact-wrong")


def _regrouped(texts: DataFrame, wrong: DataFrame) -> DataFrame:
    """The exact way for colliding digests: groups of whole normalised texts."""
    again = texts.join(wrong, "digest", "left_semi")
    best = again.groupBy("norm").agg(F.max(F.struct("n_points", (-F.col("id")).alias("neg_id"), "_file", "_row")).alias("best"), F.count("*").alias("group_size"))
    out = again.select("norm", "id", "digest", "_file", "_row").join(best, "norm")
    return out.select("id", (-F.col("best.neg_id")).alias("keep_id"), "group_size", ((F.col("_file") == F.col("best._file")) & (F.col("_row") == F.col("best._row"))).alias("kept"), "digest", "_file", "_row")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that `exact_groups` drops; columns unchanged.

    Nulls, empty tables, ties and repeated rows: as `exact_groups`; columns of any name stay.
    """
    rows, file, row = located(docs)
    groups = _groups(rows.select(F.col(id_col), F.col(text_col), F.col(file).alias("_file"), F.col(row).alias("_row")), id_col, text_col)
    keep = groups.filter("kept").select(F.col("_file").alias(file), F.col("_row").alias(row))
    return rows.join(keep, [file, row], "left_semi").select(*docs.columns)
