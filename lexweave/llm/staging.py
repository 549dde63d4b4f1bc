"""Shared-folder staging: tables that cut lineage and survive the loss of an executor, and joins that move less."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values of a `bitmap_construct_agg` bitmap, and the logarithm of how many a sieve has in all (4 MB).
_BITMAP, SIEVE = 32_768, 25


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`.

    A temporary folder is set only in local mode, where the driver and the executors are one process; on a cluster each executor would
    write to its own disk, so a session that names no folder is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lexweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexweave/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back with the same schema."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """`name`, with underscores behind it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def located(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """`docs` with two more columns, unique for a row together, and their names: the file and the row in it.

    Only Parquet scans, projected or filtered, say so themselves; anything else is staged first.
    """
    file, row = unused(docs.columns, "_file"), unused(docs.columns, "_row")
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    if set(re.findall(r"^[\s:+-]*(\w+)", plan, re.M)) <= {"Project", "Filter", "Relation"}:
        try:
            return docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)), file, row
        except AnalysisException:
            pass  # a file format whose rows have no number
    docs = staged(docs, "located")
    return docs.select("*", F.xxhash64("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)), file, row


def sieve(rows: DataFrame, keys: DataFrame, cols: list[str], flag: str, bits: int = SIEVE) -> DataFrame:
    """`rows` with a column `flag`: false only where `cols` are certainly not among `keys`.

    What is broadcast is a set of 2 ** `bits` hash values, as large for any table; when nearly all its bits are set, nearly all rows are flagged.
    """
    hashed = F.pmod(F.xxhash64(*cols), F.lit(1 << bits))
    slot, bit, held = (unused([*rows.columns, *keys.columns], n) for n in ("_slot", "_bit", "_bits"))
    table = keys.select(F.floor(hashed / _BITMAP).alias(slot), F.pmod(hashed, F.lit(_BITMAP)).alias(bit)).groupBy(slot).agg(F.bitmap_construct_agg(bit).alias(held))
    near = rows.withColumns({slot: F.floor(hashed / _BITMAP), bit: F.pmod(hashed, F.lit(_BITMAP))}).join(F.broadcast(table), slot, "left")  # 2 ** bits / 8 bytes
    byte = F.conv(F.hex(F.substring(F.col(held), F.floor(F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return near.withColumn(flag, F.coalesce(F.getbit(byte, F.pmod(F.col(bit), F.lit(8)).cast("int")) == 1, F.lit(False))).select(*rows.columns, flag)


def sieved(rows: DataFrame, keys: DataFrame, cols: list[str], bits: int = SIEVE) -> DataFrame:
    """`rows` less most of those whose `cols` are not among `keys`; no row that is among them is lost.

    A join on `cols` that follows moves little else than what it keeps.
    """
    flag = unused(rows.columns, "_near")
    return sieve(rows, keys, cols, flag, bits).filter(F.col(flag)).select(*rows.columns)
