"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Runs of characters that are not white space (space and U+0009..U+000D).
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Everything that is neither an ASCII digit, an ASCII lower-case letter nor a non-ASCII character.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; texts without other characters take the cheap built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the session's spark.checkpoint.dir. Only a local session may do without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="keystrand-checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table in the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keystrand-{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._keystrand_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._keystrand_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (text, <label>) of documents that have a label and for whose id `usable` holds: about max_rows of them at most.

    The sample is of the label table, by hash of the id, so it is the same on every run; its bound is what lets it be
    broadcast. Null labels and ids are left out, of repeated labels the larger counts.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & usable).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias(label))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 40)) < int((1 << 40) * (max_rows / n)))
    rows = documents.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("_doc") == F.col("_id")).select("text", label)
    return cut(rows, f"labelled-{label}")
