"""Log tables: the canonical event log over parquet, Kafka readers, and random access by (topic, partition, offset)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.functions.order import numbered
from keystrand.operators.decode import reject_reason

MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
#: Constant "now" of the canonical log, 2024-01-31T00:00:00Z.
NOW_US = 1_706_659_200_000_000
GROUP = "analytics"


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table events as a log of four partitions: what a broker would hand out, offsets included (counted hour by hour)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type")
    e = e.select("*", F.expr(MICROS).alias("ts_us"))
    e = numbered(e.withColumn("part", (F.col("user_id") % 4).cast("int")), "number", ["part"], F.floor(F.col("ts_us") / 3_600_000_000), ["ts", "event_id"])
    eid = F.col("event_id")
    own_id = F.when(eid % 7 == 0, F.concat(F.lit(',"id":'), eid.cast("string"))).when(eid % 7 == 1, "").otherwise(
        F.concat(F.lit(',"id":"'), "event_type", F.lit("-"), F.day("ts").cast("string"), F.lit('"'))
    )
    own_type = F.when(eid % 11 == 0, "").otherwise(F.concat(F.lit(',"type":"'), "event_type", F.lit(".v"), (eid % 2 + 1).cast("string"), F.lit('"')))
    error = F.col("event_type") == "error"
    return e.select(
        F.lit("events").alias("topic"), "part", (F.col("number") - 1).alias("off"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"), "ts_us", "event_id", "event_type",
        F.when(eid % 10 == 0, GROUP).when(eid % 10 == 1, F.lit(None)).otherwise(F.concat(F.lit("svc-"), (eid % 3).cast("string"))).alias("source_system"),
        F.concat(F.lit('{"seq":'), eid.cast("string"), own_id, own_type, F.lit("}")).alias("payload"),
        F.when(error & (eid % 3 == 0), "permanent").when(error & (eid % 3 == 1), "transient").otherwise("success").alias("outcome"),
        (1 + eid % 997).alias("duration_ms"),
    )


def kafka_log(spark: SparkSession, servers: str, topics: list[str], stream: bool = True, options: dict[str, str] | None = None) -> DataFrame:
    """Records of the topics from the earliest offset, headers included; names that begin with ^ are one pattern.

    Needs the Kafka connector package on the session's class path.
    """
    patterns = [t for t in topics if t.startswith("^")]
    how = ("subscribePattern", "|".join(f"({p})" for p in [*patterns, *(f"^{t}$" for t in topics if not t.startswith("^"))])) if patterns else ("subscribe", ",".join(sorted(set(topics))))
    reader = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option(*how)
    reader = reader.option("startingOffsets", "earliest").option("includeHeaders", "true").options(**(options or {}))
    return reader.load().select(
        "topic", F.col("partition").alias("part"), F.col("offset").alias("off"), F.col("key").alias("raw_key"), F.col("value").alias("raw_payload"), "headers", F.unix_micros("timestamp").alias("ts_us")
    )


def missing_topics(configured: DataFrame, existing: DataFrame) -> DataFrame:
    """Configured topics, patterns aside, that the cluster doesn't have."""
    return configured.where(~F.startswith("topic", F.lit("^"))).select("topic").distinct().join(existing.select("topic"), "topic", "left_anti")


def load(wanted: DataFrame, log: DataFrame, codec: str = "json") -> DataFrame:
    """Rows (topic, part, off, key, ...) wanted, with the log's payload and a status: found, deleted, key_mismatch or undecodable.

    Requests for one offset are joined once and fanned out again. What can't be decoded is a permanent failure.
    """
    at = ["topic", "part", "off"]
    found = wanted.select(*at).distinct().join(log.select(*at, F.col("off").alias("_log_off"), F.col("key").alias("_log_key"), "payload", reject_reason(F.col("key"), F.col("payload"), codec).alias("_bad")), at)
    status = F.when(F.col("_log_off").isNull(), "deleted").when(F.col("_bad").isNotNull(), "undecodable").when(F.col("_log_key") != F.col("key"), "key_mismatch").otherwise("found")
    return wanted.join(found, at, "left").withColumn("status", status).drop("_log_off", "_log_key", "_bad")


def delete_records(log: DataFrame, before: dict[int, int]) -> DataFrame:
    """The log without offsets below the given one of each partition."""
    least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("part")), F.lit(0)) if before else F.lit(0)
    return log.where(F.col("off") >= least)
