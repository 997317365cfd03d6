"""Sinks: producer records, failure topic, telemetry topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystrand.functions.scalars import rfc3339_ms


def producer_records(messages: DataFrame, source_system: str, trace: Column | None = None) -> DataFrame:
    """(topic, key, value, headers) of messages (topic, key, payload): trace headers, source-system, then the user's."""
    own = F.array(F.struct(F.lit("source-system").alias("key"), F.lit(source_system).cast("binary").alias("value")))
    headers = own if "headers" not in messages.columns else F.concat(own, "headers")
    if trace is not None:
        headers = F.concat(F.transform(F.map_entries(trace), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("binary").alias("value"))), headers)
    return messages.select("topic", F.col("key").cast("binary").alias("key"), F.col("payload").cast("binary").alias("value"), headers.alias("headers"))


def failure_records(outcomes: DataFrame, group: str, failure_topic: str) -> DataFrame:
    """(topic, key, value, headers) of messages that failed other than terminally, as write_kafka takes them: original key and
    payload, and seven headers on where they come from."""
    failed = outcomes.where((F.col("kind") == "message") & F.col("category").isin("transient", "permanent"))
    values = {
        "source-kind": F.lit("message"),
        "source-topic": F.col("topic"),
        "source-partition": F.col("part").cast("string"),
        "source-offset": F.col("off").cast("string"),
        "source-timestamp": rfc3339_ms(F.col("ts_us")),
        "source-group-id": F.lit(group),
        "source-error": F.col("error"),
    }
    headers = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value")) for k, v in values.items()])
    return failed.select(F.lit(failure_topic).alias("topic"), F.col("key").cast("binary").alias("key"), F.col("payload").cast("binary").alias("value"), headers.alias("headers"))


def producer_options(servers: str, mode: str = "pipeline", send_timeout_s: float = 1.0) -> dict[str, str]:
    """Settings of the producer: pipeline mode waits without end, the others send_timeout_s for a delivery."""
    fixed = {"kafka.bootstrap.servers": servers, "kafka.compression.type": "lz4", "kafka.enable.idempotence": "true", "includeHeaders": "true"}
    if mode == "pipeline":
        return fixed | {"kafka.delivery.timeout.ms": str(2**31 - 1)}
    ms = str(int(send_timeout_s * 1000))  # a request may take no longer than a delivery
    return fixed | {"kafka.delivery.timeout.ms": ms, "kafka.request.timeout.ms": ms, "kafka.linger.ms": "0"}


def write_kafka(records: DataFrame, servers: str, options: dict[str, str] | None = None, mode: str = "pipeline") -> None:
    """Append records to Kafka with the mode's settings; needs the connector package."""
    settings = producer_options(servers, mode) | (options or {})
    records.write.format("kafka").options(**settings).save()
