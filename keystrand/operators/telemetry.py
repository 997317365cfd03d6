"""Lifecycle events and their JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrand.functions.scalars import rfc3339_ms, rfc3339_s


def lifecycle(invocations: DataFrame) -> DataFrame:
    """Two rows per invocation: dispatched at its start, succeeded or failed at its end."""
    ended = F.when(F.col("outcome") == "success", "message.succeeded").otherwise("message.failed")
    events = F.array(
        F.struct(F.lit("message.dispatched").alias("type"), F.col("start_ms").alias("at_ms")),
        F.struct(ended.alias("type"), F.col("end_ms").alias("at_ms")),
    )
    return invocations.withColumn("_e", F.explode(events)).select("*", "_e.type", "_e.at_ms").drop("_e")


def to_json(events: DataFrame, source: str, hostname: str) -> DataFrame:
    """(key, value): the telemetry contract of messages; fields that don't apply are left out.

    exception is that column's if there is one; trace fields come from map column trace.
    """
    error = F.col("exception") if "exception" in events.columns else F.lit("handler failed")
    failed = F.col("type") == "message.failed"
    fields = F.struct(
        "type", rfc3339_ms(F.col("at_ms") * 1000).alias("eventTime"), F.col("off").alias("offset"), "topic", F.col("part").alias("partition"), "key",
        F.lit(source).alias("source"), F.lit(hostname).alias("hostname"), F.col("demand").alias("demandType"),
        F.when(failed, F.col("outcome")).alias("errorCategory"), F.when(failed, error).alias("exception"), *_trace_fields(events),
    )
    return events.select("key", F.to_json(fields).alias("value"))


def _trace_fields(events: DataFrame) -> list:
    if "trace" not in events.columns:
        return []
    return [F.element_at("trace", "traceparent").alias("traceParent"), F.element_at("trace", "tracestate").alias("traceState")]


def timer_json(events: DataFrame, source: str, hostname: str) -> DataFrame:
    """(key, value) of timer events (type, at_ms, time_s, timer_type as a name, topic, part, key, demand, category, exception):
    scheduled and cancelled ones have no demand, only failed ones an error."""
    failed = F.col("type") == "timer.failed"
    ran = ~F.col("type").isin("timer.scheduled", "timer.cancelled")
    fields = F.struct(
        "type", rfc3339_ms(F.col("at_ms") * 1000).alias("eventTime"), rfc3339_s(F.col("time_s")).alias("scheduledTime"), F.col("timer_type").alias("timerType"), "topic",
        F.col("part").alias("partition"), "key", F.lit(source).alias("source"), F.lit(hostname).alias("hostname"), F.when(ran, F.col("demand")).alias("demandType"),
        F.when(failed, F.col("category")).alias("errorCategory"), F.when(failed, F.col("exception")).alias("exception"), *_trace_fields(events),
    )
    return events.select("key", F.to_json(fields).alias("value"))


def sent_json(records: DataFrame, source: str, hostname: str) -> DataFrame:
    """(key, value) of message.sent events for delivered records (topic, part, off, key, at_ms)."""
    fields = F.struct(
        F.lit("message.sent").alias("type"), rfc3339_ms(F.col("at_ms") * 1000).alias("eventTime"), "topic", F.col("part").alias("partition"), F.col("off").alias("offset"), "key",
        F.lit(source).alias("source"), F.lit(hostname).alias("hostname"), *_trace_fields(records),
    )
    return records.select("key", F.to_json(fields).alias("value"))


def handler_durations(events: DataFrame) -> DataFrame:
    """(key columns, off, run_ms): completions paired with the latest open dispatch of their key, each used once."""
    w = Window.partitionBy("topic", "part", "key").orderBy("at_ms", "off", F.col("type") != "message.dispatched")
    paired = events.withColumn("_t", F.lag("type").over(w)).withColumn("_at", F.lag("at_ms").over(w))
    done = (F.col("type") != "message.dispatched") & (F.col("_t") == "message.dispatched")
    return paired.where(done).select("topic", "part", "key", "off", (F.col("at_ms") - F.col("_at")).alias("run_ms"))


def with_traces(log: DataFrame, relation: str = "child") -> DataFrame:
    """parent_trace for a child relation, link_trace for follows_from, from map column trace."""
    parent = F.element_at("trace", "traceparent")
    none = F.lit(None).cast("string")
    return log.withColumn("parent_trace", parent if relation == "child" else none).withColumn("link_trace", parent if relation != "child" else none)
