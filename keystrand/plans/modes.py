"""Consumer plans in three modes, the handler surface, and an engine that runs them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.config import ConsumerSettings, DedupSettings, DeferSettings, MonopolizationSettings, RetrySettings
from keystrand.operators import decode, dedup, filters, offsets, outcome, runtime, windows
from keystrand.operators.runtime import KeyHandler, Policy
from keystrand.sources import sinks
from keystrand.sources.log import kafka_log
from keystrand.streaming.processors import dedup_stream, handler_stream

#: A handler adds column outcome (success, transient, permanent, terminal) to accepted rows.
Handler = Callable[[DataFrame], DataFrame]


class State(Enum):
    UNCONFIGURED = "unconfigured"
    CONFIGURATION_FAILED = "configuration failed"
    CONFIGURED = "configured"
    RUNNING = "running"


def prepared(log: DataFrame, settings: ConsumerSettings) -> DataFrame:
    """Identity fields, then the stateless filters: below everything stateful."""
    return filters.accepted(decode.identify(log), settings.source, settings.allowed_events or [])


def pipeline(log: DataFrame, handler: Handler, settings: ConsumerSettings, deduplicate: bool = True, gate: MonopolizationSettings | None = None) -> DataFrame:
    """Filters, handler, monopolization gate, outcome-aware deduplication; rows with result, resolution and action."""
    rows = handler(prepared(log, settings))
    if gate is not None and gate.enabled:
        runs = rows.select("topic", "part", "key", "off", F.floor(F.col("ts_us") / 1000).alias("start_ms"), (F.floor(F.col("ts_us") / 1000) + F.col("duration_ms")).alias("end_ms"))
        rated = windows.monopolization(windows.disjoint(runs), int(gate.window_s * 1000), gate.threshold)
        rows = rows.join(rated.select("topic", "part", "key", "off", "rejected"), ["topic", "part", "key", "off"])
        rows = rows.withColumn("outcome", F.when(F.col("rejected"), "transient").otherwise(F.col("outcome")))
    if deduplicate:  # a stream keeps what was seen in state, a table sees all rows at once
        rows = dedup_stream(rows) if rows.isStreaming else dedup.outcome_aware(rows)
    return _resolved(rows, "pipeline")


def policy_of(retry: RetrySettings, defer: DeferSettings, gate: MonopolizationSettings, dedup_settings: DedupSettings) -> Policy:
    """The handler stack's policy from the settings of pipeline mode."""
    return Policy(
        dedup_ttl_s=int(dedup_settings.ttl_s) if dedup_settings.cache_size else 0, defers=defer.enabled, defer_base_s=int(defer.base_s), defer_max_s=int(defer.max_s),
        gate_share=gate.threshold if gate.enabled else None, gate_window_ms=int(gate.window_s * 1000), retry_base_ms=int(retry.base_s * 1000), retry_max_ms=int(retry.max_delay_s * 1000),
    )


def handled(log: DataFrame, handler: Callable[[], KeyHandler], settings: ConsumerSettings, policy: Policy | None = None, until_ms: int | None = None) -> DataFrame:
    """Pipeline mode around a handler with timers and hooks: the filters, then its stack for each key; what became of each event.

    A stream runs on processing time, a table on the clock of its messages and then until until_ms.
    """
    rows = prepared(log, settings)
    return handler_stream(rows, handler, policy) if rows.isStreaming else runtime.run(rows, handler, policy, until_ms)


def low_latency(log: DataFrame, handler: Handler, settings: ConsumerSettings) -> DataFrame:
    """Filters and handler; failures other than terminal ones go to the failure topic (failures())."""
    return _resolved(handler(prepared(log, settings)), "low-latency")


def best_effort(log: DataFrame, handler: Handler, settings: ConsumerSettings) -> DataFrame:
    """Filters and handler; failures are dropped."""
    return _resolved(handler(prepared(log, settings)), "best-effort")


def _resolved(rows: DataFrame, mode: str) -> DataFrame:
    return rows.withColumn("resolution", outcome.resolution(F.col("outcome"))).withColumn("action", outcome.by_mode(F.col("outcome"), mode))


def failures(resolved: DataFrame, settings: ConsumerSettings, failure_topic: str) -> DataFrame:
    """Records for the failure topic from low_latency()'s rows."""
    rows = resolved.where("action = 'routed'").withColumn("category", F.col("outcome")).withColumn("kind", F.lit("message")).withColumn("error", F.col("outcome"))
    return sinks.failure_records(rows, settings.group_id, failure_topic)


class Engine:
    """Subscribes handlers to logs as streaming queries and sends messages; the checkpoint holds the offsets."""

    def __init__(self, spark: SparkSession, settings: ConsumerSettings, servers: str = ""):
        self.spark, self.settings, self.servers, self.query = spark, settings, servers, None
        self.state = State.CONFIGURED if settings.group_id else State.CONFIGURATION_FAILED

    def subscribe(self, plan: Callable[[DataFrame], DataFrame], checkpoint: str, log: DataFrame | None = None, sink: Callable[[DataFrame, int], None] | None = None, **trigger):
        """Start the plan over a stream (by default the subscribed topics); micro-batches commit as a whole."""
        if self.state is not State.CONFIGURED:
            raise RuntimeError(f"can't subscribe: {self.state.value}")
        if log is None:
            log = decode.decode(kafka_log(self.spark, self.servers, self.settings.topics or [], options={"maxOffsetsPerTrigger": str(self.settings.max_uncommitted * 1000)}))
        writer = plan(log).writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"}))
        self.query = (writer.foreachBatch(sink) if sink else writer.format("noop")).start()
        self.state, self._heard = State.RUNNING, datetime.now(UTC)
        return self.query

    def unsubscribe(self) -> None:
        if self.query is not None:
            self.query.stop()
        self.query, self.state = None, State.CONFIGURED

    def send(self, messages: DataFrame) -> None:
        """Deduplicate messages (topic, key, off, payload) by id and write them to Kafka."""
        sinks.write_kafka(sinks.producer_records(dedup.produced(decode.identify(messages)), self.settings.source), self.servers)

    def ready(self) -> bool:
        """At least one source partition is assigned, or the query has begun."""
        return self.query is not None and self.query.isActive and self.query.lastProgress is not None

    def live(self) -> bool:
        """No error, and a sign of life within the stall threshold."""
        return self.query is None or (self.query.exception() is None and not self.stalled())

    def stalled(self, now: datetime | None = None) -> bool:
        """The query's last progress, or its start, is further back than the stall threshold."""
        if self.query is None:
            return False
        progress = self.query.lastProgress
        if progress is not None:
            self._heard = max(self._heard, datetime.fromisoformat(progress["timestamp"]) + timedelta(milliseconds=progress["batchDuration"]))
        return ((now or datetime.now(UTC)) - self._heard).total_seconds() > self.settings.stall_threshold_s

    @staticmethod
    def watermarks(resolved: DataFrame) -> DataFrame:
        """What each partition could commit: terminal outcomes stay open."""
        return offsets.commit_watermark(resolved, F.col("resolution") == "commit")
