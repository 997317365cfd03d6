"""Error categories, retries and what an outcome resolves to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Broker and client error codes that aren't transient (fixed values).
TERMINAL_CODES = ("Fatal", "Fenced", "FencedInstanceId", "ProducerFenced", "CriticalSystemResource")
PERMANENT_CODES = (
    "BadMessage", "InvalidMessage", "InvalidRecord", "MessageSizeTooLarge", "InvalidMessageSize", "KeySerialization", "ValueSerialization",
    "KeyDeserialization", "ValueDeserialization", "BadCompression", "UnsupportedCompressionType", "InvalidTimestamp", "InvalidDifferentRecord",
)
#: Other error sources: (family, error) -> category.
OTHER_ERRORS = {
    ("store", "Syntax"): "terminal", ("store", "Invalid"): "terminal", ("store", "TypeCheck"): "terminal", ("store", "Serialization"): "permanent", ("store", "Oversize"): "permanent",
    ("producer", "Config"): "terminal", ("producer", "Hostname"): "terminal", ("producer", "Serialization"): "permanent", ("producer", "Clock"): "transient",
    ("infallible", "Infallible"): "terminal", ("io", "Io"): "transient", ("defer", "Config"): "terminal", ("context", "InvalidContext"): "permanent",
}


def classify(family: Column, code: Column) -> Column:
    """Category of an error; what isn't known is transient."""
    broker = F.when(code.isin(*TERMINAL_CODES), "terminal").when(code.isin(*PERMANENT_CODES), "permanent").otherwise("transient")
    out = F.when(family == "broker", broker)
    for (f, c), category in OTHER_ERRORS.items():
        out = out.when((family == f) & (code == c), category)
    return out.otherwise("transient")


def attempts(messages: DataFrame, failures: Column, max_retries: int = 3) -> DataFrame:
    """One row per call of the handler: attempt, demand and result; the bounded retry makes max_retries + 1 calls at most.

    `failures` is how many calls fail transiently before the outcome in column outcome.
    """
    calls = F.least(failures + 1, F.lit(max_retries + 1)).cast("int")
    rows = messages.withColumn("_f", failures).withColumn("attempt", F.explode(F.sequence(F.lit(1), calls)))
    demand = F.when(F.col("attempt") == 1, "normal").otherwise("failure")
    return rows.withColumn("demand", demand).withColumn("result", F.when(F.col("attempt") <= F.col("_f"), "transient").otherwise(F.col("outcome"))).drop("_f")


def gated(shutdown: Column, cancelled: Column, result: Column) -> Column:
    """Result behind the cancellation gate: no call on shutdown or cancel; transient errors in a shutdown become terminal."""
    return F.when(shutdown & ~cancelled, F.when(result == "transient", "terminal").otherwise(result)).when(cancelled & shutdown, "terminal").when(cancelled, "transient").otherwise(result)


def refused(shutdown: Column, cancelled: Column) -> Column:
    """What the gate answers without a call: terminal on shutdown, transient when cancelled, null to let the call through."""
    return F.when(shutdown, "terminal").when(cancelled, "transient")


def timed_out(duration_ms: Column, stall_threshold_s: int = 300, share: float = 0.8) -> Column:
    return duration_ms > int(stall_threshold_s * 1000 * share)


def resolution(result: Column) -> Column:
    """commit with after_commit, or abort with after_abort on terminal errors."""
    return F.when(result == "terminal", "abort").otherwise("commit")


def by_mode(result: Column, mode: str) -> Column:
    """What becomes of a result: done, retried, deferred, routed, dropped or aborted."""
    end = F.when(result == "terminal", "aborted").when(result == "success", "done")
    if mode == "pipeline":
        return end.when(result == "transient", "deferred").otherwise("done")
    if mode == "low-latency":
        return end.otherwise("routed")
    return end.otherwise("dropped")
