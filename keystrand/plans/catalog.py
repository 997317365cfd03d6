"""Named queries over the canonical log, one or more per operator, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.config import ConsumerSettings
from keystrand.functions import scalars as fn
from keystrand.operators import decode, dedup, defer, filters, migrations, offsets, outcome, runtime, telemetry, timers, windows
from keystrand.plans import modes
from keystrand.sources import log as logs
from keystrand.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

NOW_US, NOW_MS, NOW_S = logs.NOW_US, logs.NOW_US // 1000, logs.NOW_US // 1_000_000
GROUP = logs.GROUP
PREFIXES = ["view", "click.v1", "purchase", "error"]
SLAB = 3600

LOG = """log AS (
  SELECT 'events' AS topic, CAST(user_id % 4 AS INT) AS part, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS off,
    concat('user-', CAST(user_id AS VARCHAR)) AS key, epoch_us(ts) AS ts_us, event_id, event_type,
    CASE WHEN event_id % 10 = 0 THEN 'analytics' WHEN event_id % 10 = 1 THEN NULL ELSE concat('svc-', CAST(event_id % 3 AS VARCHAR)) END AS source_system,
    concat('{"seq":', CAST(event_id AS VARCHAR),
      CASE WHEN event_id % 7 = 0 THEN concat(',"id":', CAST(event_id AS VARCHAR)) WHEN event_id % 7 = 1 THEN '' ELSE concat(',"id":"', event_type, '-', CAST(day(ts) AS VARCHAR), '"') END,
      CASE WHEN event_id % 11 = 0 THEN '' ELSE concat(',"type":"', event_type, '.v', CAST(event_id % 2 + 1 AS VARCHAR), '"') END, '}') AS payload,
    CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'permanent' WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'transient' ELSE 'success' END AS outcome,
    1 + event_id % 997 AS duration_ms FROM events)"""
IDS = """ids AS (SELECT *, CASE WHEN json_type(payload, '$.id') = 'VARCHAR' THEN payload->>'$.id' END AS id,
    CASE WHEN json_type(payload, '$.type') = 'VARCHAR' THEN payload->>'$.type' END AS type FROM log)"""
DROPS = f"""drops AS (SELECT *, CASE WHEN source_system = '{GROUP}' THEN 'loop' WHEN type IS NOT NULL AND NOT ({' OR '.join(f"starts_with(type, '{p}')" for p in PREFIXES)}) THEN 'type' END AS reason FROM ids)"""
IDENT = "ident AS (SELECT *, id IS NOT NULL AS by_id, coalesce(id, CAST(off AS VARCHAR)) AS identity FROM ids)"
INV = """inv AS (SELECT *, ts_us // 1000 AS start_ms, ts_us // 1000 + duration_ms AS end_ms, CASE WHEN outcome = 'transient' THEN 'failure' ELSE 'normal' END AS demand FROM log)"""
BUSY = """busy AS (SELECT * REPLACE (least(start_ms + duration_ms * 60, coalesce(lead(start_ms) OVER (PARTITION BY part, key ORDER BY start_ms, off), start_ms + duration_ms * 60)) AS end_ms) FROM inv)"""
CMD = """cmd AS (SELECT part, key, event_id AS ord, CASE event_type WHEN 'signup' THEN 'schedule' WHEN 'view' THEN 'schedule' WHEN 'click' THEN 'unschedule' WHEN 'purchase' THEN 'clear_and_schedule' ELSE 'clear' END AS op,
    ts_us // 60000000 * 60 + 3600 * (1 + event_id % 48) AS time_s, CAST(event_id % 3 AS INT) AS timer_type FROM log)"""
TIM = "tim AS (SELECT DISTINCT part, key, timer_type, time_s FROM cmd WHERE op IN ('schedule', 'clear_and_schedule'))"
QUEUE = """queue AS (SELECT * FROM (SELECT *, min(CASE WHEN outcome = 'transient' THEN off END) OVER (PARTITION BY part, key) AS first_off FROM log) WHERE off >= first_off)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _ids(s, d):
    return decode.identify(logs.event_log(s, d))


def _invocations(s, d):
    demand = F.when(F.col("outcome") == "transient", "failure").otherwise("normal")
    start = F.floor(F.col("ts_us") / 1000)
    return logs.event_log(s, d).withColumn("start_ms", start).withColumn("end_ms", start + F.col("duration_ms")).withColumn("demand", demand)


def _busy(s, d):
    return windows.disjoint(_invocations(s, d).withColumn("end_ms", F.col("start_ms") + F.col("duration_ms") * 60))


def _commands(s, d):
    e = F.col("event_type")
    op = F.when(e.isin("signup", "view"), "schedule").when(e == "click", "unschedule").when(e == "purchase", "clear_and_schedule").otherwise("clear")
    time_s = F.floor(F.col("ts_us") / 60_000_000) * 60 + 3600 * (1 + F.col("event_id") % 48)
    return logs.event_log(s, d).select("part", "key", F.col("event_id").alias("ord"), op.alias("op"), time_s.alias("time_s"), (F.col("event_id") % 3).cast("int").alias("timer_type"))


def _timers(s, d):
    return _commands(s, d).where(F.col("op").isin("schedule", "clear_and_schedule")).select("part", "key", "timer_type", "time_s").distinct()


def _queue(s, d):
    return defer.deferred_offsets(logs.event_log(s, d))


@query("canonical_log", f"WITH {LOG} SELECT topic, part, off, key, ts_us, source_system, payload, outcome FROM log")
def canonical_log(s, d):
    return logs.event_log(s, d).select("topic", "part", "off", "key", "ts_us", "source_system", "payload", "outcome")


@query("decode_fields", f"WITH {LOG}, {IDS} SELECT part, off, id, type FROM ids")
def decode_fields(s, d):
    return _ids(s, d).select("part", "off", "id", "type")


def _raw(s, d):
    eid = F.col("event_id")
    raw = logs.event_log(s, d)
    headers = F.array(F.struct(F.lit("trace").alias("key"), F.lit("x").cast("binary").alias("value")), F.struct(F.lit("source-system").alias("key"), F.col("source_system").cast("binary").alias("value")))
    return raw.select(
        "topic", "part", "off", F.when(eid % 41 == 0, F.lit(None)).otherwise(F.col("key")).cast("binary").alias("raw_key"),
        F.when(eid % 43 == 0, F.lit(None)).when(eid % 47 == 0, F.expr("left(payload, 5)")).otherwise(F.col("payload")).cast("binary").alias("raw_payload"),
        headers.alias("headers"), F.when(eid % 13 == 0, F.lit(None)).otherwise(F.col("ts_us")).alias("ts_us"),
    )


RAW = """raw AS (SELECT part, off, CASE WHEN event_id % 41 <> 0 THEN key END AS key, CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 47 = 0 THEN left(payload, 5) ELSE payload END AS payload,
    source_system, CASE WHEN event_id % 13 <> 0 THEN ts_us END AS ts_us FROM log)"""


@query("decode_reject", f"WITH {LOG}, {RAW} SELECT CASE WHEN key IS NULL THEN 'no_key' WHEN payload IS NULL THEN 'no_payload' WHEN NOT json_valid(payload) THEN 'bad_payload' END AS reason, count(*) AS n FROM raw GROUP BY 1")
def decode_reject(s, d):
    reason = decode.reject_reason(F.col("raw_key").cast("string"), F.col("raw_payload").cast("string"))
    return _raw(s, d).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("decode_accept", f"WITH {LOG}, {RAW} SELECT part, off, key, source_system, coalesce(ts_us, {NOW_US}) AS ts_us FROM raw WHERE key IS NOT NULL AND payload IS NOT NULL AND json_valid(payload)")
def decode_accept(s, d):
    return decode.decode(_raw(s, d), NOW_US).select("part", "off", "key", "source_system", "ts_us")


@query("decode_json_binary", f"WITH {LOG}, {IDS} SELECT CASE WHEN json_type(payload, '$.id') NOT IN ('VARCHAR', 'NULL') THEN 'bad_identity' END AS reason, count(*) AS n FROM ids GROUP BY 1")
def decode_json_binary(s, d):
    return logs.event_log(s, d).groupBy(decode.reject_reason(F.col("key"), F.col("payload"), "json_binary").alias("reason")).agg(F.count("*").alias("n"))


@query("encode_json", """SELECT event_id, concat('{', CASE WHEN event_id % 7 = 0 THEN concat('"id":', event_id, ',') WHEN event_id % 7 <> 1 THEN concat('"id":"', event_type, '-', day(ts), '",') ELSE '' END,
 '"seq":', event_id, CASE WHEN event_id % 11 <> 0 THEN concat(',"type":"', event_type, '.v', event_id % 2 + 1, '"') ELSE '' END, '}') AS value FROM events""")
def encode_json(s, d):
    spaced = F.replace(F.col("payload"), F.lit(","), F.lit(" ,\n "))
    return logs.event_log(s, d).select("event_id", decode.encode(spaced).cast("string").alias("value"))


@query("binary_extractor", f"""WITH {LOG} SELECT part, off, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS type FROM log WHERE event_id % 10 <> 7""")
def binary_extractor(s, d):
    """Payloads whose number ends in 7 are unreadable to this extractor."""

    def extract(payload):
        text = payload.cast("string")
        type_ = F.nullif(F.regexp_extract(text, r'"type":"(\w+)\.', 1), F.lit(""))
        return F.when(~text.rlike(r'"seq":\d*7\b'), F.struct(F.regexp_extract(text, r'"seq":(\d+)', 1).alias("id"), type_.alias("type")))

    return decode.extracted(logs.event_log(s, d).withColumn("payload", F.col("payload").cast("binary")), extract).select("part", "off", "id", "type")


@query("filter_stale", f"""WITH {LOG}, arr AS (SELECT part, off, off * 1000 AS arrival FROM log UNION ALL SELECT part, off, (off + 10) * 1000 + 1 FROM log WHERE off % 50 = 0)
SELECT part, off, arrival, off <= coalesce(max(off) OVER (PARTITION BY part ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS stale FROM arr""")
def filter_stale(s, d):
    log = logs.event_log(s, d).select("topic", "part", "off")
    again = log.where("off % 50 = 0").withColumn("arrival", (F.col("off") + 10) * 1000 + 1)
    return filters.with_stale(log.withColumn("arrival", F.col("off") * 1000).unionByName(again)).select("part", "off", "arrival", "stale")


@query("filter_loop", f"WITH {LOG} SELECT part, off FROM log WHERE source_system IS DISTINCT FROM '{GROUP}'")
def filter_loop(s, d):
    return logs.event_log(s, d).where(~filters.is_loop(F.col("source_system"), GROUP)).select("part", "off")


@query("filter_event_type", f"WITH {LOG}, {IDS}, {DROPS} SELECT part, off, type FROM drops WHERE reason IS DISTINCT FROM 'type' OR source_system = '{GROUP}' AND type IS NULL")
def filter_event_type(s, d):
    rows = _ids(s, d).where(filters.drop_reason(GROUP, PREFIXES).isNull() | filters.is_loop(F.col("source_system"), GROUP))
    return rows.select("part", "off", "type")


@query("filter_reason_counts", f"WITH {LOG}, {IDS}, {DROPS} SELECT part, reason, count(*) AS n FROM drops GROUP BY 1, 2")
def filter_reason_counts(s, d):
    return _ids(s, d).groupBy("part", filters.drop_reason(GROUP, PREFIXES).alias("reason")).agg(F.count("*").alias("n"))


@query("commit_watermark", f"""WITH {LOG}, {IDS}, {DROPS}, f AS (SELECT *, reason IS NOT NULL OR outcome <> 'transient' OR off < 100 AS done FROM drops),
w AS (SELECT *, min(CASE WHEN NOT done THEN off END) OVER (PARTITION BY topic, part) AS lo FROM f)
SELECT topic, part, max(off) FILTER (WHERE done AND off < coalesce(lo, 9223372036854775807)) AS watermark, max(off) FILTER (WHERE done AND off < coalesce(lo, 9223372036854775807)) + 1 AS commit_position FROM w GROUP BY 1, 2""")
def commit_watermark(s, d):
    done = filters.drop_reason(GROUP, PREFIXES).isNotNull() | (F.col("outcome") != "transient") | (F.col("off") < 100)
    return offsets.commit_watermark(_ids(s, d), done)


@query("stalled_offset", f"WITH {LOG} SELECT topic, part, min(off) AS off, arg_min(ts_us, off) + 300000000 <= {NOW_US} AS stalled FROM log WHERE outcome = 'transient' GROUP BY 1, 2")
def stalled_offset(s, d):
    return offsets.stalled(logs.event_log(s, d), F.col("outcome") == "transient", F.col("ts_us"), NOW_US)


@query("partition_status", f"WITH {LOG}, st AS (SELECT part, arg_min(ts_us, off) + 300000000 <= {NOW_US} AS stalled FROM log WHERE outcome = 'transient' GROUP BY 1) SELECT (SELECT count(DISTINCT part) FROM log) AS assigned, (SELECT coalesce(bool_or(stalled), false) FROM st) AS any_stalled")
def partition_status(s, d):
    log = logs.event_log(s, d)
    return offsets.partition_status(log, offsets.stalled(log, F.col("outcome") == "transient", F.col("ts_us"), NOW_US))


@query("dedup_consumer", f"WITH {LOG}, {IDS}, {IDENT} SELECT part, off, key, identity FROM ident QUALIFY row_number() OVER (PARTITION BY topic, part, key, by_id, identity ORDER BY off) = 1")
def dedup_consumer(s, d):
    return dedup.first_only(_ids(s, d)).select("part", "off", "key", "identity")


@query("dedup_outcome_aware", f"WITH {LOG}, {IDS}, {IDENT} SELECT part, off, outcome FROM (SELECT *, min(CASE WHEN outcome IN ('success', 'permanent') THEN off END) OVER (PARTITION BY topic, part, key, by_id, identity) AS cut FROM ident) WHERE cut IS NULL OR off <= cut")
def dedup_outcome_aware(s, d):
    return dedup.outcome_aware(_ids(s, d)).select("part", "off", "outcome")


@query("dedup_producer", f"WITH {LOG}, {IDS} SELECT part, off, id FROM ids QUALIFY id IS NULL OR row_number() OVER (PARTITION BY topic, key, id ORDER BY off) = 1")
def dedup_producer(s, d):
    return dedup.produced(_ids(s, d)).select("part", "off", "id")


@query("dedup_store", f"WITH {LOG}, {IDS}, {IDENT}, st AS (SELECT DISTINCT part, key, by_id, identity FROM ident WHERE event_id % 3 = 0 AND outcome IN ('success', 'permanent')) SELECT part, off FROM ident i WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.part = i.part AND st.key = i.key AND st.by_id = i.by_id AND st.identity = i.identity)")
def dedup_store(s, d):
    """All of the log against a store that holds what another run recorded of it."""
    log = _ids(s, d)
    return dedup.unseen(log, dedup.stored(log.withColumn("outcome", F.when(F.col("event_id") % 3 == 0, F.col("outcome"))))).select("part", "off")


@query("dedup_expiry", f"WITH {LOG}, {IDS}, {IDENT} SELECT part, key, identity, by_id, min(ts_us) AS inserted_us, min(ts_us) + 604800000000 AS expires_us FROM ident WHERE outcome IN ('success', 'permanent') GROUP BY 1, 2, 3, 4")
def dedup_expiry(s, d):
    return dedup.stored(_ids(s, d)).select("part", "key", "identity", "by_id", "inserted_us", "expires_us")


@query("dedup_ttl", f"""WITH RECURSIVE {LOG}, {IDS}, {IDENT}, o AS (SELECT *, row_number() OVER (PARTITION BY part, key, by_id, identity ORDER BY off) AS r FROM ident),
f AS (SELECT part, key, by_id, identity, r, off, true AS kept, CASE WHEN outcome IN ('success', 'permanent') THEN ts_us + 21600000000 END AS until FROM o WHERE r = 1
 UNION ALL SELECT o.part, o.key, o.by_id, o.identity, o.r, o.off, f.until IS NULL OR o.ts_us >= f.until,
  CASE WHEN (f.until IS NULL OR o.ts_us >= f.until) AND o.outcome IN ('success', 'permanent') THEN o.ts_us + 21600000000 ELSE f.until END
 FROM o JOIN f ON o.part = f.part AND o.key = f.key AND o.by_id = f.by_id AND o.identity = f.identity AND o.r = f.r + 1)
SELECT part, off FROM f WHERE kept""")
def dedup_ttl(s, d):
    return dedup.with_ttl(_ids(s, d).select("topic", "part", "key", "off", "ts_us", "id", "outcome"), 6 * 3600).select("part", "off")


#: Errors of each family with the category they must have.
ERRORS = [
    *[("broker", c, "terminal") for c in ("Fatal", "Fenced", "FencedInstanceId", "ProducerFenced", "CriticalSystemResource")],
    *[("broker", c, "permanent") for c in ("BadMessage", "InvalidMessage", "InvalidRecord", "MessageSizeTooLarge", "InvalidMessageSize", "KeySerialization", "ValueSerialization", "KeyDeserialization", "ValueDeserialization", "BadCompression", "UnsupportedCompressionType", "InvalidTimestamp", "InvalidDifferentRecord")],
    *[("broker", c, "transient") for c in ("RequestTimedOut", "BrokerTransportFailure", "LeaderNotAvailable", "NotCoordinator", "QueueFull")],
    ("store", "Syntax", "terminal"), ("store", "Invalid", "terminal"), ("store", "TypeCheck", "terminal"), ("store", "Serialization", "permanent"), ("store", "Oversize", "permanent"), ("store", "Timeout", "transient"),
    ("producer", "Config", "terminal"), ("producer", "Hostname", "terminal"), ("producer", "Serialization", "permanent"), ("producer", "Clock", "transient"),
    ("infallible", "Infallible", "terminal"), ("io", "Io", "transient"), ("defer", "Config", "terminal"), ("context", "InvalidContext", "permanent"),
]
ERRORS_SQL = ", ".join(f"({i}, '{f}', '{c}', '{k}')" for i, (f, c, k) in enumerate(ERRORS))


@query("classify_errors", f"SELECT family, code, category, count(*) AS n FROM events JOIN (VALUES {ERRORS_SQL}) e(i, family, code, category) ON event_id % {len(ERRORS)} = i GROUP BY 1, 2, 3")
def classify_errors(s, d):
    at = (F.col("event_id") % len(ERRORS) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(e[k]) for e in ERRORS]), at)
    rows = logs.event_log(s, d).select(pick(0).alias("family"), pick(1).alias("code"))
    return rows.groupBy("family", "code", outcome.classify(F.col("family"), F.col("code")).alias("category")).agg(F.count("*").alias("n"))


@query("retry_attempts", f"""WITH {LOG}, a AS (SELECT part, off, event_id % 6 AS fails, outcome, unnest(range(1, least(event_id % 6 + 1, 4) + 1)) AS attempt FROM log)
SELECT part, off, CAST(attempt AS INT) AS attempt, CASE WHEN attempt = 1 THEN 'normal' ELSE 'failure' END AS demand, CASE WHEN attempt <= fails THEN 'transient' ELSE outcome END AS result,
 CAST(least(20.0 * pow(2, attempt), 300000) AS BIGINT) AS wait_bound_ms FROM a""")
def retry_attempts(s, d):
    rows = outcome.attempts(logs.event_log(s, d), F.col("event_id") % 6)
    return rows.select("part", "off", "attempt", "demand", "result", fn.retry_bound_ms(F.col("attempt")).alias("wait_bound_ms"))


@query("resolution", f"""WITH {LOG}, r AS (SELECT CASE WHEN event_id % 17 = 0 THEN 'terminal' ELSE outcome END AS result FROM log)
SELECT m.mode, result, CASE WHEN result = 'terminal' THEN 'abort' ELSE 'commit' END AS resolution,
 CASE WHEN result = 'terminal' THEN 'aborted' WHEN result = 'success' THEN 'done' WHEN m.mode = 'pipeline' THEN CASE WHEN result = 'transient' THEN 'deferred' ELSE 'done' END WHEN m.mode = 'low-latency' THEN 'routed' ELSE 'dropped' END AS action, count(*) AS n
FROM r, (VALUES ('pipeline'), ('low-latency'), ('best-effort')) m(mode) GROUP BY 1, 2, 3, 4""")
def resolution(s, d):
    result = F.when(F.col("event_id") % 17 == 0, "terminal").otherwise(F.col("outcome"))
    rows = logs.event_log(s, d).select(result.alias("result"))
    modes = [F.struct(F.lit(m).alias("mode"), outcome.by_mode(F.col("result"), m).alias("action")) for m in ("pipeline", "low-latency", "best-effort")]
    rows = rows.select("result", F.explode(F.array(*modes)).alias("m"))
    return rows.groupBy("m.mode", "result", outcome.resolution(F.col("result")).alias("resolution"), "m.action").agg(F.count("*").alias("n"))


@query("cancellation_gate", f"""WITH {LOG} SELECT part, off, CASE WHEN event_id % 23 = 0 THEN 'terminal' WHEN event_id % 19 = 0 THEN 'transient' END AS refused,
 CASE WHEN event_id % 23 = 0 AND event_id % 19 = 0 THEN 'terminal' WHEN event_id % 23 = 0 THEN CASE WHEN outcome = 'transient' THEN 'terminal' ELSE outcome END WHEN event_id % 19 = 0 THEN 'transient' ELSE outcome END AS result FROM log""")
def cancellation_gate(s, d):
    shutdown, cancelled = F.col("event_id") % 23 == 0, F.col("event_id") % 19 == 0
    return logs.event_log(s, d).select("part", "off", outcome.refused(shutdown, cancelled).alias("refused"), outcome.gated(shutdown, cancelled, F.col("outcome")).alias("result"))


@query("timeout_flag", f"WITH {LOG} SELECT part, off FROM log WHERE duration_ms * 300 > 240000")
def timeout_flag(s, d):
    return logs.event_log(s, d).where(outcome.timed_out(F.col("duration_ms") * 300)).select("part", "off")


@query("dlq_route", f"""WITH {LOG} SELECT 'failures' AS topic, key, payload, concat('source-kind=message;source-topic=', topic, ';source-partition=', CAST(part AS VARCHAR), ';source-offset=', CAST(off AS VARCHAR), ';source-timestamp=',
 strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%S.'), lpad(CAST(ts_us % 1000000 // 1000 AS VARCHAR), 3, '0'), 'Z;source-group-id={GROUP};source-error=handler failed: ', outcome) AS headers FROM log WHERE outcome <> 'success' AND event_id % 5 <> 0""")
def dlq_route(s, d):
    rows = logs.event_log(s, d).withColumn("category", F.when(F.col("outcome") != "success", F.col("outcome"))).withColumn("kind", F.when(F.col("event_id") % 5 == 0, "timer").otherwise("message"))
    out = sinks.failure_records(rows.withColumn("error", F.concat(F.lit("handler failed: "), "outcome")), GROUP, "failures")
    text = F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string"))), ";")
    return out.select("topic", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("payload"), text.alias("headers"))


@query("producer_records", f"WITH {LOG} SELECT topic, key, payload AS value, concat('source-system=', coalesce('{GROUP}', '')) AS headers FROM log")
def producer_records(s, d):
    out = sinks.producer_records(logs.event_log(s, d), GROUP)
    return out.select("topic", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.array_join(F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string"))), ";").alias("headers"))


@query("timer_slab_assign", f"WITH {LOG}, {CMD}, {TIM} SELECT part, key, timer_type, time_s, time_s // {SLAB} AS slab_id, time_s // {SLAB} * {SLAB} AS slab_start, (time_s // {SLAB} + 1) * {SLAB} AS slab_end FROM tim")
def timer_slab_assign(s, d):
    return timers.with_slab(_timers(s, d), SLAB)


@query("slab_neighbours", f"WITH {LOG}, sl AS (SELECT DISTINCT CASE WHEN off % 5 = 0 THEN 0 WHEN off % 5 = 1 THEN 4294967295 ELSE ts_us // 3600000000 END AS slab_id FROM log) SELECT slab_id, CASE WHEN slab_id < 4294967295 THEN slab_id + 1 END AS following, CASE WHEN slab_id > 0 THEN slab_id - 1 END AS previous, CASE WHEN slab_id <= 4294967195 THEN slab_id + 100 END AS later FROM sl")
def slab_neighbours(s, d):
    slab = F.when(F.col("off") % 5 == 0, 0).when(F.col("off") % 5 == 1, fn.MAX_SECONDS).otherwise(F.floor(F.col("ts_us") / 3_600_000_000))
    slabs = logs.event_log(s, d).select(slab.alias("slab_id")).distinct()
    return slabs.select("slab_id", *[fn.slab_plus(F.col("slab_id"), n).alias(name) for n, name in ((1, "following"), (-1, "previous"), (100, "later"))])


@query("timer_slab_scan", f"WITH {LOG}, {CMD}, {TIM} SELECT part, key, timer_type, time_s FROM tim WHERE time_s // {SLAB} BETWEEN 473500 AND 473800")
def timer_slab_scan(s, d):
    return timers.slab_scan(timers.with_slab(_timers(s, d), SLAB), 473_500, 473_800).select("part", "key", "timer_type", "time_s")


@query("timer_due_scan", f"WITH {LOG}, {CMD}, {TIM} SELECT part, key, timer_type, time_s, {NOW_S} - time_s AS late_s FROM tim WHERE time_s <= {NOW_S}")
def timer_due_scan(s, d):
    return timers.due(_timers(s, d), NOW_S)


@query("timer_key_scan", f"WITH {LOG}, {CMD}, {TIM} SELECT timer_type, time_s FROM tim WHERE key = 'user-7'")
def timer_key_scan(s, d):
    return timers.key_scan(_timers(s, d), "user-7").select("timer_type", "time_s")


@query("slab_rebucket", f"WITH {LOG}, {CMD}, {TIM} SELECT part, time_s // 600 AS slab_id, count(*) AS n FROM tim GROUP BY 1, 2")
def slab_rebucket(s, d):
    return timers.rebucketed(_timers(s, d), 600).groupBy("part", "slab_id").agg(F.count("*").alias("n"))


@query("reused_slabs", f"WITH {LOG}, {CMD}, {TIM} SELECT DISTINCT part, time_s // 3600 AS slab_id FROM tim a WHERE EXISTS (SELECT 1 FROM tim b WHERE b.part = a.part AND b.time_s // 3599 = a.time_s // 3600)")
def reused_slabs(s, d):
    t = _timers(s, d)
    return timers.reused_slabs(timers.rebucketed(t, 3600), timers.rebucketed(t, 3599))


@query("completed_slabs", f"WITH {LOG}, {CMD}, {TIM} SELECT DISTINCT part, ts_us // 3600000000 AS slab_id FROM log l WHERE (ts_us // 3600000000 + 1) * 3600 <= {NOW_S} AND NOT EXISTS (SELECT 1 FROM tim t WHERE t.part = l.part AND t.time_s // 3600 = l.ts_us // 3600000000 AND time_s > 1705400000)")
def completed_slabs(s, d):
    loaded = logs.event_log(s, d).select("part", F.floor(F.col("ts_us") / 3_600_000_000).alias("slab_id")).distinct()
    return timers.completed_slabs(loaded, timers.with_slab(_timers(s, d).where("time_s > 1705400000"), SLAB), NOW_S, SLAB)


@query("key_states", f"WITH {LOG}, {CMD}, {TIM} SELECT part, key, timer_type, count(*) AS n, max(time_s) AS latest_s, CASE WHEN count(*) = 1 THEN 'inline' ELSE 'overflow' END AS state FROM tim GROUP BY 1, 2, 3")
def key_states(s, d):
    return timers.key_states(_timers(s, d))


@query("row_ttl", f"WITH {LOG}, {CMD}, {TIM} SELECT part, key, time_s, CASE WHEN greatest(time_s - {NOW_S}, 0) + 630600000 < 630720000 THEN greatest(time_s - {NOW_S}, 0) + 630600000 END AS ttl_s FROM tim")
def row_ttl(s, d):
    return _timers(s, d).select("part", "key", "time_s", fn.row_ttl(F.col("time_s"), NOW_S, 630_600_000).alias("ttl_s"))


def _uuid5_sql(namespace: str, name: str) -> str:
    return f"""(SELECT concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-', translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab'), substr(h, 18, 3), '-', substr(h, 21, 12)) FROM (SELECT sha1(unhex('{namespace}') || CAST({name} AS BLOB)) AS h))"""


@query("segment_uuid5", f"WITH {LOG}, p AS (SELECT DISTINCT topic, part FROM log) SELECT part, {_uuid5_sql(fn.NAMESPACE_URL, f"concat('{GROUP}:', topic, '/', CAST(part AS VARCHAR))")} AS timer_segment, {_uuid5_sql(fn.NAMESPACE_OID, f"concat(topic, '/', CAST(part AS VARCHAR), ':{GROUP}')")} AS defer_segment FROM p")
def segment_uuid5(s, d):
    p = logs.event_log(s, d).select("topic", "part").distinct()
    return p.select("part", timers.timer_segment_id(F.lit(GROUP), F.col("topic"), F.col("part")).alias("timer_segment"), timers.defer_segment_id(F.lit(GROUP), F.col("topic"), F.col("part")).alias("defer_segment"))


@query("compact_time", f"WITH {LOG} SELECT part, off, (ts_us + event_id * 1000 + 500000) // 1000000 AS time_s, CASE WHEN (ts_us + event_id * 1000 + 500000) // 1000000 + event_id * 100000 <= 4294967295 THEN (ts_us + event_id * 1000 + 500000) // 1000000 + event_id * 100000 END AS added, CASE WHEN ts_us // 1000000 >= 1705000000 THEN ts_us // 1000000 - 1705000000 END AS since, least(event_id * 1000000, 4294967295) AS clamped FROM log")
def compact_time(s, d):
    t = fn.compact_seconds(F.col("ts_us") + F.col("event_id") * 1000)
    return logs.event_log(s, d).select("part", "off", t.alias("time_s"), fn.checked_add(t, F.col("event_id") * 100_000).alias("added"), fn.checked_difference(F.floor(F.col("ts_us") / 1_000_000), F.lit(1_705_000_000)).alias("since"), fn.saturating(F.col("event_id") * 1_000_000).alias("clamped"))


@query("defer_backoff", "SELECT n AS retry, CASE WHEN n = 0 THEN 0 ELSE greatest(1, CAST(least(pow(2, n - 1), 86400) AS BIGINT)) END AS bound_s FROM range(0, 25) t(n)")
def defer_backoff(s, d):
    return s.range(25).select(F.col("id").alias("retry"), fn.defer_bound_s(F.col("id")).alias("bound_s"))


@query("lifecycle_events", f"WITH {LOG}, {INV} SELECT part, off, key, 'message.dispatched' AS type, start_ms AS at_ms FROM inv UNION ALL SELECT part, off, key, CASE WHEN outcome = 'success' THEN 'message.succeeded' ELSE 'message.failed' END, end_ms FROM inv")
def lifecycle_events(s, d):
    return telemetry.lifecycle(_invocations(s, d)).select("part", "off", "key", "type", "at_ms")


@query("lifecycle_json", f"""WITH {LOG}, {INV}, ev AS (SELECT *, 'message.dispatched' AS type, start_ms AS at_ms FROM inv UNION ALL SELECT *, CASE WHEN outcome = 'success' THEN 'message.succeeded' ELSE 'message.failed' END, end_ms FROM inv)
SELECT key, concat('{{"type":"', type, '","eventTime":"', strftime(make_timestamp(at_ms * 1000), '%Y-%m-%dT%H:%M:%S.'), lpad(CAST(at_ms % 1000 AS VARCHAR), 3, '0'), 'Z","offset":', CAST(off AS VARCHAR), ',"topic":"', topic, '","partition":', CAST(part AS VARCHAR), ',"key":"', key,
 '","source":"{GROUP}","hostname":"host-1","demandType":"', demand, '"', CASE WHEN type = 'message.failed' THEN concat(',"errorCategory":"', outcome, '","exception":"handler failed"') ELSE '' END, '}}') AS value FROM ev""")
def lifecycle_json(s, d):
    return telemetry.to_json(telemetry.lifecycle(_invocations(s, d)), GROUP, "host-1")


@query("handler_durations", f"WITH {LOG}, {INV}, {BUSY} SELECT part, key, off, end_ms - start_ms AS run_ms FROM busy WHERE end_ms > start_ms")
def handler_durations(s, d):
    return telemetry.handler_durations(telemetry.lifecycle(_busy(s, d).where("end_ms > start_ms"))).drop("topic")


@query("failure_rate", f"WITH {LOG}, sec AS (SELECT DISTINCT ts_us // 1000000 AS at_s FROM log) SELECT at_s, round(avg(CASE WHEN outcome = 'success' THEN 0.0 ELSE 1.0 END), 9) AS rate FROM sec JOIN log ON ts_us // 1000000 BETWEEN at_s - 300 AND at_s GROUP BY 1")
def failure_rate(s, d):
    return windows.failure_rate(logs.event_log(s, d)).select("at_s", F.round("rate", 9).alias("rate"))


@query("defer_decision", f"WITH {LOG}, sec AS (SELECT DISTINCT ts_us // 1000000 AS at_s FROM log), r AS (SELECT at_s, sum(CASE WHEN outcome = 'success' THEN 0 ELSE 1 END) AS bad, count(*) AS n FROM sec JOIN log ON ts_us // 1000000 BETWEEN at_s - 3600 AND at_s GROUP BY 1) SELECT at_s, bad / n < 0.5 AS defers FROM r")
def defer_decision(s, d):
    return windows.failure_rate(logs.event_log(s, d), 3600).select("at_s", windows.defers(F.col("rate"), 0.5).alias("defers"))


@query("monopolization", f"""WITH {LOG}, {INV}, {BUSY}, m AS (SELECT a.part, a.key, a.off, sum(greatest(0, least(b.end_ms, a.start_ms) - greatest(b.start_ms, a.start_ms - 300000))) AS busy_ms
 FROM busy a JOIN busy b ON a.part = b.part AND a.key = b.key AND b.start_ms <= a.start_ms AND b.end_ms >= a.start_ms - 300000 GROUP BY 1, 2, 3)
SELECT part, key, off, CAST(busy_ms AS BIGINT) AS busy_ms, round(busy_ms / 300000, 9) AS ratio, busy_ms > 270000 AS rejected FROM m""")
def monopolization(s, d):
    return windows.monopolization(_busy(s, d)).select("part", "key", "off", "busy_ms", F.round("ratio", 9).alias("ratio"), "rejected")


@query("virtual_time", f"WITH {LOG}, {INV} SELECT part, key, round(sum(duration_ms * pow(2.0, -({NOW_MS} - end_ms) / 1000.0 / 86400.0)), 6) AS vt_ms FROM inv WHERE end_ms <= {NOW_MS} GROUP BY 1, 2")
def virtual_time(s, d):
    runs = _invocations(s, d).withColumn("run_ms", F.col("duration_ms"))
    return windows.virtual_time(runs, NOW_MS, 86_400.0).select("part", "key", F.round("vt_ms", 6).alias("vt_ms"))


TASKS = f"""vt AS (SELECT part, key, sum(duration_ms * pow(2.0, -({NOW_MS} - end_ms) / 1000.0 / 86400.0)) AS vt_ms FROM inv WHERE end_ms <= {NOW_MS} GROUP BY 1, 2),
task AS (SELECT part, key, off, demand, start_ms AS enqueue_ms FROM inv),
ranked AS (SELECT task.*, round(coalesce(vt_ms, 0) / 1000.0 - 200 * pow(least(({NOW_MS} - enqueue_ms) / 1000.0 / 2000000.0, 1.0), 2), 6) AS priority FROM task LEFT JOIN vt USING (part, key)),
cls AS (SELECT demand, sum(duration_ms * pow(2.0, -({NOW_MS} - end_ms) / 1000.0 / 86400.0)) AS class_ms FROM inv WHERE end_ms <= {NOW_MS} GROUP BY 1)"""


def _rated(s, d):
    inv = _invocations(s, d)
    vt = windows.virtual_time(inv.withColumn("run_ms", F.col("duration_ms")), NOW_MS, 86_400.0)
    tasks = inv.select("topic", "part", "key", "off", "demand", F.col("start_ms").alias("enqueue_ms"))
    tasks = tasks.join(vt, ["topic", "part", "key"], "left").withColumn("vt_ms", F.coalesce("vt_ms", F.lit(0.0)))
    return windows.priorities(tasks, NOW_MS, max_wait_s=2_000_000.0).withColumn("priority", F.round("priority", 6))


@query("schedule_priorities", f"WITH {LOG}, {INV}, {TASKS} SELECT part, key, off, demand, priority, row_number() OVER (PARTITION BY demand ORDER BY priority, enqueue_ms, off) AS rank FROM ranked")
def schedule_priorities(s, d):
    return windows.ranked(_rated(s, d)).select("part", "key", "off", "demand", "priority", "rank")


@query("class_selection", f"WITH {LOG}, {INV}, {TASKS} SELECT CASE WHEN coalesce(max(class_ms) FILTER (WHERE demand = 'normal'), 0) / 0.7 <= coalesce(max(class_ms) FILTER (WHERE demand = 'failure'), 0) / 0.3 THEN 'normal' ELSE 'failure' END AS demand FROM cls")
def class_selection(s, d):
    return windows.next_class(windows.class_time(_invocations(s, d).withColumn("run_ms", F.col("duration_ms")), NOW_MS, 86_400.0))


@query("schedule_pick", f"""WITH {LOG}, {INV}, {TASKS}, c AS (SELECT CASE WHEN coalesce(max(class_ms) FILTER (WHERE demand = 'normal'), 0) / 0.7 <= coalesce(max(class_ms) FILTER (WHERE demand = 'failure'), 0) / 0.3 THEN 'normal' ELSE 'failure' END AS chosen FROM cls)
SELECT part, off, ranked.demand FROM ranked, c ORDER BY ranked.demand <> chosen, priority, enqueue_ms, off LIMIT 1""")
def schedule_pick(s, d):
    chosen = windows.next_class(windows.class_time(_invocations(s, d).withColumn("run_ms", F.col("duration_ms")), NOW_MS, 86_400.0))
    return windows.schedule_pick(_rated(s, d), chosen).select("part", "off", "demand")


@query("heartbeat_stall", f"WITH {LOG}, g AS (SELECT part, off, ts_us - lag(ts_us) OVER (PARTITION BY part ORDER BY ts_us, off) AS gap_us FROM log) SELECT part, off, gap_us FROM g WHERE gap_us > 300000000")
def heartbeat_stall(s, d):
    return windows.heartbeat_edges(logs.event_log(s, d)).where("stalled").select("part", "off", "gap_us")


@query("interval_overlap", f"WITH {LOG}, {INV} SELECT part, off, greatest(0, least(end_ms, start_ms // 1000 * 1000 + 500) - greatest(start_ms, start_ms // 1000 * 1000)) AS overlap_ms FROM inv")
def interval_overlap(s, d):
    second = F.floor(F.col("start_ms") / 1000) * 1000
    return _invocations(s, d).select("part", "off", windows.interval_overlap(F.col("start_ms"), F.col("end_ms"), second, second + 500).alias("overlap_ms"))


@query("deferred_head", f"WITH {LOG}, {QUEUE} SELECT part, key, min(off) AS head, count(*) AS waiting FROM queue GROUP BY 1, 2")
def deferred_head(s, d):
    return defer.heads(_queue(s, d)).drop("topic")


@query("deferred_next", f"WITH {LOG}, {QUEUE}, h AS (SELECT part, key, min(off) AS removed FROM queue GROUP BY 1, 2) SELECT part, key, removed, min(off) FILTER (WHERE off > removed) AS next FROM queue JOIN h USING (part, key) GROUP BY 1, 2, 3")
def deferred_next(s, d):
    q = _queue(s, d)
    return defer.after_removal(q, defer.heads(q).withColumnRenamed("head", "off")).drop("topic")


@query("deferred_load_join", f"""WITH {LOG}, {QUEUE}, want AS (SELECT part, off, CASE WHEN off % 29 = 0 THEN 'other' ELSE key END AS key FROM queue)
SELECT w.part, w.off, w.key, CASE WHEN l.key IS NULL THEN 'deleted' WHEN l.key <> w.key THEN 'key_mismatch' ELSE 'found' END AS status FROM want w LEFT JOIN (SELECT * FROM log WHERE off % 97 <> 0) l USING (part, off)""")
def deferred_load_join(s, d):
    want = _queue(s, d).select("topic", "part", "off", F.when(F.col("off") % 29 == 0, "other").otherwise(F.col("key")).alias("key"))
    return logs.load(want, logs.event_log(s, d).where("off % 97 <> 0")).select("part", "off", "key", "status")


@query("load_undecodable", f"""WITH {LOG}, {QUEUE}, broken AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN left(payload, 5) ELSE payload END AS found FROM log WHERE off % 97 <> 0)
SELECT q.part, q.off, CASE WHEN b.off IS NULL THEN 'deleted' WHEN NOT json_valid(b.found) THEN 'undecodable' ELSE 'found' END AS status FROM queue q LEFT JOIN broken b USING (part, off)""")
def load_undecodable(s, d):
    broken = F.when(F.col("event_id") % 5 == 0, F.expr("left(payload, 5)")).otherwise(F.col("payload"))
    log = logs.event_log(s, d).where("off % 97 <> 0").withColumn("payload", broken)
    return logs.load(_queue(s, d).select("topic", "part", "off", "key"), log).select("part", "off", "status")


@query("deferred_routing", f"WITH {LOG}, k AS (SELECT DISTINCT part, key FROM log WHERE outcome = 'transient') SELECT part, key, k.key IS NOT NULL AS queued, count(*) AS n FROM log l LEFT JOIN k USING (part, key) GROUP BY 1, 2, 3")
def deferred_routing(s, d):
    log = logs.event_log(s, d)
    return defer.routed(log, log.where("outcome = 'transient'")).groupBy("part", "key", "queued").agg(F.count("*").alias("n"))


@query("scheduled_times_union", f"WITH {LOG}, {CMD}, {TIM} SELECT part, key, time_s FROM tim WHERE timer_type = 0 UNION SELECT part, key, ts_us // 1000000 FROM log WHERE outcome = 'transient'")
def scheduled_times_union(s, d):
    waiting = logs.event_log(s, d).where("outcome = 'transient'").select("part", "key", F.floor(F.col("ts_us") / 1_000_000).alias("time_s"))
    return defer.visible_times(_timers(s, d).where("timer_type = 0"), waiting)


@query("listed_times", f"WITH {LOG}, {CMD}, {TIM} SELECT part, key, timer_type, time_s FROM tim WHERE time_s % 180 <> 60")
def listed_times(s, d):
    state = F.when(F.col("time_s") % 180 == 60, "firing").when(F.col("time_s") % 180 == 0, "scheduled")
    return timers.listed_times(_timers(s, d).withColumn("state", state)).drop("state")


@query("timer_replay", f"""WITH {LOG}, {CMD}, t AS (SELECT part, key, timer_type, time_s, max(CASE WHEN op IN ('schedule', 'clear_and_schedule') THEN ord END) AS added FROM cmd GROUP BY 1, 2, 3, 4)
SELECT part, key, timer_type, time_s FROM t WHERE added IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cmd c WHERE c.part = t.part AND c.key = t.key AND c.timer_type = t.timer_type AND c.ord > t.added
 AND (c.op = 'clear' OR c.op = 'unschedule' AND c.time_s = t.time_s OR c.op = 'clear_and_schedule' AND c.time_s <> t.time_s))""")
def timer_replay(s, d):
    return timers.scheduled_after(_commands(s, d))


#: Waits add up to 0, 1, 3 and 7 seconds for 0 to 3 failed tries.
BUSY = "[0, 1, 3, 7]"
ARRIVALS = """arr AS (SELECT part, key, off AS ord, off, ts_us // 1000000 AS at_s, outcome, event_id % 4 AS fails FROM log)"""


def _replay_sql(source: str, base: int = 3600) -> str:
    """Recursion over each key's messages: a queue lasts until its messages' tries have ended."""
    took = f"{BUSY}[fails + 1] * {base}"
    return f"""o AS (SELECT *, {took} AS took, row_number() OVER (PARTITION BY part, key ORDER BY ord) AS r FROM {source}),
f AS (SELECT part, key, r, CASE WHEN outcome = 'transient' THEN 'deferred' ELSE 'handled' END AS action, CASE WHEN outcome = 'transient' THEN at_s + took END AS done_s FROM o WHERE r = 1
 UNION ALL SELECT o.part, o.key, o.r, CASE WHEN o.at_s < coalesce(f.done_s, -1) THEN 'queued' WHEN o.outcome = 'transient' THEN 'deferred' ELSE 'handled' END,
  CASE WHEN o.at_s < coalesce(f.done_s, -1) THEN f.done_s + o.took WHEN o.outcome = 'transient' THEN o.at_s + o.took END
 FROM o JOIN f ON o.part = f.part AND o.key = f.key AND o.r = f.r + 1),
replayed AS (SELECT o.*, action, done_s FROM o JOIN f USING (part, key, r))"""


def _replayed(s, d):
    log = logs.event_log(s, d)
    events = log.select("topic", "part", "key", "off", F.col("off").alias("ord"), F.floor(F.col("ts_us") / 1_000_000).alias("at_s"), "outcome", (F.col("event_id") % 4).alias("fails"))
    return defer.replay(events, base_s=3600)


@query("defer_replay", f"WITH RECURSIVE {LOG}, {ARRIVALS}, {_replay_sql('arr')} SELECT part, key, off, action, done_s FROM replayed")
def defer_replay(s, d):
    return _replayed(s, d).select("part", "key", "off", "action", "done_s")


@query("deferred_retries", f"""WITH RECURSIVE {LOG}, {ARRIVALS}, {_replay_sql('arr')}, a AS (SELECT *, unnest(range(0, fails + 1)) AS attempt FROM replayed WHERE action IN ('deferred', 'queued'))
SELECT part, key, off, CAST(attempt AS INT) AS attempt, done_s - took + {BUSY}[attempt + 1] * 3600 AS at_s, attempt < fails AS failed FROM a""")
def deferred_retries(s, d):
    return defer.retries(_replayed(s, d), base_s=3600).select("part", "key", "off", "attempt", "at_s", "failed")


FIRED = """fired AS (SELECT part, key, time_s AS ord, time_s AS at_s, CASE WHEN time_s // 60 % 3 = 0 THEN 'transient' ELSE 'success' END AS outcome, time_s // 60 % 4 AS fails FROM tim WHERE timer_type = 0)"""


@query("timer_defer_replay", f"WITH RECURSIVE {LOG}, {CMD}, {TIM}, {FIRED}, {_replay_sql('fired')} SELECT part, key, ord AS original_time_s, action, done_s FROM replayed")
def timer_defer_replay(s, d):
    """Application timers whose handler fails transiently wait in their key's queue under their original time."""
    return _replayed_timers(s, d).select("part", "key", F.col("ord").alias("original_time_s"), "action", "done_s")


def _replayed_timers(s, d):
    minute = F.floor(F.col("time_s") / 60)
    fired = _timers(s, d).where("timer_type = 0").select("part", "key", F.col("time_s").alias("ord"), F.col("time_s").alias("at_s"), F.when(minute % 3 == 0, "transient").otherwise("success").alias("outcome"), (minute % 4).alias("fails"))
    return defer.replay(fired, ("part", "key"), base_s=3600)


WAITING_S = 1_705_000_000
WAITING = f"waiting AS (SELECT * FROM replayed WHERE action IN ('deferred', 'queued') AND at_s <= {WAITING_S} AND done_s > {WAITING_S})"


@query("deferred_times", f"WITH RECURSIVE {LOG}, {CMD}, {TIM}, {FIRED}, {_replay_sql('fired')}, {WAITING} SELECT part, key, ord AS original_time_s FROM waiting")
def deferred_times(s, d):
    return defer.waiting_at(_replayed_timers(s, d), WAITING_S).select("part", "key", F.col("ord").alias("original_time_s"))


@query("timer_defer_heads", f"""WITH RECURSIVE {LOG}, {CMD}, {TIM}, {FIRED}, {_replay_sql('fired')}, {WAITING}
SELECT part, key, min(ord) AS head_s, count(*) AS waiting, CASE WHEN greatest(min(ord) - {WAITING_S - 9000}, 0) + 630716000 < 630720000 THEN greatest(min(ord) - {WAITING_S - 9000}, 0) + 630716000 END AS ttl_s FROM waiting GROUP BY 1, 2""")
def timer_defer_heads(s, d):
    return defer.timer_heads(defer.waiting_at(_replayed_timers(s, d), WAITING_S), WAITING_S - 9000, 630_716_000)


class _Scripted(runtime.KeyHandler):
    """A call on arrival ends as the payload says; then so many tries from the queue fail as its number says."""

    def __init__(self):
        self.tries: dict[int, int] = {}

    def on_message(self, context, message):
        result, fails = message.payload.split()
        if context.demand == "failure":
            self.tries[message.off] = self.tries.get(message.off, 0) + 1
            if self.tries[message.off] <= int(fails):
                raise runtime.HandlerError
        elif result != "success":
            raise runtime.PermanentError if result == "permanent" else runtime.HandlerError


@query("handler_run", f"""WITH RECURSIVE {LOG}, arr AS (SELECT part, key, off AS ord, off, ts_us // 1000 AS at_s, outcome, event_id % 4 AS fails FROM log), {_replay_sql('arr', 3_600_000)},
a AS (SELECT *, unnest(range(0, fails + 1)) AS attempt FROM replayed WHERE action IN ('deferred', 'queued'))
SELECT part, key, off, at_s AS at_ms, 'normal' AS demand, CASE WHEN action = 'handled' THEN outcome END AS outcome, CASE WHEN action = 'handled' THEN 'done' ELSE action END AS action FROM replayed
UNION ALL SELECT part, key, off, done_s - took + {BUSY}[attempt + 1] * 3600000, 'failure', CASE WHEN attempt < fails THEN 'transient' ELSE 'success' END, CASE WHEN attempt < fails THEN 'deferred' ELSE 'done' END FROM a""")
def handler_run(s, d):
    """Every call of a handler over the log, those from its queues included."""
    told = F.concat("outcome", F.lit(" "), (F.col("event_id") % 4).cast("string"))
    log = logs.event_log(s, d).withColumn("id", F.lit(None).cast("string")).withColumn("payload", told)
    rows = runtime.run(log, _Scripted, runtime.Policy(dedup_ttl_s=0, defer_base_s=3600), NOW_MS * 2)
    return rows.select("part", "key", F.col("id").alias("off"), "at_ms", "demand", "outcome", "action")


@query("mode_handled", f"""WITH {LOG}, {IDS}, {DROPS}, i AS (SELECT *, id IS NOT NULL AS by_id, coalesce(id, CAST(off AS VARCHAR)) AS identity FROM drops WHERE reason IS NULL)
SELECT part, off, CASE WHEN row_number() OVER (PARTITION BY part, key, by_id, identity ORDER BY off) = 1 THEN 'done' ELSE 'duplicate' END AS action FROM i""")
def mode_handled(s, d):
    """Filters, then a handler that succeeds behind deduplication: each identity reaches it once."""
    rows = modes.handled(logs.event_log(s, d), runtime.KeyHandler, _settings(), runtime.Policy(dedup_ttl_s=630_720_000))
    return rows.select("part", F.col("id").alias("off"), "action")


@query("defer_strategies", f"""WITH {LOG}, r AS (SELECT *, event_id % 100 / 100.0 AS rate FROM log WHERE outcome = 'transient')
SELECT part, off, strategy, CASE strategy WHEN 'always' THEN true WHEN 'never' THEN false WHEN 'trace' THEN coalesce(CASE WHEN event_id % 5 <> 0 THEN event_id % 2 = 0 END, true) ELSE rate < 0.9 END AS defers FROM r, (VALUES ('always'), ('never'), ('trace'), ('rate')) t(strategy)""")
def defer_strategies(s, d):
    eid = F.col("event_id")
    trace = F.when(eid % 5 != 0, eid % 2 == 0)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), defer.decided(n, (eid % 100) / 100.0, trace=trace).alias("defers")) for n in ("always", "never", "trace", "rate")]))
    return logs.event_log(s, d).where("outcome = 'transient'").select("part", "off", each.alias("s")).select("part", "off", "s.*")


@query("decayed_algebra", f"""WITH {LOG}, v AS (SELECT part, off, duration_ms * 1000 AS x, off * 250 AS x_at, event_id % 911 * 1000 AS y, event_id % 60000 AS y_at FROM log),
w AS (SELECT *, greatest(x_at, y_at) AS at_ms, CAST(floor(x * pow(2.0, -((greatest(x_at, y_at) - x_at) / 1000.0) / 120.0)) AS BIGINT) AS dx, CAST(floor(y * pow(2.0, -((greatest(x_at, y_at) - y_at) / 1000.0) / 120.0)) AS BIGINT) AS dy FROM v)
SELECT part, off, at_ms, dx + dy AS sum, greatest(dx - dy, 0) AS difference, sign(dx - dy)::INT AS compared FROM w""")
def decayed_algebra(s, d):
    eid = F.col("event_id")
    a = F.struct((F.col("duration_ms") * 1000).alias("value"), (F.col("off") * 250).alias("at_ms"))
    b = F.struct((eid % 911 * 1000).alias("value"), (eid % 60_000).alias("at_ms"))
    total = fn.decayed_sum(a, b)
    return logs.event_log(s, d).select("part", "off", total["at_ms"].alias("at_ms"), total["value"].alias("sum"), fn.decayed_difference(a, b)["value"].alias("difference"), fn.decayed_compare(a, b).alias("compared"))


@query("slab_load_plan", f"""WITH {LOG}, tick AS (SELECT DISTINCT part, ts_us // 1000000 // 900 * 900 AS now_s FROM log), p AS (SELECT *, (now_s + 1830) // {SLAB} AS last_slab FROM tick)
SELECT part, now_s, coalesce(max(last_slab) OVER (PARTITION BY part ORDER BY now_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) AS first_slab, last_slab, greatest(0, (last_slab + 1) * {SLAB} - now_s - 1830) AS wait_s FROM p""")
def slab_load_plan(s, d):
    ticks = logs.event_log(s, d).select("part", (F.floor(F.col("ts_us") / 900_000_000) * 900).alias("now_s")).distinct()
    return timers.load_plan(ticks, timers.preload_s(SLAB, 0.5), SLAB)


TIMER_EVENTS = """te AS (SELECT part, key, time_s, CASE timer_type WHEN 0 THEN 'application' WHEN 1 THEN 'deferredMessage' ELSE 'deferredTimer' END AS timer_type,
  unnest(['timer.scheduled', 'timer.dispatched', CASE WHEN time_s // 60 % 5 = 0 THEN 'timer.failed' ELSE 'timer.succeeded' END]) AS type, unnest([time_s * 1000 - 60000, time_s * 1000, time_s * 1000 + 250]) AS at_ms FROM tim)"""


def _rfc(us: str) -> str:
    return f"concat(strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S.'), lpad(CAST({us} % 1000000 // 1000 AS VARCHAR), 3, '0'), 'Z')"


@query("timer_lifecycle_json", f"""WITH {LOG}, {CMD}, {TIM}, {TIMER_EVENTS}
SELECT key, concat('{{"type":"', type, '","eventTime":"', {_rfc("CAST(at_ms * 1000 AS BIGINT)")}, '","scheduledTime":"', strftime(make_timestamp(CAST(time_s * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ'), '","timerType":"', timer_type,
 '","topic":"events","partition":', part, ',"key":"', key, '","source":"{GROUP}","hostname":"host-1"', CASE WHEN type <> 'timer.scheduled' THEN ',"demandType":"normal"' ELSE '' END,
 CASE WHEN type = 'timer.failed' THEN concat(',"errorCategory":"transient","exception":"late by ', time_s % 7, '"') ELSE '' END, ',"traceParent":"00-', time_s, '-01"}}') AS value FROM te""")
def timer_lifecycle_json(s, d):
    t = F.col("time_s")
    last = F.when(F.floor(t / 60) % 5 == 0, "timer.failed").otherwise("timer.succeeded")
    each = [(F.lit("timer.scheduled"), t * 1000 - 60_000), (F.lit("timer.dispatched"), t * 1000), (last, t * 1000 + 250)]
    events = _timers(s, d).withColumn("timer_type", fn.timer_type_name(F.col("timer_type"))).select("*", F.explode(F.array(*[F.struct(k.alias("type"), at.alias("at_ms")) for k, at in each])).alias("e")).select("*", "e.*")
    events = events.withColumn("topic", F.lit("events")).withColumn("demand", F.lit("normal")).withColumn("category", F.lit("transient"))
    events = events.withColumn("exception", F.concat(F.lit("late by "), (t % 7).cast("string"))).withColumn("trace", F.create_map(F.lit("traceparent"), F.concat(F.lit("00-"), t.cast("string"), F.lit("-01"))))
    return telemetry.timer_json(events, GROUP, "host-1")


@query("sent_json", f"""WITH {LOG} SELECT key, concat('{{"type":"message.sent","eventTime":"', {_rfc("ts_us")}, '","topic":"', topic, '","partition":', part, ',"offset":', off, ',"key":"', key, '","source":"{GROUP}","hostname":"host-1"}}') AS value FROM log""")
def sent_json(s, d):
    return telemetry.sent_json(logs.event_log(s, d).withColumn("at_ms", F.floor(F.col("ts_us") / 1000)), GROUP, "host-1")


@query("delete_records", f"WITH {LOG} SELECT part, count(*) AS n, min(off) AS first_off FROM log WHERE off >= CASE part WHEN 0 THEN 100 WHEN 2 THEN 50 ELSE 0 END GROUP BY 1")
def delete_records(s, d):
    return logs.delete_records(logs.event_log(s, d), {0: 100, 2: 50}).groupBy("part").agg(F.count("*").alias("n"), F.min("off").alias("first_off"))


@query("missing_topics", "SELECT DISTINCT topic FROM (VALUES ('click'), ('^vi.*'), ('unknown_type'), ('view')) t(topic) WHERE NOT starts_with(topic, '^') AND topic NOT IN (SELECT event_type FROM events)")
def missing_topics(s, d):
    existing = logs.event_log(s, d).select(F.col("event_type").alias("topic")).distinct()
    return logs.missing_topics(s.createDataFrame([("click",), ("^vi.*",), ("unknown_type",), ("view",)], "topic string"), existing)


@query("trace_links", f"WITH {LOG} SELECT part, off, CASE WHEN event_id % 3 <> 0 THEN concat('00-', lpad(CAST(event_id AS VARCHAR), 32, '0'), '-01') END AS parent_trace, CAST(NULL AS VARCHAR) AS link_trace FROM log")
def trace_links(s, d):
    trace = F.when(F.col("event_id") % 3 != 0, F.create_map(F.lit("traceparent"), F.concat(F.lit("00-"), F.lpad(F.col("event_id").cast("string"), 32, "0"), F.lit("-01"))))
    return telemetry.with_traces(logs.event_log(s, d).withColumn("trace", trace)).select("part", "off", "parent_trace", "link_trace")


@query("timer_type_names", f"WITH {LOG}, {CMD} SELECT CASE timer_type WHEN 0 THEN 'application' WHEN 1 THEN 'deferredMessage' ELSE 'deferredTimer' END AS name, count(*) AS n FROM cmd GROUP BY 1")
def timer_type_names(s, d):
    return _commands(s, d).groupBy(fn.timer_type_name(F.col("timer_type")).alias("name")).agg(F.count("*").alias("n"))


@query("events_union", f"WITH {LOG}, {CMD}, {TIM} SELECT 'message' AS kind, part, key, ts_us // 1000000 AS at_s FROM log UNION ALL SELECT 'timer', part, key, time_s FROM tim")
def events_union(s, d):
    messages = logs.event_log(s, d).select(F.lit("message").alias("kind"), "part", "key", F.floor(F.col("ts_us") / 1_000_000).alias("at_s"))
    return messages.unionByName(_timers(s, d).select(F.lit("timer").alias("kind"), "part", "key", F.col("time_s").alias("at_s")))



FILES = [("20250613_create_timers.cql", "-- timers\nCREATE TABLE {{ks}}.timers;\n\nCREATE TABLE x;\n"), ("20251126_create_offsets.cql", "CREATE TABLE y;"), ("20260319_create_dedup.cql", "CREATE TABLE z;")]
FILES_SQL = "f(filename, sql) AS (VALUES " + ", ".join(f"('{n}', '{t}')" for n, t in FILES) + ")"


def _files(s):
    return s.createDataFrame(FILES, "filename string, sql string")


@query("pending_migrations", f"WITH {FILES_SQL} SELECT filename, sha256(replace(sql, '{{{{ks}}}}', 'app')) AS checksum FROM f WHERE filename <> '20251126_create_offsets.cql'")
def pending_migrations(s, d):
    applied = s.createDataFrame([("20251126_create_offsets.cql",)], "filename string")
    return migrations.ordered(migrations.pending(_files(s), applied)).select("filename", migrations.checksum(migrations.substituted(F.col("sql"), {"ks": "app"})).alias("checksum"))


@query("validated_migrations", f"""WITH {FILES_SQL}, applied AS (SELECT filename, CASE WHEN filename LIKE '2026%' THEN 'other' ELSE sha256(sql) END AS checksum FROM f WHERE filename NOT LIKE '202506%' UNION ALL SELECT '20240101_gone.cql', 'x')
SELECT a.filename, CASE WHEN f.filename IS NULL THEN 'unknown' WHEN a.checksum <> sha256(f.sql) THEN 'changed' ELSE 'ok' END AS status FROM applied a LEFT JOIN f USING (filename)""")
def validated_migrations(s, d):
    import hashlib

    was = hashlib.sha256(FILES[1][1].encode()).hexdigest()
    applied = s.createDataFrame([(FILES[1][0], was), (FILES[2][0], "other"), ("20240101_gone.cql", "x")], "filename string, checksum string")
    return migrations.validated(_files(s), applied)


@query("migration_statements", f"WITH {FILES_SQL} SELECT filename, CAST(len(list_filter(string_split(sql, chr(10)), lambda l: regexp_matches(l, ';\\s*$') AND NOT starts_with(trim(l), '--'))) AS INT) AS n FROM f")
def migration_statements(s, d):
    return _files(s).select("filename", F.size(migrations.statements(F.col("sql"))).alias("n"))


@query("upgraded_timers", f"WITH {LOG}, {CMD}, {TIM} SELECT part, key, time_s, CAST(0 AS TINYINT) AS timer_type, time_s // 3600 AS slab_id, 3 AS version FROM (SELECT DISTINCT part, key, time_s FROM tim)")
def upgraded_timers(s, d):
    v1 = _timers(s, d).select("part", "key", "time_s").distinct().withColumn("version", F.lit(None).cast("int"))
    return migrations.upgraded_timers(v1, 3600)


@query("backfilled_key_states", f"""WITH {LOG}, {CMD}, {TIM}, st AS (SELECT part, key, timer_type, count(*) AS n, max(time_s) AS latest_s FROM tim GROUP BY 1, 2, 3)
SELECT part, key, timer_type, CASE WHEN n = 1 THEN 'inline' ELSE 'overflow' END AS state, CASE WHEN n = 1 THEN latest_s END AS inline_s, CASE WHEN greatest(latest_s - 1705000000, 0) + 630000000 < 630720000 THEN greatest(latest_s - 1705000000, 0) + 630000000 END AS ttl_s FROM st""")
def backfilled_key_states(s, d):
    return migrations.backfilled_states(_timers(s, d), 1_705_000_000, 630_000_000)


def _settings():
    return ConsumerSettings(group_id=GROUP, allowed_events=PREFIXES)


@query("mode_low_latency", f"WITH {LOG}, {IDS}, {DROPS} SELECT part, off, outcome, CASE WHEN outcome = 'success' THEN 'done' ELSE 'routed' END AS action FROM drops WHERE reason IS NULL")
def mode_low_latency(s, d):
    return modes.low_latency(logs.event_log(s, d), lambda rows: rows, _settings()).select("part", "off", "outcome", "action")


@query("mode_best_effort", f"WITH {LOG}, {IDS}, {DROPS} SELECT part, off, outcome, CASE WHEN outcome = 'success' THEN 'done' ELSE 'dropped' END AS action FROM drops WHERE reason IS NULL")
def mode_best_effort(s, d):
    return modes.best_effort(logs.event_log(s, d), lambda rows: rows, _settings()).select("part", "off", "outcome", "action")


@query("mode_pipeline", f"""WITH {LOG}, {IDS}, {DROPS}, i AS (SELECT *, id IS NOT NULL AS by_id, coalesce(id, CAST(off AS VARCHAR)) AS identity FROM drops WHERE reason IS NULL)
SELECT part, off, outcome, CASE WHEN outcome = 'transient' THEN 'deferred' ELSE 'done' END AS action FROM (SELECT *, min(CASE WHEN outcome IN ('success', 'permanent') THEN off END) OVER (PARTITION BY part, key, by_id, identity) AS cut FROM i) WHERE cut IS NULL OR off <= cut""")
def mode_pipeline(s, d):
    return modes.pipeline(logs.event_log(s, d), lambda rows: rows, _settings()).select("part", "off", "outcome", "action")
