"""Keyed stateful processors for Structured Streaming: deduplication, timers and deferral.

All work per key, sort a batch's rows by offset (their order isn't given), and turn waits into timers, so no task sleeps.
Spark names a timer by its instant alone; times are kept per (type, second) in state and one timer is registered for each
distinct instant.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keystrand.operators.defer import step
from keystrand.operators.dedup import MAX_TTL_S, MIN_TTL_S, TTL_S
from keystrand.operators.runtime import EVENT_SCHEMA, KeyHandler, KeyRunner, KeyState, Message, Policy, TerminalError, rows_of
from keystrand.operators.timers import apply_command

LOG_SCHEMA = "topic string, part int, key string, off bigint, ts_us bigint, id string, outcome string"
TIMER_SCHEMA = "part int, key string, timer_type int, time_s bigint, event string"
DEFER_SCHEMA = "topic string, part int, key string, off bigint, action string, done_s bigint"
#: How long a queue is remembered at least, so that a log that is replayed late still finds it.
GRACE_MS = 3_600_000


class DedupProcessor(StatefulProcessor):
    """Keeps rows up to the first recorded outcome of their identity; forgets it ttl_s of event time later. The state store drops
    an entry when as much processing time has passed, so state is bounded by what arrives in a TTL."""

    def __init__(self, ttl_s: int = TTL_S):
        self.ttl_us = min(max(ttl_s, MIN_TTL_S), MAX_TTL_S) * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "by_id boolean, identity string", "until bigint", self.ttl_us // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values("off")
        keep = []
        for off, at, id_, outcome in part[["off", "ts_us", "id", "outcome"]].itertuples(index=False):
            own = isinstance(id_, str)
            identity = (own, id_ if own else str(off))
            until = self.seen.getValue(identity)[0] if self.seen.containsKey(identity) else None
            keep.append(until is None or at >= until)
            if keep[-1] and outcome in ("success", "permanent"):
                self.seen.updateValue(identity, (int(at + self.ttl_us),))
        yield part[keep]

    def close(self) -> None:
        pass


class TimerProcessor(StatefulProcessor):
    """Runs timer commands of a (part, key, type) and fires due timers, which complete at once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getMapState("times", "time_s bigint", "state string")

    def _rows(self, key, events: list[tuple[int, str]]) -> pd.DataFrame:
        return pd.DataFrame([(*key, t, e) for t, e in events], columns=["part", "key", "timer_type", "time_s", "event"]).astype({"part": "int32", "timer_type": "int32"})

    def _store(self, had: dict[int, str], now: dict[int, str]) -> None:
        registered = {t.timestamp if hasattr(t, "timestamp") else t for t in self.handle.listTimers()}
        for t in had.keys() - now.keys():
            self.times.removeKey((t,))
            if t * 1000 in registered:
                self.handle.deleteTimer(t * 1000)
        for t, state in now.items():
            if had.get(t) != state:
                self.times.updateValue((t,), (state,))
            if t * 1000 not in registered:
                self.handle.registerTimer(t * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = {k[0]: v[0] for k, v in self.times.iterator()}
        now, events = dict(had), []
        for op, t in pd.concat(list(rows)).sort_values("ord")[["op", "time_s"]].itertuples(index=False):
            events += [(int(t), e) for e in apply_command(now, op, int(t))]
        self._store(had, now)
        yield self._rows(key, events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t = expiredTimerInfo.getExpiryTimeInMs() // 1000
        if not self.times.containsKey((t,)):
            yield self._rows(key, [])
            return
        self.times.removeKey((t,))
        yield self._rows(key, [(int(t), "fired")])

    def close(self) -> None:
        pass


class DeferProcessor(StatefulProcessor):
    """The deferral of operators.defer over a stream: per key one number, until when its queue lasts. A timer removes it once that
    instant has passed, so keys without a queue hold no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.busy = handle.getValueState("busy", "until_s bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        busy = self.busy.get()[0] if self.busy.exists() else None
        had, out = busy, []
        for off, at, outcome, fails in pd.concat(list(rows)).sort_values("off")[["off", "at_s", "outcome", "fails"]].itertuples(index=False):
            action, busy = step(busy, int(at), outcome, int(fails))
            out.append((*key, off, action, busy))
        if busy != had:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due.timestamp if hasattr(due, "timestamp") else due)
            if busy is None:
                self.busy.clear()
            else:
                self.busy.update((busy,))
                self.handle.registerTimer(max(busy * 1000, timerValues.getCurrentProcessingTimeInMs() + GRACE_MS))
        found = pd.DataFrame(out, columns=["topic", "part", "key", "off", "action", "done_s"])
        yield found.astype({"part": "int32", "done_s": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.busy.exists() and self.busy.get()[0] * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.busy.clear()
        return iter(())

    def close(self) -> None:
        pass


class StateMapping(MutableMapping):
    """A state store's map of single columns as a mapping; entries are read and written one by one."""

    def __init__(self, state):
        self.state = state

    def __getitem__(self, k):
        if not self.state.containsKey((k,)):
            raise KeyError(k)
        return self.state.getValue((k,))[0]

    def __setitem__(self, k, value):
        self.state.updateValue((k,), (value,))

    def __delitem__(self, k):
        self.state.removeKey((k,))

    def __iter__(self):
        return (k[0] for k in self.state.keys())

    def __len__(self):
        return sum(1 for _ in self)


class HandlerProcessor(StatefulProcessor):
    """A user's handler in operators.runtime's stack. One timer stands for whatever a key has due next; a terminal error ends
    the query, so that nothing of its batch is committed."""

    def __init__(self, handler: Callable[[], KeyHandler], policy: Policy):
        self.handler, self.policy = handler, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rest = handle.getValueState("rest", "text string")
        self.messages = JsonMapping(StateMapping(handle.getMapState("messages", "n bigint", "entry string")))
        self.blocked = JsonMapping(StateMapping(handle.getMapState("blocked", "n bigint", "entry string")))
        self.seen = StateMapping(handle.getMapState("seen", "identity string", "until bigint", max(self.policy.dedup_ttl_s, 1) * 1000))

    def _runner(self) -> KeyRunner:
        text = self.rest.get()[0] if self.rest.exists() else None
        return KeyRunner(self.handler(), self.policy, KeyState.loads(text, self.messages, self.blocked, self.seen))

    def _store(self, key, runner: KeyRunner, now_ms: int) -> pd.DataFrame:
        runner.advance(now_ms)
        runner.forget(now_ms)
        if any(row[4] == "terminal" for row in runner.rows):
            raise TerminalError(f"terminal error of key {key}")
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due.timestamp if hasattr(due, "timestamp") else due)
        if runner.state.idle():
            self.rest.clear()
        else:
            self.rest.update((runner.state.dumps(),))
            due = runner.next_due_ms()
            self.handle.registerTimer(max(now_ms + 1, now_ms + self.policy.gate_window_ms if due is None else due))
        return rows_of(runner, *key)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, runner = timerValues.getCurrentProcessingTimeInMs(), self._runner()
        for off, us, id_, payload in pd.concat(list(rows)).sort_values("off")[["off", "ts_us", "id", "payload"]].itertuples(index=False):
            runner.message(Message(int(off), int(us) // 1000, id_ if isinstance(id_, str) else None, payload if isinstance(payload, str) else None), now)
        yield self._store(key, runner, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._store(key, self._runner(), timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


class JsonMapping(MutableMapping):
    """Lists kept as JSON in a mapping of texts."""

    def __init__(self, texts: MutableMapping):
        self.texts = texts

    def __getitem__(self, k):
        return json.loads(self.texts[k])

    def __setitem__(self, k, value):
        self.texts[k] = json.dumps(value)

    def __delitem__(self, k):
        del self.texts[k]

    def __iter__(self):
        return iter(self.texts)

    def __len__(self):
        return len(self.texts)


def handler_stream(log: DataFrame, handler: Callable[[], KeyHandler], policy: Policy | None = None) -> DataFrame:
    """Rows of EVENT_SCHEMA for a stream (topic, part, key, off, ts_us, id, payload); handler makes a handler for a key."""
    rows = log.select("topic", "part", "key", "off", "ts_us", "id", "payload")
    return rows.groupBy("topic", "part", "key").transformWithStateInPandas(HandlerProcessor(handler, policy or Policy()), EVENT_SCHEMA, "Append", "ProcessingTime")


def dedup_stream(log: DataFrame, ttl_s: int = TTL_S) -> DataFrame:
    """Deduplicated rows of a stream with the columns of LOG_SCHEMA."""
    columns = [c.split()[0] for c in LOG_SCHEMA.split(", ")]
    return log.select(*columns).groupBy("topic", "part", "key").transformWithStateInPandas(DedupProcessor(ttl_s), LOG_SCHEMA, "Append", "ProcessingTime")


def timer_stream(commands: DataFrame) -> DataFrame:
    """Timer events (scheduled, cancelled, fired) of a stream of commands (part, key, timer_type, ord, op, time_s)."""
    return commands.groupBy("part", "key", "timer_type").transformWithStateInPandas(TimerProcessor(), TIMER_SCHEMA, "Append", "ProcessingTime")


def defer_stream(events: DataFrame) -> DataFrame:
    """What becomes of each message of a stream (topic, part, key, off, at_s, outcome, fails)."""
    return events.groupBy("topic", "part", "key").transformWithStateInPandas(DeferProcessor(), DEFER_SCHEMA, "Append", "ProcessingTime")
