"""A user's handler and what a consumer in pipeline mode puts around it, for one key at a time.

From the outside: endless retries, deduplication, deferral of messages, deferral of timers, the monopolization gate, the
handler. KeyRunner is that stack over a KeyState, in plain Python and on a clock it is given: run() folds a table's keys in
event time, streaming.processors.HandlerProcessor a stream's in processing time. Waits are due times, so nothing sleeps. Queues
and what deduplication remembers are mappings that may lie in a state store, entry by entry; all else is one short text.

A timer set for a time that is past is due at once, so a handler that sets its own time again and again never ends.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Callable, Iterator, MutableMapping
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from keystrand.functions.folds import ROWS, columns_of, fold_keys
from keystrand.operators.defer import bound_s
from keystrand.operators.dedup import TTL_S
from keystrand.operators.timers import apply_command

#: kind is message or timer, id its offset or time; outcome is null where the handler wasn't called.
EVENT_SCHEMA = "topic string, part int, key string, kind string, id bigint, at_ms bigint, demand string, outcome string, action string"
#: What becomes of a queue's head that stays: deferred again, or kept for a restart after a terminal error.
RETRIED = {"transient": "deferred", "terminal": "aborted"}


class HandlerError(Exception):
    """An error a handler raises; any other exception counts as transient."""

    category = "transient"


class PermanentError(HandlerError):
    category = "permanent"


class TerminalError(HandlerError):
    category = "terminal"


class Cancelled(HandlerError):
    """The event was cancelled; a later try may succeed."""


class InvalidContext(PermanentError):
    """A context was used after its event."""


class Message(NamedTuple):
    off: int
    at_ms: int
    id: str | None
    payload: str | None


class Timer(NamedTuple):
    time_s: int


class KeyHandler:
    """What a user writes. Hooks: after_commit follows an event's last call, after_abort each call that another will follow."""

    def on_message(self, context: Context, message: Message) -> None: ...

    def on_timer(self, context: Context, timer: Timer) -> None: ...

    def after_commit(self, event: Message | Timer, category: str) -> None: ...

    def after_abort(self, event: Message | Timer, category: str) -> None: ...


@dataclass
class Policy:
    """Settings of the stack; dedup_ttl_s 0, defers False or gate_share None leave a layer out."""

    dedup_ttl_s: int = TTL_S
    defers: bool = True
    defer_base_s: int = 1
    defer_max_s: int = 86_400
    gate_share: float | None = None
    gate_window_ms: int = 300_000
    retry_base_ms: int = 20
    retry_max_ms: int = 300_000


@dataclass
class Fifo:
    """Numbered entries first..last-1, how often the head failed, and when it is due."""

    items: MutableMapping[int, list] = field(default_factory=dict)
    first: int = 0
    last: int = 0
    tries: int = 0
    due_ms: int | None = None

    def __len__(self) -> int:
        return self.last - self.first

    def head(self) -> list:
        return self.items[self.first]

    def push(self, entry: list) -> None:
        self.items[self.last] = entry
        self.last += 1

    def pop(self) -> None:
        del self.items[self.first]
        self.first, self.tries = self.first + 1, 0


@dataclass
class KeyState:
    """All a key keeps. Entries are events as lists; the timers' queue holds original times, the head first."""

    times: dict[int, str] = field(default_factory=dict)
    messages: Fifo = field(default_factory=Fifo)
    blocked: Fifo = field(default_factory=Fifo)
    timers: list[int] = field(default_factory=list)
    timer_tries: int = 0
    timer_due_ms: int | None = None
    runs: list[list[int]] = field(default_factory=list)
    now_ms: int = 0
    seen: MutableMapping[str, int] = field(default_factory=OrderedDict)

    def dumps(self) -> str:
        """All but the mappings, as JSON."""
        ends = [[q.first, q.last, q.tries, q.due_ms] for q in (self.messages, self.blocked)]
        return json.dumps([list(self.times.items()), ends, self.timers, self.timer_tries, self.timer_due_ms, self.runs, self.now_ms], separators=(",", ":"))

    @classmethod
    def loads(cls, text: str | None, messages: MutableMapping, blocked: MutableMapping, seen: MutableMapping) -> KeyState:
        """State over the mappings; without a text a new one."""
        times, ends, *rest = json.loads(text) if text else [[], [[], []], [], 0, None, [], 0]
        return cls({int(t): s for t, s in times}, Fifo(messages, *ends[0]), Fifo(blocked, *ends[1]), *rest, seen)

    def idle(self) -> bool:
        return not (self.times or self.messages or self.blocked or self.timers or self.runs)

    def clear_timers(self) -> None:
        self.timers, self.timer_tries, self.timer_due_ms = [], 0, None


class Context:
    """Timers and cancellation for one call. After the call every use raises InvalidContext.

    While timers of the key are deferred, a new time is appended to their queue, a clear drops the queue too, and the
    times listed are those of both.
    """

    def __init__(self, runner: KeyRunner, demand: str):
        self._runner, self._valid, self._cancelled, self.demand, self.elapsed_ms = runner, True, False, demand, 0

    def _state(self) -> KeyState:
        if not self._valid:
            raise InvalidContext
        if self._cancelled:
            raise Cancelled
        return self._runner.state

    def now_ms(self) -> int:
        return self._state().now_ms

    def schedule(self, time_s: int) -> None:
        state = self._state()
        if state.timers:
            self._runner.queue_timer(time_s)
        else:
            self._runner.command("schedule", time_s)

    def clear_and_schedule(self, time_s: int) -> None:
        self._state().clear_timers()
        self._runner.command("clear_and_schedule", time_s)

    def unschedule(self, time_s: int) -> None:
        self._state()
        self._runner.drop_deferred(time_s)
        self._runner.command("unschedule", time_s)

    def clear(self) -> None:
        self._state().clear_timers()
        self._runner.command("clear", 0)

    def scheduled(self) -> list[int]:
        state = self._state()
        return sorted({t for t, s in state.times.items() if s != "firing"} | set(state.timers))

    def cancel(self) -> None:
        self._state()
        self._cancelled = True

    def is_cancelled(self) -> bool:
        return self._cancelled

    def _end(self) -> None:
        self._valid = False


class KeyRunner:
    """Feeds a key's events to its handler; rows holds what became of them, as tuples (kind, id, at_ms, demand, outcome, action)."""

    def __init__(self, handler: KeyHandler, policy: Policy | None = None, state: KeyState | None = None):
        self.handler, self.policy, self.state = handler, policy or Policy(), state or KeyState()
        self.rows: list[tuple[str, int, int, str | None, str | None, str]] = []

    def message(self, message: Message, now_ms: int | None = None) -> None:
        """A message arrives: all that is due before it comes first; one of a blocked key waits."""
        now = message.at_ms if now_ms is None else now_ms
        self.advance(now)
        self.state.now_ms = max(self.state.now_ms, now)
        self._enter(message, "normal")

    def advance(self, now_ms: int) -> None:
        """Run everything due until now, in the order of its due times."""
        while True:
            due = self._due()
            if due is None or due[0] > now_ms:
                return
            self.state.now_ms = max(self.state.now_ms, due[0])
            due[2]()

    def next_due_ms(self) -> int | None:
        due = self._due()
        return None if due is None else due[0]

    def forget(self, now_ms: int) -> None:
        """Drop identities past their TTL and runs out of the gate's window."""
        seen = self.state.seen
        if isinstance(seen, OrderedDict):  # in the order of their ends; a state store drops them itself
            while seen and (first := next(iter(seen.items())))[1] <= now_ms:
                del seen[first[0]]
        elif isinstance(seen, dict):
            for gone in [i for i, until in seen.items() if until <= now_ms]:
                del seen[gone]
        if self.state.runs:
            self.state.runs = [r for r in self.state.runs if r[1] > now_ms - self.policy.gate_window_ms]

    def command(self, op: str, time_s: int) -> None:
        for event in apply_command(self.state.times, op, time_s):
            self._row("timer", time_s, None, None, event)

    def queue_timer(self, time_s: int) -> None:
        """Put a time into the timers' queue: by time, but behind the head."""
        queue = self.state.timers
        if not queue:
            self.state.timers, self.state.timer_tries, self.state.timer_due_ms = [time_s], 0, self.state.now_ms  # due at once
        elif time_s not in queue:
            queue[1:] = sorted([*queue[1:], time_s])

    def drop_deferred(self, time_s: int) -> None:
        """Take a time out of the timers' queue; behind a dropped head the next is due at once."""
        queue = self.state.timers
        if time_s in queue:
            if queue[0] == time_s:
                self.state.timer_tries, self.state.timer_due_ms = 0, self.state.now_ms
            queue.remove(time_s)

    def _due(self) -> tuple[int, int, Callable[[], None]] | None:
        state = self.state
        if state.blocked:  # a key runs one event at a time: all else waits
            return state.blocked.due_ms, 0, self._unblock
        waiting = [(t * 1000, 1, lambda t=t: self._fire(t)) for t in sorted(t for t, s in state.times.items() if s == "scheduled")[:1]]
        waiting += [(state.messages.due_ms, 2, self._retry_message)] if state.messages else []
        waiting += [(state.timer_due_ms, 3, self._retry_timer)] if state.timers else []
        return min(waiting, key=lambda w: w[:2], default=None)

    def _row(self, kind: str, id_: int, demand: str | None, outcome: str | None, action: str) -> None:
        self.rows.append((kind, id_, self.state.now_ms, demand, outcome, action))

    def _enter(self, event: Message | Timer, demand: str) -> None:
        if self.state.blocked:
            self.state.blocked.push(list(event))
            self._row(_kind(event), event[0], None, None, "waiting")
        elif self._tried(event, demand) == "transient":
            self.state.blocked.push(list(event))
            self.state.blocked.tries, self.state.blocked.due_ms = 1, self.state.now_ms + self._retry_ms(1)

    def _unblock(self) -> None:
        """The event that holds up its key is tried again; once it ends, the next that waits has its first try."""
        queue = self.state.blocked
        demand = "failure" if queue.tries else "normal"
        if self._tried(_event(queue.head()), demand) == "transient":
            queue.tries += 1
            queue.due_ms = self.state.now_ms + self._retry_ms(queue.tries)
        else:
            queue.pop()
            queue.due_ms = self.state.now_ms

    def _tried(self, event: Message | Timer, demand: str) -> str | None:
        """Category of a try; a timer that ended leaves the store."""
        category, action = self._through(event, demand)
        self._row(_kind(event), event[0], demand, category, action)
        if isinstance(event, Timer) and category != "transient":
            apply_command(self.state.times, "abort" if category == "terminal" else "complete", event.time_s)
        return category

    def _retry_ms(self, tries: int) -> int:
        return min(self.policy.retry_base_ms * 2 ** min(tries, 40), self.policy.retry_max_ms)

    def _through(self, event: Message | Timer, demand: str) -> tuple[str | None, str]:
        """(category, action) behind deduplication and deferral; a transient category is for the retries outside."""
        if isinstance(event, Timer):
            return self._deferring(event, demand, self.state.timers, lambda: self.queue_timer(event.time_s))
        identity = f"i{event.id}" if event.id is not None else f"o{event.off}"
        until = self.state.seen.get(identity)
        if until is not None and self.state.now_ms < until:
            return None, "duplicate"
        category, action = self._deferring(event, demand, self.state.messages, lambda: self._queue_message(event))
        if self.policy.dedup_ttl_s and category not in ("transient", "terminal"):
            if isinstance(self.state.seen, OrderedDict):
                self.state.seen.pop(identity, None)  # a later end goes behind the others
            self.state.seen[identity] = self.state.now_ms + self.policy.dedup_ttl_s * 1000
        return category, action

    def _deferring(self, event: Message | Timer, demand: str, waiting: Fifo | list, queue: Callable[[], None]) -> tuple[str | None, str]:
        if waiting:
            queue()
            return None, "queued"
        category = self._call(event, demand)
        if category != "transient":
            return category, "aborted" if category == "terminal" else "done"
        if not self.policy.defers:
            return category, "retried"
        queue()
        return None, "deferred"

    def _queue_message(self, event: Message) -> None:
        queue = self.state.messages
        if not queue:
            queue.tries, queue.due_ms = 0, self.state.now_ms  # due at once
        queue.push(list(event))

    def _retry_message(self) -> None:
        """The head of the queue is tried again: it leaves unless it fails transiently, and the next is due at once."""
        queue, now = self.state.messages, self.state.now_ms
        event = _event(queue.head())
        category = self._call(event, "failure")
        self._row("message", event.off, "failure", category, RETRIED.get(category, "done"))
        if category in RETRIED:
            queue.tries += category == "transient"
            queue.due_ms = now + self._defer_ms(queue.tries)
        else:
            queue.pop()
            queue.due_ms = now

    def _retry_timer(self) -> None:
        """The same for timers. The handler may clear the queue meanwhile, or drop its head."""
        state, time_s = self.state, self.state.timers[0]
        category = self._call(Timer(time_s), "failure")
        self._row("timer", time_s, "failure", category, RETRIED.get(category, "done"))
        if state.timers[:1] != [time_s]:
            return
        if category in RETRIED:
            state.timer_tries += category == "transient"
            state.timer_due_ms = state.now_ms + self._defer_ms(state.timer_tries)
        else:
            state.timers, state.timer_tries, state.timer_due_ms = state.timers[1:], 0, state.now_ms

    def _defer_ms(self, tries: int) -> int:
        return 1000 * max(1, bound_s(tries, self.policy.defer_base_s, self.policy.defer_max_s))

    def _fire(self, time_s: int) -> None:
        apply_command(self.state.times, "fire", time_s)
        self._enter(Timer(time_s), "normal")

    def _call(self, event: Message | Timer, demand: str) -> str:
        """Category of one call; a gated key's handler isn't called and has no hook."""
        if self._monopolizes():
            return "transient"
        context, began = Context(self, demand), self.state.now_ms
        try:
            self.handler.on_message(context, event) if isinstance(event, Message) else self.handler.on_timer(context, event)
            category = "success"
        except Exception as error:
            category = error.category if isinstance(error, HandlerError) else "transient"
        finally:
            context._end()
        if context.elapsed_ms:
            self.state.runs.append([began, began + context.elapsed_ms])
        (self.handler.after_abort if category in RETRIED else self.handler.after_commit)(event, category)
        return category

    def _monopolizes(self) -> bool:
        share, window, now = self.policy.gate_share, self.policy.gate_window_ms, self.state.now_ms
        if share is None:
            return False
        return sum(max(0, min(end, now) - max(start, now - window)) for start, end in self.state.runs) > share * window


def _kind(event: Message | Timer) -> str:
    return "message" if isinstance(event, Message) else "timer"


def _event(entry: list) -> Message | Timer:
    return Timer(*entry) if len(entry) == 1 else Message(*entry)


def run(log: DataFrame, handler: Callable[[], KeyHandler], policy: Policy | None = None, until_ms: int | None = None) -> DataFrame:
    """Rows of EVENT_SCHEMA for a table (topic, part, key, off, ts_us, id, payload): each key's messages in offset order, on the
    clock of their times, then whatever is due until until_ms (null: nothing more).

    handler makes a handler for a key. Order matters within a key, so its rows are folded in one task, a row at a time; keys follow
    each other in one pass, and what became of their events is handed on as it comes.
    """
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[c.split()[1]]) for c in EVENT_SCHEMA.split(", ")])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runner, out = None, None, []

        def take(end: bool) -> None:
            if end and runner is not None and until_ms is not None:
                runner.advance(until_ms)
            if runner is not None:
                out.extend((*key, *row) for row in runner.rows)
                runner.rows.clear()

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return made

        for batch in batches:
            for off, us, id_, payload, *of in columns_of(batch, ["off", "ts_us", "id", "payload", "topic", "part", "key"]):
                if of != key:
                    take(end=True)
                    key, runner = of, KeyRunner(handler(), policy)
                runner.message(Message(off, us // 1000, id_, payload))
                runner.forget(runner.state.now_ms)
                if len(runner.rows) + len(out) >= ROWS:
                    take(end=False)
                    yield batch_of()
        take(end=True)
        if out:
            yield batch_of()

    return fold_keys(log.select("topic", "part", "key", "off", "ts_us", "id", "payload"), ("topic", "part", "key"), "off", fold, EVENT_SCHEMA)


def rows_of(runner: KeyRunner, topic: str, part: int, key: str) -> pd.DataFrame:
    """The runner's rows of EVENT_SCHEMA."""
    columns = [c.split()[0] for c in EVENT_SCHEMA.split(", ")]
    return pd.DataFrame([(topic, part, key, *row) for row in runner.rows], columns=columns).astype({"part": "int32", "id": "int64", "at_ms": "int64"})
