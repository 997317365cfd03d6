"""Settings, their defaults, environment parsing and validation."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

UNITS = {"ms": 0.001, "s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "d": 86_400, "day": 86_400, "days": 86_400, "w": 604_800, "y": 31_557_600}


def duration(text: str) -> float | None:
    """Seconds of a text such as 5m, 1h 30m or 100ms; None for none."""
    text = text.strip().lower()
    if text == "none":
        return None
    parts = re.findall(r"(\d+)\s*([a-z]+)", text)
    if not parts or re.sub(r"(\d+)\s*([a-z]+)\s*", "", text):
        raise ValueError(f"no duration: {text!r}")
    return float(sum(int(n) * UNITS[u] for n, u in parts))


def listed(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def _setting(default, env: str, parse=str, **limits):
    return field(default=default, metadata={"env": env, "parse": parse, **limits})


class Settings:
    """Fields may be read from the environment: PREFIX + the field's name."""

    @classmethod
    def from_env(cls, prefix: str = "KEYSTRAND_", env: Mapping[str, str] | None = None):
        env = os.environ if env is None else env
        return cls(**{f.name: f.metadata["parse"](env[prefix + f.metadata["env"]]) for f in fields(cls) if prefix + f.metadata["env"] in env})

    def __post_init__(self):
        for f in fields(self):
            value, low, high = getattr(self, f.name), f.metadata.get("low"), f.metadata.get("high")
            if value is not None and ((low is not None and value < low) or (high is not None and value > high)):
                raise ValueError(f"{f.name}: {value} is out of range")


@dataclass
class ConsumerSettings(Settings):
    group_id: str = _setting("", "GROUP_ID")
    topics: list[str] | None = _setting(None, "SUBSCRIBED_TOPICS", listed)
    allowed_events: list[str] | None = _setting(None, "ALLOWED_EVENTS", listed)
    source_system: str | None = _setting(None, "SOURCE_SYSTEM")
    max_uncommitted: int = _setting(64, "MAX_UNCOMMITTED", int, low=1)
    stall_threshold_s: float = _setting(300, "STALL_THRESHOLD", duration)
    shutdown_timeout_s: float = _setting(30, "SHUTDOWN_TIMEOUT", duration)
    poll_interval_s: float = _setting(0.1, "POLL_INTERVAL", duration)
    commit_interval_s: float = _setting(1, "COMMIT_INTERVAL", duration)
    probe_port: int = _setting(8000, "PROBE_PORT", int)
    slab_size_s: float = _setting(3600, "SLAB_SIZE", duration, low=1)

    @property
    def source(self) -> str:
        """The source system, by default the group."""
        return self.source_system or self.group_id


@dataclass
class SchedulerSettings(Settings):
    max_concurrency: int = _setting(32, "MAX_CONCURRENCY", int, low=1)
    failure_weight: float = _setting(0.3, "FAILURE_WEIGHT", float, low=0, high=1)
    max_wait_s: float = _setting(120, "MAX_WAIT", duration)
    wait_weight: float = _setting(200.0, "WAIT_WEIGHT", float)
    cache_size: int = _setting(8192, "SCHEDULER_CACHE_SIZE", int)


@dataclass
class MonopolizationSettings(Settings):
    enabled: bool = _setting(True, "MONOPOLIZATION_ENABLED", lambda t: t.lower() == "true")
    threshold: float = _setting(0.9, "MONOPOLIZATION_THRESHOLD", float, low=0, high=1)
    window_s: float = _setting(300, "MONOPOLIZATION_WINDOW", duration)
    cache_size: int = _setting(8192, "MONOPOLIZATION_CACHE_SIZE", int)


@dataclass
class DeferSettings(Settings):
    enabled: bool = _setting(True, "DEFER_ENABLED", lambda t: t.lower() == "true")
    base_s: float = _setting(1, "DEFER_BASE", duration, low=1)
    max_s: float = _setting(86_400, "DEFER_MAX_DELAY", duration)
    threshold: float = _setting(0.9, "DEFER_FAILURE_THRESHOLD", float, low=0, high=1)
    window_s: float = _setting(300, "DEFER_FAILURE_WINDOW", duration)

    def __post_init__(self):
        super().__post_init__()
        if self.max_s < self.base_s:
            raise ValueError("max_s is less than base_s")


@dataclass
class RetrySettings(Settings):
    base_s: float = _setting(0.02, "RETRY_BASE", duration)
    max_retries: int = _setting(3, "MAX_RETRIES", int, low=0)
    max_delay_s: float = _setting(300, "RETRY_MAX_DELAY", duration)


@dataclass
class StorageSettings(Settings):
    keyspace: str = _setting("keystrand", "KEYSPACE")
    retention_s: float = _setting(31_557_600, "RETENTION", duration, high=630_720_000)


@dataclass
class FailureTopicSettings(Settings):
    topic: str = _setting("", "FAILURE_TOPIC")

    def __post_init__(self):
        super().__post_init__()
        if not self.topic:
            raise ValueError("no failure topic")


@dataclass
class DedupSettings(Settings):
    ttl_s: float = _setting(604_800, "DEDUP_TTL", duration, low=60, high=630_720_000)
    cache_size: int = _setting(8192, "DEDUP_CACHE_SIZE", int, low=0)


#: Settings each mode reads besides the consumer's and the scheduler's.
MODES: dict[str, dict[str, type[Settings]]] = {
    "pipeline": {"retry": RetrySettings, "monopolization": MonopolizationSettings, "defer": DeferSettings, "dedup": DedupSettings},
    "low-latency": {"retry": RetrySettings, "failure_topic": FailureTopicSettings},
    "best-effort": {},
}


@dataclass
class ModeSettings:
    """A mode with all it needs; parts holds its settings by name. Storage is None in memory, as a mock consumer uses it."""

    mode: str
    consumer: ConsumerSettings
    parts: dict[str, Settings]
    storage: StorageSettings | None

    @classmethod
    def from_env(cls, mode: str, mock: bool = False, prefix: str = "KEYSTRAND_", env: Mapping[str, str] | None = None) -> ModeSettings:
        """Validates what the mode needs, and only that."""
        if mode not in MODES:
            raise ValueError(f"no mode: {mode}")
        read = lambda settings: settings.from_env(prefix, env)
        consumer = read(ConsumerSettings)
        if not consumer.group_id:
            raise ValueError("no group_id")
        parts = {name: read(kind) for name, kind in MODES[mode].items()}
        return cls(mode, consumer, parts | {"scheduler": read(SchedulerSettings)}, None if mock else read(StorageSettings))

    def topics(self) -> list[str]:
        """All topics that have to exist: those subscribed and, in low-latency mode, the failure topic."""
        failure = self.parts.get("failure_topic")
        return [*(self.consumer.topics or []), *([failure.topic] if failure else [])]

    def store_path(self, base: str, store: str) -> str | None:
        """Where a store's table lies (timers, message_defer, timer_defer, dedup); None in memory."""
        return f"{base}/{self.storage.keyspace}/{store}" if self.storage else None


@dataclass
class TelemetrySettings(Settings):
    topic: str = _setting("telemetry-events", "TELEMETRY_TOPIC")
    enabled: bool = _setting(True, "TELEMETRY_ENABLED", lambda t: t.lower() == "true")
