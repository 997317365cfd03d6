"""Scalar column functions: compact times, slabs, backoff bounds, name-based UUIDs, enum names, prefixes and headers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SECONDS = 2**32 - 1
#: TTL from which rows are kept without one.
MAX_TTL = 630_720_000
#: Namespaces of RFC 9562 name-based UUIDs (fixed values).
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"
TIMER_TYPES = ("application", "deferredMessage", "deferredTimer")


def compact_seconds(micros: Column) -> Column:
    """Epoch micros to seconds, half up; null outside 0..2^32-1."""
    s = F.floor((micros + 500_000) / 1_000_000)
    return F.when((s >= 0) & (s <= MAX_SECONDS), s)


def checked_add(t: Column, d: Column) -> Column:
    return F.when((t + d >= 0) & (t + d <= MAX_SECONDS), t + d)


def checked_difference(later: Column, earlier: Column) -> Column:
    """Null where the second lies after the first."""
    return F.when(later >= earlier, later - earlier)


def saturating(d: Column) -> Column:
    return F.least(F.greatest(d, F.lit(0)), F.lit(MAX_SECONDS))


def slab_of(t: Column, size: Column | int) -> Column:
    size = F.lit(size) if isinstance(size, int) else size
    return F.when(size == 0, F.lit(0).cast("long")).otherwise(F.floor(t / F.nullif(size, F.lit(0))))


def slab_start(slab: Column, size: Column | int) -> Column:
    return F.least(slab * size, F.lit(MAX_SECONDS))


def slab_end(slab: Column, size: Column | int) -> Column:
    """Exclusive end, saturating."""
    return F.least((slab + 1) * size, F.lit(MAX_SECONDS))


def slab_plus(slab: Column, n: int) -> Column:
    """The slab n on (the next: 1, the previous: -1); null where there is none."""
    return checked_add(slab, F.lit(n))


def retry_bound_ms(attempt: Column, base_ms: int = 20, max_ms: int = 300_000) -> Column:
    """Upper bound of the wait before attempt+1, attempts from 1."""
    return F.least(F.lit(float(base_ms)) * F.pow(F.lit(2.0), attempt), F.lit(float(max_ms))).cast("long")


def defer_bound_s(retry: Column, base_s: int = 1, max_s: int = 86_400) -> Column:
    """0 for the first retry, else between 1 and max_s."""
    wait = F.least(F.lit(float(base_s)) * F.pow(F.lit(2.0), retry - 1), F.lit(float(max_s)))
    return F.when(retry == 0, F.lit(0)).otherwise(F.greatest(F.lit(1.0), wait)).cast("long")


def row_ttl(t: Column, now_s: int, retention_s: int) -> Column:
    """Seconds to keep a row of time t; a time gone by counts as now; null (no TTL) from MAX_TTL on."""
    ttl = F.greatest(t - now_s, F.lit(0)) + retention_s
    return F.when(ttl < MAX_TTL, ttl)


def uuid5(namespace_hex: str, name: Column) -> Column:
    """Version-5 UUID of a name: first 16 bytes of SHA-1 with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), name.cast("binary")))
    nibble = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(nibble, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def timer_type_name(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in TIMER_TYPES]), (code + 1).cast("int"))


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    return reduce(or_, [F.startswith(text, F.lit(p)) for p in prefixes], F.lit(False))


def header(headers: Column, name: str) -> Column:
    """Value of the first header of that name as text; null where there is none or it isn't UTF-8."""
    value = F.get(F.filter(headers, lambda h: h["key"] == name), F.lit(0))["value"]
    return F.when(F.is_valid_utf8(value.cast("string")), value.cast("string"))


def rfc3339_ms(micros: Column) -> Column:
    seconds = F.floor(micros / 1_000_000)
    ms = F.lpad(F.floor(F.pmod(micros, F.lit(1_000_000)) / 1000).cast("string"), 3, "0")
    return F.concat(rfc3339_s(seconds, False), F.lit("."), ms, F.lit("Z"))


def rfc3339_s(seconds: Column, zulu: bool = True) -> Column:
    """From civil-day arithmetic, so it doesn't depend on the session's time zone."""
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int")), "yyyy-MM-dd")
    s = F.pmod(seconds, F.lit(86_400))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    out = F.concat(day, F.lit("T"), two(F.floor(s / 3600)), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))
    return F.concat(out, F.lit("Z")) if zulu else out


def decayed(value: Column, elapsed_s: Column, half_life_s: float = 120.0) -> Column:
    """A whole number decayed by its age, cut to a whole number."""
    return F.floor(value * F.pow(F.lit(2.0), -elapsed_s / half_life_s))


def _both_at(a: Column, b: Column, half_life_s: float) -> tuple[Column, Column, Column]:
    at = F.greatest(a["at_ms"], b["at_ms"])
    return at, *(decayed(x["value"], (at - x["at_ms"]) / 1000.0, half_life_s) for x in (a, b))


def decayed_sum(a: Column, b: Column, half_life_s: float = 120.0) -> Column:
    """Sum of two decaying numbers, structs (value, at_ms), measured at the later instant."""
    at, x, y = _both_at(a, b, half_life_s)
    return F.struct((x + y).alias("value"), at.alias("at_ms"))


def decayed_difference(a: Column, b: Column, half_life_s: float = 120.0) -> Column:
    """Difference of two decaying numbers at the later instant, at least 0."""
    at, x, y = _both_at(a, b, half_life_s)
    return F.struct(F.greatest(x - y, F.lit(0)).alias("value"), at.alias("at_ms"))


def decayed_compare(a: Column, b: Column, half_life_s: float = 120.0) -> Column:
    """-1, 0 or 1: how two decaying numbers compare at the later instant."""
    _, x, y = _both_at(a, b, half_life_s)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)
