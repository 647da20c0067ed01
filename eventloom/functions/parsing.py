"""Arguments as people write them: instants, durations and sizes, read on the driver or in columns."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000, "d": 86_400_000_000_000}
_DURATION = re.compile(r"([+-]?)((?:\d+(?:\.\d+)?\s*(?:ns|us|µs|ms|s|m|h|d)\s*)+)")
#: Durations are held within a year.
MOST_NS = 365 * _UNITS["d"]


def duration_ns(text: str) -> int:
    """`1h30m5s10ms3us2ns`, with decimals and a sign, in nanoseconds; at most a year either way."""
    m = _DURATION.fullmatch(text.strip())
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    total = sum(round(float(n) * _UNITS[u]) for n, u in re.findall(r"(\d+(?:\.\d+)?)\s*(ns|us|µs|ms|s|m|h|d)", m[2]))
    return max(-MOST_NS, min(MOST_NS, -total if m[1] == "-" else total))


def instant(text: str) -> datetime:
    """An ISO date with or without time and offset; without one it is UTC. A time alone is refused."""
    found = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    return found.astimezone(timezone.utc) if found.tzinfo else found.replace(tzinfo=timezone.utc)


def size_bytes(text: str) -> int:
    """`100`, `100k`, `50m`, `1.5g`, with or without a b, in powers of 1024."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([kmgt]?)b?", text.strip().lower())
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * 1024 ** " kmgt".index(m[2] or " "))


def _adding(size: int):
    return lambda total, x: total + F.round(x.cast("double") * size).cast("long")


def duration_column(text: Column) -> Column:
    """duration_ns() of a column: nanoseconds, or null where it is no duration."""
    trimmed = F.trim(text)
    plain = F.regexp_replace(trimmed, "^[+-]", "")
    total = F.lit(0).cast("long")
    for unit, size in _UNITS.items():
        each = F.regexp_extract_all(plain, F.lit(rf"(\d+(?:\.\d+)?)\s*{unit}(?![a-zµ])"), 1)
        total = total + F.aggregate(each, F.lit(0).cast("long"), _adding(size))
    signed = F.when(trimmed.startswith("-"), -total).otherwise(total)
    return F.when(trimmed.rlike(f"^{_DURATION.pattern}$"), F.greatest(F.lit(-MOST_NS), F.least(F.lit(MOST_NS), signed)))


def instant_column(text: Column) -> Column:
    """instant() of a column: a timestamp, or null where it is none; times without an offset are UTC if that is the session's zone."""
    return F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(F.trim(text)))


def size_column(text: Column) -> Column:
    """size_bytes() of a column: bytes, or null where it is no size."""
    low = F.lower(F.trim(text))
    number, unit = (F.regexp_extract(low, r"^(\d+(?:\.\d+)?)\s*([kmgt]?)b?$", k) for k in (1, 2))
    return F.when(number != "", F.floor(number.cast("double") * F.pow(F.lit(1024.0), F.when(unit == "", 0).otherwise(F.instr(F.lit("kmgt"), unit)))).cast("long"))


def span(ns: int) -> timedelta:
    return timedelta(microseconds=ns / 1_000)
