"""Event filters: time windows, type lists and patterns, categories, and proximity to the longest pauses."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.asof import long_pauses, near_pauses, pauses_of


def equals(path: str, value: str) -> Column:
    """Equality of a field's text form; null equals nothing."""
    return F.col(path).cast("string") == F.lit(value)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


@dataclass(frozen=True)
class TimeWindow:
    """Events that lie within [start, end]; any two of start, end and duration give the third."""

    start: datetime | None = None
    end: datetime | None = None
    duration_s: float | None = None

    def bounds(self) -> tuple[datetime | None, datetime | None]:
        from datetime import timedelta

        start, end = self.start, self.end
        if self.duration_s is not None:
            if self.duration_s <= 0:
                raise ValueError("a duration must be positive")
            if (start is None) == (end is None):
                raise ValueError("a duration needs either a start or an end")
            start, end = (start, start + timedelta(seconds=self.duration_s)) if start is not None else (end - timedelta(seconds=self.duration_s), end)
        if start is not None and end is not None and start > end:
            raise ValueError("the start is after the end")
        return start, end

    def condition(self, start: str, end: str | None = None) -> Column:
        """Containment: the event starts at the start or later, and ends (or, without an end, starts) at the end or earlier.

        Events without a start time pass.
        """
        first, last = self.bounds()
        began = F.col(start)
        ended = F.coalesce(F.col(end), began) if end else began
        conditions = []
        if first is not None:
            conditions.append(began.isNull() | (began >= F.lit(first)))
        if last is not None:
            conditions.append(began.isNull() | (ended <= F.lit(last)))
        return all_of(*conditions)


def of_types(events: DataFrame, names: list[str], column: str = "event_type") -> DataFrame:
    """Events of the named types, in any case. A name without an event is an error that lists what there is (ten at most)."""
    wanted = [n.strip().lower() for n in names]
    there = {r[0] for r in events.select(F.lower(column)).distinct().collect()}
    missing = sorted(set(wanted) - there)
    if missing:
        raise ValueError(f"unknown event types {', '.join(missing)}; there are {', '.join(sorted(there)[:10])}")
    return events.where(F.lower(column).isin(wanted))


def glob_pattern(glob: str) -> str:
    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def like_types(events: DataFrame, globs: list[str], column: str = "event_type") -> DataFrame:
    """Events whose full or simple type name fits one of the patterns (* and ?), in any case."""
    full, simple = F.col(column), F.substring_index(column, ".", -1)
    return events.where(any_of(*[full.rlike(glob_pattern(g)) | simple.rlike(glob_pattern(g)) for g in globs]))


def in_categories(events: DataFrame, types: DataFrame, globs: list[str], column: str = "event_type") -> DataFrame:
    """Events of types with a category that fits. types: name and categories (an array); types without one are left out."""
    fitting = types.where(F.exists("categories", lambda c: any_of(*[c.rlike(glob_pattern(g)) for g in globs]))).select(F.col("name").alias(column))
    return events.join(fitting, column, "left_semi")


def without_idle_changes(events: DataFrame, before: str, after: str) -> DataFrame:
    """Leaves out events whose state before and after are the same."""
    return events.where(~F.col(before).eqNullSafe(F.col(after)))


def first_frames(frames: Column, depth: int = 5, hidden: str = "hidden") -> Column:
    """The first `depth` frames, of which hidden ones are not shown."""
    return F.filter(F.slice(frames, 1, depth), lambda f: ~F.coalesce(f["method"][hidden], F.lit(False)))


def near_long_pauses(events: DataFrame, pauses: DataFrame, percentile: float, context_us: int, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Events no further than the context from one of the longest pauses (see asof.long_pauses)."""
    return near_pauses(events, long_pauses(pauses, percentile), context_us, start, end)


def near_long_collections(events: DataFrame, collections: DataFrame | None, summaries: DataFrame | None, percentile: float, context_us: int, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """near_long_pauses() by the collections, or, if there are none, by the heap summaries (see asof.pauses_of); without either, nothing."""
    if not 0 < percentile <= 100:
        raise ValueError("the percentile must be over 0 and 100 at most")
    pauses = pauses_of(collections, summaries)
    return events.where(F.lit(False)) if pauses is None else near_long_pauses(events, pauses, percentile, context_us, start, end)
