"""As-of lookups over time: the next or previous of a second table's rows, spread over ranges of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.ranges import cuts, kth, place

#: Ranges up to which their edges, a row of two numbers each, are broadcast.
MOST_BROADCAST = 100_000


def lookup(events: DataFrame, marks: DataFrame, time: str, mark_time: str, value: str, to: str, forward: bool = True) -> DataFrame:
    """events with `to`: the value of the first mark at or after (forward), or the last at or before, each event's time.

    Times are whole numbers. Events and marks meet in ranges of time whose bounds are quantiles of both (see ranges.cuts),
    each sorted by itself; a range without the sought mark takes that of the nearest range beyond, of which there is one row
    each. Of marks of one time, forward takes the smallest value and backward the largest. Events without a time, or without
    such a mark, have null.
    """
    kind, names = marks.schema[value].dataType, events.columns
    found = marks.where(F.col(mark_time).isNotNull()).select(F.col(mark_time).alias("__time"), F.col(value).alias("__value"))
    bounds = cuts(events.select(F.col(time).cast("double").alias("x")).union(found.select(F.col("__time").cast("double"))))
    slot = lambda c: place(F.col(c).cast("double"), bounds)
    found = found.withColumn("__slot", slot("__time"))
    # of each range, the mark that other ranges see first
    edge = (F.min if forward else F.max)(F.struct("__time", "__value"))
    edges = found.groupBy("__slot").agg(edge.alias("__edge"))
    order = Window.orderBy(F.col("__slot").desc() if forward else F.col("__slot")).rowsBetween(Window.unboundedPreceding, -1)
    grid = events.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("__slot")).join(edges, "__slot", "left")
    grid = grid.select("__slot", F.last("__edge", ignorenulls=True).over(order).getField("__value").alias("__far"))
    both = events.select(slot(time).alias("__slot"), F.col(time).alias("__time"), F.lit(None).cast(kind).alias("__value"), F.lit(1).alias("__rank"), F.struct(*names).alias("__row")).unionByName(
        found.withColumns({"__rank": F.lit(0), "__row": F.lit(None).cast(events.schema)})
    )
    # in the order of the search, so that the sought mark is always the last one seen
    by = [F.col("__time").desc(), "__rank", F.col("__value").desc()] if forward else [F.col("__time"), "__rank", "__value"]
    near = Window.partitionBy("__slot").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("__near", F.last("__value", ignorenulls=True).over(near)).where("__row is not null")
    return seen.join(F.broadcast(grid) if len(bounds) < MOST_BROADCAST else grid, "__slot", "left").select("__row.*", F.coalesce("__near", "__far").alias(to))


def next_id(events: DataFrame, marks: DataFrame, time: str, mark_time: str, value: str, to: str = "next_id") -> DataFrame:
    """The id of the next mark at or after each event: after the last one its id plus 1, without marks 1."""
    last = marks.select(F.max(F.struct(mark_time, value)).getField(value)).scalar()
    return lookup(events, marks, time, mark_time, value, to).withColumn(to, F.coalesce(F.col(to), last + 1, F.lit(1)).cast("long"))


def long_pauses(pauses: DataFrame, percentile: float) -> DataFrame:
    """The pauses (start_us, end_us, duration) from rank floor(n * p / 100) on, by duration, start and end; at 100 the longest.

    Rows that equal the pause of that rank in all three are taken together. Durations are whole numbers.
    """
    n = pauses.count()
    if not n:
        return pauses
    index = n - 1 if percentile >= 100 else min(n - 1, int(n * percentile // 100))
    limit, below = kth(pauses, "duration", index)
    ties = pauses.where(F.col("duration") == limit)
    start, earlier = kth(ties, "start_us", index - below)
    end, _ = kth(ties.where(F.col("start_us") == start), "end_us", index - below - earlier)
    key = F.struct("duration", "start_us", "end_us")
    return pauses.where(key >= F.struct(F.lit(limit), F.lit(start), F.lit(end)).cast("struct<duration: long, start_us: long, end_us: long>"))


def pauses_of(collections: DataFrame | None, summaries: DataFrame | None, start: str = "start_us", duration: str = "duration") -> DataFrame | None:
    """The pauses (start_us, end_us, duration): those of collections, or, if there are none, from the first to the last summary of each gcId.

    collections: start and duration; rows without either are left out. summaries: start and gcId. Both may be None.
    """
    parts = []
    if collections is not None:
        own = collections.select(F.col(start).alias("start_us"), F.col(duration).alias("duration")).dropna()
        if not own.isEmpty():
            return own.select("start_us", (F.col("start_us") + F.col("duration")).alias("end_us"), "duration")
        parts.append(own.select("start_us", F.col("start_us").alias("end_us"), "duration"))
    if summaries is not None:
        spans = summaries.where(F.col(start).isNotNull() & F.col("gcId").isNotNull()).groupBy("gcId").agg(F.min(start).alias("start_us"), F.max(start).alias("end_us"))
        return spans.select("start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration"))
    return parts[0] if parts else None


def near_pauses(events: DataFrame, longest: DataFrame, context_us: int, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Events whose start is at most the context after the start of a long pause, or their end at most so much before its end.

    Distances are to the last pause that starts at or before the event, and to the first that ends at or after it. Without
    pauses nothing is kept; events without a start are left out.
    """
    before = lookup(events.where(F.col(start).isNotNull()), longest, start, "start_us", "start_us", "__before", forward=False)
    both = lookup(before, longest, end, "end_us", "end_us", "__after", forward=True)
    close = F.least(F.col(start) - F.col("__before"), F.col("__after") - F.col(end)) <= context_us
    return both.where(F.coalesce(close, F.lit(False))).select(*events.columns)
