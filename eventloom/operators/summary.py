"""Fixed summaries of recordings: counts, pause, CPU and allocation statistics, and their time buckets."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.percentiles import nearest_rank


def overview(events: DataFrame, time: str = "start_us", event_type: str = "event_type") -> DataFrame:
    """One row: first and last time, the microseconds between them, all events, and how many types there are."""
    return events.agg(F.min(time).alias("first"), F.max(time).alias("last"), (F.max(time) - F.min(time)).alias("duration"), F.count(F.lit(1)).alias("total"), F.count_distinct(event_type).alias("types"))


def type_counts(events: DataFrame, event_type: str = "event_type", limit: int | None = None) -> DataFrame:
    """Events of each type, most first, then by name."""
    out = events.groupBy(event_type).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), event_type)
    return out if limit is None or limit < 0 else out.limit(limit)


def type_list(counts: DataFrame, event_type: str = "event_type") -> DataFrame:
    """Types by their simple names."""
    simple = F.substring_index(event_type, ".", -1)
    return counts.select(simple.alias("name"), "count").orderBy(F.lower("name"), "name")


def pause_statistics(pauses: DataFrame, duration: str = "duration", is_young: Column | None = None) -> DataFrame:
    """One row: count, young, old, total, max, and the median and 95th percentile by nearest rank; none without pauses."""
    young = is_young if is_young is not None else F.lit(True)
    base = pauses.groupBy().agg(F.count(F.lit(1)).alias("count"), F.count_if(young).alias("young"), F.count_if(~young).alias("old"), F.sum(duration).alias("total"), F.max(duration).alias("max")).where("count > 0")
    ranks = nearest_rank(pauses, [], duration, {"median": 50, "p95": 95})
    return base.withColumns({c: ranks.select(c).scalar() for c in ("median", "p95")})


def collection_statistics(
    pauses: DataFrame, is_young: Column, phases: DataFrame | None = None, heaps: DataFrame | None = None, metaspaces: DataFrame | None = None, cpu: DataFrame | None = None, configurations: DataFrame | None = None
) -> DataFrame:
    """pause_statistics() with max_phase_pause, heap_before, heap_after and metaspace (the largest), cpu_user, cpu_system and collector.

    phases: duration. heaps: when and used. metaspaces: when and used, of which those after a collection count. cpu: user and system.
    configurations: start_us and young_collector, of which the first that is not empty counts. What is not given is null. No pause: no row.
    """
    out = pause_statistics(pauses, is_young=is_young)
    one = lambda df, x: F.lit(None).cast("long") if df is None else df.select(x).scalar()
    used = lambda when: F.max(F.when(F.col("when") == when, F.col("used")))
    named = None if configurations is None else configurations.where("young_collector != ''")
    return out.withColumns(
        {
            "max_phase_pause": one(phases, F.max("duration")),
            "heap_before": one(heaps, used("Before GC")),
            "heap_after": one(heaps, used("After GC")),
            "metaspace": one(metaspaces, used("After GC")),
            "cpu_user": one(cpu, F.sum("user")),
            "cpu_system": one(cpu, F.sum("system")),
            "collector": F.lit(None).cast("string") if named is None else named.select(F.min_by("young_collector", F.struct("start_us", "young_collector"))).scalar(),
        }
    )


def causes(pauses: DataFrame, cause: str = "cause") -> DataFrame:
    return pauses.groupBy(cause).agg(F.count(F.lit(1)).alias("count"))


def bucket(time: str, anchor: Column, width: int) -> Column:
    """The number of the time's tumbling bucket of `width`, counted from the anchor."""
    return F.floor((F.col(time) - anchor) / width).cast("long")


def pause_buckets(pauses: DataFrame, heaps: DataFrame, width: int, time: str = "start_us", duration: str = "duration", when: str = "when", used: str = "used") -> DataFrame:
    """Buckets that have pauses, counted from the first: count, total, max, and the largest heaps before and after in them."""
    anchor = pauses.select(F.min(time)).scalar()
    own = pauses.groupBy(bucket(time, anchor, width).alias("bucket")).agg(F.count(F.lit(1)).alias("count"), F.sum(duration).alias("total"), F.max(duration).alias("max"))
    heap = heaps.groupBy(bucket(time, anchor, width).alias("bucket")).agg(F.max(F.when(F.col(when) == "Before GC", F.col(used))).alias("heap_before"), F.max(F.when(F.col(when) == "After GC", F.col(used))).alias("heap_after"))
    return own.join(heap, "bucket", "left")


def mean_buckets(samples: DataFrame, width: int, values: list[str], time: str = "start_us") -> DataFrame:
    """Means of the values by bucket, counted from the first sample."""
    anchor = samples.select(F.min(time)).scalar()
    return samples.groupBy(bucket(time, anchor, width).alias("bucket")).agg(*[F.avg(v).alias(v) for v in values])


def size_buckets(allocations: DataFrame, promotions: DataFrame, width: int, size: str = "size", time: str = "start_us") -> DataFrame:
    """Positive sizes allocated and promoted by bucket, counted from the first of either."""
    both = allocations.select(time, F.col(size).alias("a"), F.lit(None).cast("long").alias("p")).unionByName(promotions.select(time, F.lit(None).cast("long").alias("a"), F.col(size).alias("p")))
    both = both.where("coalesce(a, p) > 0")
    anchor = both.select(F.min(time)).scalar()
    return both.groupBy(bucket(time, anchor, width).alias("bucket")).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("allocated"), F.coalesce(F.sum("p"), F.lit(0)).alias("promoted"))


def rate(total: Column, milliseconds: Column) -> Column:
    """An amount a second."""
    return total / (milliseconds / 1000.0)


def bucket_table(*parts: DataFrame) -> DataFrame:
    """Buckets of several statistics side by side; each has a row if any part has one."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "bucket", "full_outer")
    return out


def byte_tree(events: DataFrame, path: list[str], event_type: str = "event_type") -> DataFrame:
    """Bytes of the rows as JSON, by type and every prefix of the path columns (a flame tree): level, rows, bytes."""
    size = F.octet_length(F.to_json(F.struct(*events.columns)))
    rows = events.withColumn("__bytes", size)
    return rows.rollup(event_type, *path).agg(F.count(F.lit(1)).alias("rows"), F.sum("__bytes").alias("bytes"), F.grouping_id().alias("__g")).select(event_type, *path, F.bit_count(F.lit((1 << (len(path) + 1)) - 1) - F.col("__g")).cast("int").alias("level"), "rows", "bytes")


def flame_html(tree: DataFrame, path: list[str], title: str = "Bytes by type", most: int = 2_000) -> str:
    """A byte tree (see byte_tree) as an HTML page of nested lists with shares of the whole.

    Only the largest `most` nodes come to the driver: that many are what a page shows.
    """
    rows = tree.orderBy(F.col("bytes").desc()).limit(most).collect()
    whole = max((r["bytes"] for r in rows if r["level"] == 0), default=0) or 1
    below: dict[tuple, list] = {}
    for r in rows:
        names = tuple(str(r[c]) for c in path[: r["level"]])
        below.setdefault(names[:-1], []).append((names, r)) if r["level"] else None

    def items(at: tuple) -> str:
        parts = [f'<li style="--share:{r["bytes"] / whole:.4f}"><b>{html.escape(names[-1])}</b> {r["bytes"]} bytes, {100 * r["bytes"] / whole:.2f}%, {r["rows"]} rows{items(names)}</li>' for names, r in below.get(at, [])]
        return f"<ul>{''.join(parts)}</ul>" if parts else ""

    style = "li{list-style:none;background:linear-gradient(90deg,#fc9 calc(100%*var(--share)),transparent 0);margin:1px}"
    return f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style><h1>{html.escape(title)}</h1>{items(())}'
