"""Summaries: counts, pause statistics, time buckets, byte trees; errors stand for pauses, purchases for allocations."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import summary
from eventloom.plans.catalogue import E, FIELDS, JSON, events, query, table

#: Microseconds of a bucket.
DAY = 86_400_000_000


def pauses(spark, sf):
    return events(spark, sf).where("event_type = 'error'").selectExpr("us as start_us", "cast(round(value * 1000) as bigint) as duration", "concat('cause ', k % 3) as cause", "k")


def sizes(spark, sf, event_type):
    return events(spark, sf).where(F.col("event_type") == event_type).selectExpr("us as start_us", "cast(k - 2 as bigint) as size")


P = f"(select us as start_us, cast(round(value * 1000) as bigint) as duration, 'cause ' || (k % 3) as cause, k from {E} where event_type = 'error')"


@query("summary_overview", f"select min(us) as first, max(us) as last, max(us) - min(us) as duration, count(*) as total, count(distinct event_type) as types from {E}")
def summary_overview(spark, sf):
    return summary.overview(events(spark, sf), "us")


@query("summary_counts", "select event_type, count(*) as count from events group by 1")
def summary_counts(spark, sf):
    return summary.type_counts(events(spark, sf))


@query("summary_top_types", "select event_type, count(*) as count from events group by 1 order by 2 desc, 1 limit 3")
def summary_top_types(spark, sf):
    return summary.type_counts(events(spark, sf), limit=3)


@query("types_list", "select event_type as name, count(*) as count from events group by 1")
def types_list(spark, sf):
    return summary.type_list(summary.type_counts(events(spark, sf)))


@query(
    "gc_stats",
    f"select count(*) as count, count(*) filter (k % 2 = 0) as young, count(*) filter (k % 2 <> 0) as old, cast(sum(duration) as bigint) as total, max(duration) as max, list_sort(list(duration))[cast(floor(count(*) / 2) as int) + 1] as median, list_sort(list(duration))[cast(least(count(*) - 1, floor(count(*) * 95 / 100)) as int) + 1] as p95 from {P}",
)
def gc_stats(spark, sf):
    return summary.pause_statistics(pauses(spark, sf), is_young=F.col("k") % 2 == 0)


@query("causes_map", f"select cause, count(*) as count from {P} group by 1")
def causes_map(spark, sf):
    return summary.causes(pauses(spark, sf))


@query(
    "gc_buckets",
    f"""with p as {P}, b as (select cast(floor((start_us - (select min(start_us) from p)) / {DAY}) as bigint) as bucket, count(*) as count, cast(sum(duration) as bigint) as total, max(duration) as max from p group by 1),
    h as (select cast(floor((us - (select min(start_us) from p)) / {DAY}) as bigint) as bucket, max(k) filter (event_type = 'view') as heap_before, max(k) filter (event_type = 'click') as heap_after from {E} where event_type in ('view', 'click') group by 1)
    select b.*, heap_before, heap_after from b left join h using (bucket)""",
)
def gc_buckets(spark, sf):
    heaps = events(spark, sf).where("event_type in ('view', 'click')").selectExpr("us as start_us", "if(event_type = 'view', 'Before GC', 'After GC') as when", "k as used")
    return summary.pause_buckets(pauses(spark, sf), heaps, DAY)


@query("cpu_buckets", f"with s as (select us, k from {E} where event_type = 'view') select cast(floor((us - (select min(us) from s)) / {DAY}) as bigint) as bucket, avg(k) as k from s group by 1")
def cpu_buckets(spark, sf):
    return summary.mean_buckets(events(spark, sf).where("event_type = 'view'"), DAY, ["k"], "us")


A = f"(select us as start_us, case when event_type = 'purchase' then k - 2 end as a, case when event_type = 'signup' then k - 2 end as p from {E} where event_type in ('purchase', 'signup') and k - 2 > 0)"


@query("alloc_buckets", f"with x as {A} select cast(floor((start_us - (select min(start_us) from x)) / {DAY}) as bigint) as bucket, cast(coalesce(sum(a), 0) as bigint) as allocated, cast(coalesce(sum(p), 0) as bigint) as promoted from x group by 1")
def alloc_buckets(spark, sf):
    return summary.size_buckets(sizes(spark, sf, "purchase"), sizes(spark, sf, "signup"), DAY)


@query(
    "bucket_table",
    f"""with p as {P}, b as (select cast(floor((start_us - (select min(start_us) from p)) / {DAY}) as bigint) as bucket, count(*) as pauses from p group by 1),
    x as {A}, a as (select cast(floor((start_us - (select min(start_us) from x)) / {DAY}) as bigint) as bucket, cast(coalesce(sum(a), 0) as bigint) as allocated, cast(coalesce(sum(p), 0) as bigint) as promoted from x group by 1)
    select bucket, pauses, allocated, promoted from b full join a using (bucket)""",
)
def bucket_table(spark, sf):
    own = pauses(spark, sf)
    counted = own.groupBy(summary.bucket("start_us", own.select(F.min("start_us")).scalar(), DAY).alias("bucket")).agg(F.count(F.lit(1)).alias("pauses"))
    return summary.bucket_table(counted, alloc_buckets(spark, sf))


@query("alloc_rate", f"select event_type, round(sum(k) / ((max(us) - min(us)) / 1000.0 / 1000.0), 9) as per_second from {E} group by 1")
def alloc_rate(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(F.round(summary.rate(F.sum("k"), (F.max("us") - F.min("us")) / 1000.0), 9).alias("per_second"))


@query(
    "byte_tree",
    """select n_regionkey as region, n_name as name, cast((n_regionkey is not null)::int + (n_name is not null)::int as int) as level, count(*) as rows, cast(sum(octet_length(cast('{"region":' || n_regionkey || ',"name":"' || n_name || '"}' as blob))) as bigint) as bytes from nation group by rollup (n_regionkey, n_name)""",
)
def byte_tree(spark, sf):
    return summary.byte_tree(table(spark, sf, "nation").selectExpr("n_regionkey as region", "n_name as name"), ["name"], "region")


@query(
    "byte_tree_events",
    f"""select event_type, user_id, cast(2 - grouping(event_type) - grouping(user_id) as int) as level, count(*) as rows, cast(sum(octet_length(encode({JSON}))) as bigint) as bytes from {E} group by rollup (event_type, user_id)""",
)
def byte_tree_events(spark, sf):
    """byte_tree over all events, by type and user."""
    return summary.byte_tree(events(spark, sf).select(*FIELDS), ["user_id"])
