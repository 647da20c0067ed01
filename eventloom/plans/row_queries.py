"""Filters, as-of lookups, deduplication, reductions and display forms, row by row."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from eventloom.functions import formatting, naming
from eventloom.operators import asof, dedup, filters, reduce
from eventloom.operators.ranges import with_previous
from eventloom.plans.catalogue import E, events, query, table

FROM, TO = datetime(2024, 1, 5), datetime(2024, 2, 20)


@query("filter_time_window", f"select event_id, event_type from events where ts >= timestamp '{FROM}' and ts <= timestamp '{TO}'")
def filter_time_window(spark, sf):
    return events(spark, sf).where(filters.TimeWindow(FROM, TO).condition("ts")).select("event_id", "event_type")


@query("filter_time_containment", f"select event_id from (select event_id, ts, ts + to_microseconds(cast(value * 60000000 as bigint)) as done from events) where ts >= timestamp '{FROM}' and coalesce(done, ts) <= timestamp '{TO}'")
def filter_time_containment(spark, sf):
    rows = events(spark, sf).withColumn("done", F.timestamp_micros(F.col("us") + F.round(F.col("value") * 60_000_000).cast("long")).cast("timestamp_ntz"))
    return rows.where(filters.TimeWindow(start=FROM, end=TO).condition("ts", "done")).select("event_id")


@query("filter_types_ci", "select event_id, event_type from events where lower(event_type) in ('error', 'signup')")
def filter_types_ci(spark, sf):
    return filters.of_types(events(spark, sf), ["ERROR", "SignUp"]).select("event_id", "event_type")


@query("filter_glob", "select event_id, event_type from events where regexp_matches(event_type, '^(?i)(.*i.*|p.rchase)$')")
def filter_glob(spark, sf):
    return filters.like_types(events(spark, sf), ["*I*", "p?rchase"]).select("event_id", "event_type")


@query("filter_category", "select event_id, event_type from events where event_type in ('purchase', 'signup')")
def filter_category(spark, sf):
    types = spark.createDataFrame([("purchase", ["Shop", "Money"]), ("signup", ["Account"]), ("view", ["Page"]), ("click", None)], "name string, categories array<string>")
    return filters.in_categories(events(spark, sf), types, ["mon*", "ACC*"]).select("event_id", "event_type")


@query("filter_and_or", "select event_id from events where (event_type = 'view' and value > 100) or cast(user_id as varchar) = '5'")
def filter_and_or(spark, sf):
    both = filters.all_of(filters.equals("event_type", "view"), F.col("value") > 100)
    return events(spark, sf).where(filters.any_of(both, filters.equals("user_id", "5"))).select("event_id")


@query("filter_idle_changes", "select o_orderkey from orders where (o_orderstatus = 'F') is distinct from (o_orderpriority < '3')")
def filter_idle_changes(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderstatus = 'F' as before", "o_orderpriority < '3' as after")
    return filters.without_idle_changes(rows, "before", "after").select("o_orderkey")


MINUTE = 60_000_000
G = f"(select event_id as gc_id, us as start_us, us + cast(round(value * 1000) as bigint) as end_us, cast(round(value * 1000) as bigint) as duration from {E} where event_type = 'error')"


@query(
    "gc_percentile_context",
    f"""with g as {G}, r as (select *, row_number() over (order by duration, start_us, end_us) - 1 as i, count(*) over () as n from g), l as (select * from r where i >= least(n - 1, floor(n * 90 / 100)))
    select e.event_id from (select event_id, us from {E}) e asof left join (select start_us from l) s on e.us >= s.start_us asof left join (select end_us from l) t on e.us <= t.end_us
    where least(e.us - s.start_us, t.end_us - e.us) <= {MINUTE}""",
)
def gc_percentile_context(spark, sf):
    rows = events(spark, sf)
    pauses = rows.where("event_type = 'error'").selectExpr("us as start_us", "us + cast(round(value * 1000) as bigint) as end_us", "cast(round(value * 1000) as bigint) as duration")
    return filters.near_long_pauses(rows.select("event_id", "us"), pauses, 90, MINUTE, "us", "us").select("event_id")


@query("next_gc_id", f"with g as {G} select event_id, cast(coalesce(gc_id, (select arg_max(gc_id, (start_us, gc_id)) + 1 from g), 1) as bigint) as next_id from {E} e asof left join g on e.us <= g.start_us")
def next_gc_id(spark, sf):
    rows = events(spark, sf)
    marks = rows.where("event_type = 'error'").selectExpr("event_id as gc_id", "us as at")
    return asof.next_id(rows.select("event_id", "us"), marks, "us", "at", "gc_id").select("event_id", "next_id")


@query("previous_asof", f"with g as {G} select event_id, gc_id as before_id from {E} e asof left join g on e.us >= g.start_us")
def previous_asof(spark, sf):
    rows = events(spark, sf)
    marks = rows.where("event_type = 'error'").selectExpr("event_id as gc_id", "us as at")
    return asof.lookup(rows.select("event_id", "us"), marks, "us", "at", "gc_id", "before_id", forward=False).select("event_id", "before_id")


@query("label_lookup", "select c_custkey, coalesce(n_name, cast(c_nationkey as varchar)) as label from customer left join nation on c_nationkey = n_nationkey")
def label_lookup(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.col("c_nationkey").cast("string")).alias("label"))


@query("dedup_changes", f"select event_id from (select event_id, k, lag(k) over w as last, row_number() over w as r from {E} window w as (partition by user_id order by ts, event_id)) where r = 1 or k is distinct from last")
def dedup_changes(spark, sf):
    return dedup.changes(events(spark, sf), ["user_id"], ["k"], ["ts", "event_id"]).select("event_id")


@query("dedup_first_per_key", "select event_id from (select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) as r from events) where r = 1")
def dedup_first_per_key(spark, sf):
    return dedup.first_of_each(events(spark, sf), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id")


@query("dedup_singleton", "select event_id from (select event_id, event_type, lag(event_type) over w as last, row_number() over w as r from events window w as (order by ts, event_id)) where r = 1 or event_type is distinct from last")
def dedup_singleton(spark, sf):
    return dedup.changes(events(spark, sf), [], ["event_type"], ["us", "event_id"]).select("event_id")


@query("quantize_ts", f"select event_id, us * 1000 // 1000000 * 1000000 as ns, us * 1000 // 1000000 as tick from {E}")
def quantize_ts(spark, sf):
    ns = F.col("us") * 1000
    return events(spark, sf).select("event_id", reduce.quantised(ns, 1_000_000).alias("ns"), reduce.ticks(ns, 1_000_000).alias("tick"))


@query("delta_ts", f"select event_id, us // 1000 - lag(us // 1000, 1, 0) over (partition by event_type order by us, event_id) as delta from {E}")
def delta_ts(spark, sf):
    ticks = reduce.ticks(F.col("us"), 1_000)
    rows = with_previous(events(spark, sf), ["event_type"], ticks, ["us", "event_id"])
    return rows.select("event_id", (ticks - F.when(F.col("__first"), 0).otherwise(F.col("__last"))).alias("delta"))


@query("quantize_duration", "select event_id, greatest(least(cast(round(value * 1e9) as bigint), 31536000000000000), -31536000000000000) // 1000 * 1000 as ns from events")
def quantize_duration(spark, sf):
    return events(spark, sf).select("event_id", reduce.quantised_duration(F.round(F.col("value") * 1e9).cast("long"), 1_000).alias("ns"))


@query("aligned_bytes_roundtrip", f"select k, case when k >= 0 and k % 8 = 0 then k // 8 else k + {1 << 60} end as code, cast(k as bigint) as again, count(*) as n from {E} group by 1")
def aligned_bytes_roundtrip(spark, sf):
    code = reduce.aligned(F.col("k").cast("long"))
    return events(spark, sf).groupBy("k").agg(F.count(F.lit(1)).alias("n")).select("k", code.alias("code"), reduce.unaligned(code).alias("again"), "n")


@query("effectively_zero", "select count(*) filter (abs(cast(round(value * 1e6) as bigint)) < 1000000) as n from events")
def effectively_zero(spark, sf):
    return events(spark, sf).agg(F.count_if(reduce.is_negligible(F.round(F.col("value") * 1e6).cast("long"), 1_000_000)).alias("n"))


@query(
    "fmt_memory",
    "select p_partkey, case when v >= 1073741824 then printf('%.1f GB', round(v / 1073741824.0, 1)) when v >= 1048576 then printf('%.1f MB', round(v / 1048576.0, 1)) when v >= 1024 then printf('%.1f kB', round(v / 1024.0, 1)) when v = 1 then '1 byte' else v || ' bytes' end as text from (select p_partkey, (p_partkey * p_partkey * 7) % 5000000 as v from part)",
)
def fmt_memory(spark, sf):
    return table(spark, sf, "part").select("p_partkey", formatting.memory(F.col("p_partkey") * F.col("p_partkey") * 7 % 5_000_000).alias("text"))


@query("fmt_percent", "select l_discount, printf('%.2f%%', round(l_discount * 100, 2)) as text from lineitem group by 1")
def fmt_percent(spark, sf):
    return table(spark, sf, "lineitem").select("l_discount").distinct().select("l_discount", formatting.percentage(F.col("l_discount")).alias("text"))


@query("fmt_integer", "select o_orderkey, format('{:,}', o_orderkey * 1234567 - 5000000) as text from orders")
def fmt_integer(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", formatting.integer(F.col("o_orderkey") * 1_234_567 - 5_000_000).alias("text"))


@query(
    "fmt_timespan",
    "select s, case when s = 0 then '0 s' when s >= 3600 then (s // 3600) || ' h ' || (s % 3600 // 60) || ' m' when s >= 60 then (s // 60) || ' m ' || (s % 60) || ' s' when s >= 10 then printf('%.1f s', s::double) else printf('%.2f s', s::double) end as text from (select distinct p_size * 97 as s from part union all select 0 union all select 7 union all select 42)",
)
def fmt_timespan(spark, sf):
    rows = table(spark, sf, "part").select((F.col("p_size") * 97).cast("long").alias("s")).distinct().union(spark.range(0, 43).where("id in (0, 7, 42)"))
    return rows.select("s", formatting.timespan(F.col("s") * 1_000_000_000).alias("text"))


@query("fmt_clock", "select event_id, strftime(ts, '%H:%M:%S') as text from events")
def fmt_clock(spark, sf):
    return events(spark, sf).select("event_id", formatting.clock(F.col("ts")).alias("text"))


@query("fmt_address", f"select event_id, '0x' || case when length(hex(us)) < 8 then lpad(hex(us), 8, '0') else hex(us) end as text from {E}")
def fmt_address(spark, sf):
    return events(spark, sf).select("event_id", formatting.address(F.col("us")).alias("text"))


@query("fmt_class", "select p_partkey, repeat('[]', p_size % 3) as dims, case when p_size % 3 > 0 then 'java.' || replace(p_brand, '#', '.') || repeat('[]', p_size % 3) else 'java.' || replace(p_brand, '#', '.') end as name from part")
def fmt_class(spark, sf):
    raw = F.expr("concat('java/', replace(p_brand, '#', '/'))")
    name = F.when(F.col("p_size") % 3 > 0, F.concat(F.expr("repeat('[', p_size % 3)"), F.lit("L"), raw, F.lit(";"))).otherwise(raw)
    return table(spark, sf, "part").select("p_partkey", F.expr("repeat('[]', p_size % 3)").alias("dims"), naming.class_name(name).alias("name"))


@query("edit_distance_topk", "select n_name from nation order by levenshtein(lower(n_name), 'nation_7'), n_name limit 10")
def edit_distance_topk(spark, sf):
    return table(spark, sf, "nation").orderBy(F.levenshtein(F.lower("n_name"), F.lit("nation_7")), "n_name").limit(10).select("n_name")


def frames(spark, sf):
    """A stack for each part: the words of its type and brand as class names."""
    words = F.expr("split(concat_ws(' ', p_type, p_brand), ' ')")
    frame = lambda w, i: F.struct(F.struct(F.struct(F.when(i % 2 == 0, F.concat(F.lit("java.x."), w)).otherwise(w).alias("name")).alias("type"), F.when(i == 0, "<init>").otherwise("run").alias("name"), F.lit("(I)V").alias("descriptor")).alias("method"), i.alias("lineNumber"))
    return table(spark, sf, "part").select("p_partkey", F.transform(words, frame).alias("frames"))


W = "(select p_partkey, string_split(p_type || ' ' || p_brand, ' ') as w from part)"


@query("stack_top_frame", f"select p_partkey, 'java.x.' || w[1] as top, case when len(w) > 1 then w[2] else 'java.x.' || w[1] end as ordinary, cast(len(w) as int) as depth from {W}")
def stack_top_frame(spark, sf):
    name = lambda f: f["method"]["type"]["name"]
    return frames(spark, sf).select("p_partkey", name(naming.top_frame(F.col("frames"))).alias("top"), name(naming.top_ordinary_frame(F.col("frames"))).alias("ordinary"), F.size("frames").alias("depth"))


@query("stack_app_frame", f"select p_partkey, case when len(w) > 1 then w[2] || '.run(int)' end as app from {W}")
def stack_app_frame(spark, sf):
    return frames(spark, sf).select("p_partkey", naming.method(naming.top_application_frame(F.col("frames"))["method"]).alias("app"))
