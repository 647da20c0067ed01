"""Display forms, arguments, descriptions, listings, reductions and their SQL, over the event and part tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions import describe, formatting, naming, parsing
from eventloom.operators import filters, reduce, summary
from eventloom.operators.dedup import deduplicate
from eventloom.operators.ranges import with_running_sum
from eventloom.plans.catalogue import E, events, query, table
from eventloom.plans.named_queries import B, recorded
from eventloom.plans.row_queries import W, frames
from eventloom.plans.views import Source, View, evaluate, field
from eventloom.sources.catalog import Catalog
from eventloom.sources.recording import as_json, as_text, as_xml

def sized(units: list[str], plain: str) -> str:
    """SQL of a number v in the largest unit of 1024 that leaves 1 or more, with one decimal."""
    steps = " ".join(f"when abs(v) >= {1024.0**k} then printf('%.1f {u}', round(v / {1024.0**k}, 1))" for k, u in reversed(list(enumerate(units, 1))))
    return f"case {steps} else {plain} end"


@query("fmt_bitrate", f"select p_partkey, {sized(['kbps', 'Mbps', 'Gbps'], chr(39) * 2 + ' || v || ' + chr(39) + ' bps' + chr(39))} as text from (select p_partkey, (p_partkey * p_partkey * 1024) % 2147483648 as v from part)")
def fmt_bitrate(spark, sf):
    return table(spark, sf, "part").select("p_partkey", formatting.bit_rate((F.col("p_partkey") * F.col("p_partkey") * 1024) % 2147483648).alias("text"))


@query("fmt_frequency", "select p_partkey, case when p_size % 2 = 0 then (p_size // 2) || ' Hz' else (p_size // 2) || '.5 Hz' end as text from part")
def fmt_frequency(spark, sf):
    return table(spark, sf, "part").select("p_partkey", formatting.frequency(F.col("p_size") / 2).alias("text"))


@query(
    "fmt_double",
    "select p_partkey, case when v = floor(v) then format('{:,}', cast(v as bigint)) when v >= 1000 then printf('%.0f', v) when v >= 100 then regexp_replace(printf('%.1f', v), '0+$', '') when v >= 10 then regexp_replace(printf('%.2f', v), '0+$', '') else regexp_replace(printf('%.3f', v), '0+$', '') end as text from (select p_partkey, p_partkey * 0.125 as v from part where p_partkey % 8 in (0, 2, 4, 6))",
)
def fmt_double(spark, sf):
    """Numbers whose halves are exact, so that both round alike."""
    rows = table(spark, sf, "part").where("p_partkey % 2 = 0").withColumn("v", F.col("p_partkey") * 0.125)
    return rows.select("p_partkey", formatting.decimal(F.col("v")).alias("text"))


@query("fmt_struct", f"select p_partkey, case when p_size % 3 = 0 then 'os' || p_size else p_brand end as thread, 'java.x.' || w[1] || '.<init>(int)' as trace, replace(p_brand, '#', '.') as class, 'a.' || w[1] as loader from (select * from part join {W} using (p_partkey))")
def fmt_struct(spark, sf):
    rows = table(spark, sf, "part").join(frames(spark, sf), "p_partkey").select(
        "p_partkey",
        F.struct(F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_brand")).alias("javaName"), F.concat(F.lit("os"), F.col("p_size").cast("string")).alias("osName")).alias("thread"),
        F.struct(F.lit(False).alias("truncated"), F.col("frames")).alias("trace"),
        F.struct(F.translate("p_brand", "#", "/").alias("name"), F.lit("p").alias("package")).alias("class"),
        F.struct(F.struct(F.concat(F.lit("a/"), F.split("p_type", " ")[0]).alias("name")).alias("type"), F.lit("app").alias("name")).alias("loader"),
    )
    return rows.select("p_partkey", *[naming.display(F.col(c), rows.schema[c].dataType).alias(c) for c in ("thread", "trace", "class", "loader")])


@query("fmt_compact", f"select p_partkey, case when p_size % 2 = 0 then w[1] else 'a.' || w[1] end as class, 'b.' || w[1] || '.run(...)' as method from (select * from part join {W} using (p_partkey))")
def fmt_compact(spark, sf):
    first = F.split("p_type", " ")[0]
    name = F.concat(F.when(F.col("p_size") % 2 == 0, "a.b.").otherwise("a."), first)
    return table(spark, sf, "part").select("p_partkey", naming.short_class(name).alias("class"), naming.short_method(F.concat(F.lit("b."), first, F.lit(".run(int, long)"))).alias("method"))


@query(
    "fmt_summary_units",
    """select n, case when b >= 1073741824 then printf('%.2f GB', round(b / 1073741824.0, 2)) when b >= 1048576 then printf('%.1f MB', round(b / 1048576.0, 1)) when b >= 1024 then printf('%.1f KB', round(b / 1024.0, 1)) else b || ' B' end as size,
    case when s >= 3600 then (s // 3600) || 'h' else '' end || case when s >= 3600 and s // 60 % 60 > 0 then ' ' else '' end || case when s // 60 % 60 > 0 then (s // 60 % 60) || 'm' else '' end || case when s % 60 > 0 then ' ' || (s % 60) || 's' else '' end as long from (select distinct p_size as n, cast(p_size as bigint) * p_size * p_size * p_size * 256 as b, 60 + p_size * 97 as s from part)""",
)
def fmt_summary_units(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_size").alias("n")).distinct()
    n = F.col("n").cast("long")
    return rows.select("n", formatting.summary_bytes(n * n * n * n * 256).alias("size"), formatting.summary_duration((60 + n * 97) * 1_000_000_000).alias("long"))


@query("fmt_joined", f"select p_partkey, array_to_string(w, ', ') as text from {W}")
def fmt_joined(spark, sf):
    return table(spark, sf, "part").select("p_partkey", formatting.joined(F.expr("split(concat_ws(' ', p_type, p_brand), ' ')")).alias("text"))


@query("fmt_one_line", "select p_partkey, replace(p_type, ' ', '  ') as text from part")
def fmt_one_line(spark, sf):
    return table(spark, sf, "part").select("p_partkey", formatting.one_line(F.regexp_replace("p_type", " ", "\n\t")).alias("text"))


@query("parse_instant", "select event_id, epoch_us(ts) as us, epoch_us(ts) - 7200000000 as east, cast(null as bigint) as none from events")
def parse_instant(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    read = lambda x: F.unix_micros(parsing.instant_column(x))
    return table(spark, sf, "events").select("event_id", read(text).alias("us"), read(F.concat(text, F.lit("+02:00"))).alias("east"), read(F.date_format("ts", "HH:mm:ss")).alias("none"))


@query("parse_duration", "select n, n * 3600000000000 + 30 * 60000000000 + 5500000000 + n * 1000000 + 7 as a, -n * 1000000 as b, 31536000000000000 as c, cast(null as bigint) as d from (select distinct cast(p_size as bigint) as n from part)")
def parse_duration(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("n")).distinct()
    forms = {"a": F.format_string("%dh30m5.5s%dms7ns", "n", "n"), "b": F.format_string("-%dms", "n"), "c": F.format_string("%dd", F.col("n") + 400), "d": F.format_string("%d parsecs", "n")}
    return rows.select("n", *[parsing.duration_column(x).alias(k) for k, x in forms.items()])


@query("parse_size", "select n, n as a, n * 1024 as b, n * 1048576 + 524288 as c, n * 1073741824 as d, cast(null as bigint) as e from (select distinct cast(p_size as bigint) as n from part)")
def parse_size(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("n")).distinct()
    forms = {"a": "%d", "b": "%dk", "c": "%d.5 MB", "d": "%dg", "e": "%dx"}
    return rows.select("n", *[parsing.size_column(F.format_string(f, "n")).alias(k) for k, f in forms.items()])


@query("type_descriptions", "select p_partkey, p_type || case when p_size % 2 = 0 then ' (Experimental)' else '' end as label, p_type as plain, case when p_size % 3 = 0 then '' else p_brand || '>' || p_name end as categories, p_name as field from part")
def type_descriptions(spark, sf):
    notes = F.concat_ws(",", F.when(F.col("p_size") % 2 == 0, '["jdk.jfr.Experimental",[]]'), F.when(F.col("p_size") % 3 > 0, F.concat(F.lit('["jdk.jfr.Category",[["'), "p_brand", F.lit('","'), "p_name", F.lit('"]]]'))))
    rows = table(spark, sf, "part").select("*", F.concat(F.lit('["'), "p_type", F.lit('","about it",['), notes, F.lit("]]")).alias("type"), F.concat(F.lit('["long","Timespan",[],"'), "p_name", F.lit('","x",false]')).alias("of"))
    label = describe.type_label(F.col("type"), F.lit("?"))
    return rows.select("p_partkey", label.alias("label"), describe.plain_label(label).alias("plain"), F.array_join(describe.categories(F.col("type")), ">").alias("categories"), describe.field_label(F.col("of")).alias("field"))


@query("event_type_paths", f"""select seq, 'GCCPUTime Event' as label, 'jdk.GCCPUTime' as name, 'GCCPUTime Event' as bare from {B} where event_type = 'purchase'""")
def event_type_paths(spark, sf):
    items = (field("seq"), field("label", "eventType.label"), field("name", "eventType.name"), field("bare", "eventType"))
    return evaluate(View(items, (Source("GCCPUTime"),)), recorded(spark, sf))


@query("implied_state", f"select seq, 'STATE_RUNNABLE' as state from {B} where event_type = 'click'")
def implied_state(spark, sf):
    return evaluate(View((field("seq"), field("state")), (Source("ExecutionSample"),)), recorded(spark, sf))


@query("setting_labels", f"select seq, case when k % 5 < 4 then 'Type ' || (k % 5) else 'app.T4' end as type, 'v' || k as value from {B} where event_type = 'view'")
def setting_labels(spark, sf):
    return evaluate(View((field("seq"), field("type", "id"), field("value")), (Source("ActiveSetting"),)), recorded(spark, sf))


@query("listing", f"select row_number() over (order by start_ns, seq) as place, seq from {B} where event_type = 'view'")
def listing(spark, sf):
    """Events in the order of their listing, each with its place in it."""
    return with_running_sum(recorded(spark, sf).listing("ThreadCPULoad"), [], F.lit(1).cast("long"), ["start_ns", "seq"], "place").select("place", "seq")


@query("listing_limit", f"select seq, start_ns from {B} where event_type = 'view' order by start_ns, seq limit 17")
def listing_limit(spark, sf):
    """The first events of a listing: the limit is what is shown."""
    return recorded(spark, sf).listing("ThreadCPULoad", 17).select("seq", "start_ns")


@query("frames_limited", f"select p_partkey, array_to_string([x for x in w[1:3] if length(x) > 5], ',') as shown from {W}")
def frames_limited(spark, sf):
    """The first three frames, of which those of short names count as hidden."""
    words = F.expr("split(concat_ws(' ', p_type, p_brand), ' ')")
    own = F.transform(words, lambda w: F.struct(F.struct(w.alias("name"), (F.length(w) <= 5).alias("hidden")).alias("method")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(filters.first_frames(own, 3), lambda f: f["method"]["name"]), ",").alias("shown"))


@query("metadata_listing", "select * from (values ('app.customer', 0, 'c_custkey', 'bigint'), ('app.nation', 0, 'n_nationkey', 'int')) t(event_type, position, field, type)")
def metadata_listing(spark, sf):
    """The first field of two types."""
    tables = {f"app.{t}": table(spark, sf, t) for t in ("customer", "nation")}
    return Catalog(tables, package="app.").metadata().where("position = 0").select("event_type", "position", "field", F.when(F.col("event_type") == "app.customer", "bigint").otherwise("int").alias("type"))


@query("print_text", """select 'Nation {' || chr(10) || '  n_nationkey = ' || n_nationkey || chr(10) || '  n_name = ' || n_name || chr(10) || '}' as value from nation""")
def print_text(spark, sf):
    return as_text(table(spark, sf, "nation").select("n_nationkey", "n_name"), "Nation")


@query("print_xml", """select '<ROW>' || chr(10) || '    <event_id>' || event_id || '</event_id>' || chr(10) || '    <event_type>' || event_type || '</event_type>' || chr(10) || '</ROW>' as value from events""")
def print_xml(spark, sf):
    return as_xml(events(spark, sf).select("event_id", "event_type"))


@query("json_events", """select '{"event_id":' || event_id || ',"at":"' || case when epoch_us(ts) % 1000 = 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') else strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') end || 'Z","size":' || case when event_id % 3 = 0 then 'null' else cast(event_id as varchar) end || '}' as value from events""")
def json_events(spark, sf):
    """Times as ISO text and a whole number that means none, over all events."""
    size = F.when(F.col("event_id") % 3 == 0, F.lit(-(2**31))).otherwise(F.col("event_id").cast("int"))
    rows = table(spark, sf, "events").select("event_id", F.col("ts").alias("at"), size.alias("size", metadata={"description": "elements, or minimum value for the type int if it is not an array"}))
    return as_json(rows, nulls=True)


# ---- reductions


def bits(x: str, keep: int) -> str:
    """SQL of a whole number below 2^24 rounded to so many binary digits, ties to even."""
    unit = f"pow(2, greatest(0, floor(log2({x})) - {keep - 1}))"
    return f"case when {x} = 0 then 0.0 else round_even({x} / {unit}, 0) * {unit} end"


@query("bfloat16", f"select k, count(*) as n, cast({bits('k * 37', 8)} as double) as x from {E} where k >= 0 group by k")
def bfloat16(spark, sf):
    return events(spark, sf).where("k >= 0").groupBy("k").agg(F.count(F.lit(1)).alias("n")).select("k", "n", reduce.bfloat16((F.col("k") * 37).cast("float")).cast("double").alias("x"))


@query("float16", f"select k, count(*) as n, cast({bits('k * 37', 11)} as double) as x from {E} where k >= 0 and k * 37 < 65000 group by k")
def float16(spark, sf):
    return events(spark, sf).where("k >= 0 and k * 37 < 65000").groupBy("k").agg(F.count(F.lit(1)).alias("n")).select("k", "n", reduce.float16((F.col("k") * 37).cast("double")).cast("double").alias("x"))


@query("stack_depth", f"select p_partkey, cast(least(len(w), 2) as int) as depth, len(w) > 2 as truncated, w[least(len(w), 2)] as last from {W}")
def stack_depth(spark, sf):
    words = F.expr("split(concat_ws(' ', p_type, p_brand), ' ')")
    trace = reduce.shallow(F.struct(F.lit(False).alias("truncated"), words.alias("frames")), 2)
    rows = table(spark, sf, "part").select("p_partkey", trace.alias("t"))
    return rows.select("p_partkey", F.size("t.frames").alias("depth"), "t.truncated", F.element_at("t.frames", -1).alias("last"))


@query("frames_collapsed", "select p_partkey, 'a,' || case when p_size % 6 = 0 then '' when p_size % 6 = 1 then 'x,' else 'x,x,' end || 'b' as frames from part")
def frames_collapsed(spark, sf):
    """Runs of up to five internal frames between two others."""
    own = F.flatten(F.array(F.array(F.lit("a")), F.array_repeat(F.lit("x"), (F.col("p_size") % 6).cast("int")), F.array(F.lit("b"))))
    return table(spark, sf, "part").select("p_partkey", F.array_join(reduce.collapsed(own, lambda f: f == "x"), ",").alias("frames"))


@query("fields_dropped", f"select p_partkey, len(w) as frames, 'method' as frame_fields, 'type,name,descriptor' as method_fields, cast(p_size as int) as kept from part join {W} using (p_partkey)")
def fields_dropped(spark, sf):
    """The fields that are left in frames and methods, and a type's own dropped column."""
    rows = table(spark, sf, "part").join(frames(spark, sf), "p_partkey").select("p_partkey", F.struct(F.lit(False).alias("truncated"), "frames").alias("stackTrace"), F.lit(1).alias("address"), F.col("p_size").cast("int").alias("kept"))
    out = reduce.reduced(rows, reduce.PRESETS["reduced"], "jdk.ThreadPark")
    frame = out.schema["stackTrace"].dataType["frames"].dataType.elementType
    names = lambda kind: ",".join(kind.names)
    assert "address" not in out.columns and isinstance(frame, T.StructType)
    return out.select("p_partkey", F.size("stackTrace.frames").cast("long").alias("frames"), F.lit(names(frame)).alias("frame_fields"), F.lit(names(frame["method"].dataType)).alias("method_fields"), "kept")


@query("dedup_flags", f"select seq from (select seq, k, lag(k) over w as last, row_number() over w as r from {B} window w as (partition by user_id order by start_ns, seq)) where r = 1 or k is distinct from last")
def dedup_flags(spark, sf):
    return deduplicate(_as_flags(spark, sf), "jdk.IntFlag", ["start_ns", "seq"]).select("seq")


@query("dedup_periodic", f"select 'lossless' as preset, count(*) as n from {B} union all select 'default', count(*) from (select k, lag(k) over w as last, row_number() over w as r from {B} window w as (partition by user_id order by start_ns, seq)) where r = 1 or k is distinct from last")
def dedup_periodic(spark, sf):
    """Allocations by thread: all stay in a lossless recording, changes in others."""
    rows = _as_flags(spark, sf).selectExpr("seq", "start_ns", "name as thread", "value as allocated")
    of = lambda preset: deduplicate(rows, "jdk.ThreadAllocationStatistics", ["start_ns", "seq"], periodic=preset != "lossless").agg(F.lit(preset).alias("preset"), F.count(F.lit(1)).alias("n"))
    return of("lossless").union(of("default"))


@query("dedup_none", "select count(*) as n from events")
def dedup_none(spark, sf):
    """A type without a rule keeps all events."""
    return deduplicate(_as_flags(spark, sf), "jdk.ClassLoaderStatistics", ["start_ns", "seq"]).agg(F.count(F.lit(1)).alias("n"))


def _as_flags(spark, sf):
    return events(spark, sf).selectExpr("event_id as seq", "us * 1000 as start_ns", "user_id as name", "k as value")


MINUTE = 60_000_000


@query(
    "gc_context_by_summaries",
    f"""with g as (select user_id, min(us) as start_us, max(us) as end_us, max(us) - min(us) as duration from {E} where event_type = 'signup' group by 1),
    r as (select *, row_number() over (order by duration, start_us, end_us) - 1 as i, count(*) over () as n from g), l as (select * from r where i >= least(n - 1, floor(n * 50 / 100)))
    select e.event_id from (select event_id, us from {E}) e asof left join (select start_us from l) s on e.us >= s.start_us asof left join (select end_us from l) t on e.us <= t.end_us
    where least(e.us - s.start_us, t.end_us - e.us) <= {MINUTE * 600}""",
)
def gc_context_by_summaries(spark, sf):
    """Without collections, pauses run from the first to the last heap summary of each."""
    rows = events(spark, sf)
    summaries = rows.where("event_type = 'signup'").selectExpr("user_id as gcId", "us as start_us")
    none = rows.where("event_type = 'no such'").selectExpr("us as start_us", "us as duration")
    return filters.near_long_collections(rows.select("event_id", "us"), none, summaries, 50, MINUTE * 600, "us", "us").select("event_id")


@query(
    "gc_stats_full",
    f"""with p as (select us, cast(round(value * 1000) as bigint) as d, k from {E} where event_type = 'error') select count(*) as count, count(*) filter (k % 2 = 0) as young, count(*) filter (k % 2 <> 0) as old, cast(sum(d) as bigint) as total, max(d) as max,
    list_sort(list(d))[cast(floor(count(*) / 2) as int) + 1] as median, list_sort(list(d))[cast(least(count(*) - 1, floor(count(*) * 95 / 100)) as int) + 1] as p95,
    (select max(cast(round(value * 1000) as bigint)) from {E} where event_type = 'click') as max_phase_pause, (select max(cast(k as bigint)) from {E} where event_type = 'view' and k % 2 = 0) as heap_before, (select max(cast(k as bigint)) from {E} where event_type = 'view' and k % 2 = 1) as heap_after,
    (select max(cast(k as bigint)) from {E} where event_type = 'purchase' and k % 2 = 1) as metaspace, (select cast(sum(k) as bigint) from {E} where event_type = 'signup') as cpu_user, (select cast(sum(k * 2) as bigint) from {E} where event_type = 'signup') as cpu_system,
    (select arg_min('collector ' || (k % 4), (us, 'collector ' || (k % 4))) from {E} where event_type = 'view') as collector from p having count(*) > 0""",
)
def gc_stats_full(spark, sf):
    rows = events(spark, sf)
    of = lambda t, *x: rows.where(F.col("event_type") == t).selectExpr(*x)
    used = ("if(k % 2 = 0, 'Before GC', 'After GC') as when", "cast(k as bigint) as used")
    pauses = of("error", "us as start_us", "cast(round(value * 1000) as bigint) as duration", "k")
    return summary.collection_statistics(
        pauses,
        F.col("k") % 2 == 0,
        of("click", "cast(round(value * 1000) as bigint) as duration"),
        of("view", *used),
        of("purchase", *used),
        of("signup", "cast(k as bigint) as user", "cast(k * 2 as bigint) as system"),
        of("view", "us as start_us", "concat('collector ', k % 4) as young_collector"),
    )
