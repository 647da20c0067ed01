"""Combinations and their expansion, residuals, pairs, sinks and digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators import combine
from eventloom.operators.combine import Combination
from eventloom.plans.catalogue import E, FIELDS, JSON, ORACLES, events, query, table
from eventloom.plans.views import Source, View, agg, evaluate
from eventloom.sources.catalog import Catalog
from eventloom.sources.recording import Options, Recording, as_json, write, write_csv
from eventloom.sources.shared import shared_folder


def rows(spark, sf):
    """Events as those of garbage collections: gcId by user, name by type, start_ns, seq."""
    return events(spark, sf).selectExpr("user_id as gcId", "event_type as name", "k as age", "us * 1000 as start_ns", "event_id as seq", "cast(round(value * 1000) as bigint) as duration_ns", "cast(k as bigint) as size")


R = f"(select user_id as gcId, event_type as name, k as age, us * 1000 as start_ns, event_id as seq, cast(round(value * 1000) as bigint) as duration_ns, cast(k as bigint) as size from {E})"


@query("combine_sum", f"select gcId, min(m) over (partition by gcId) as start_ns, age, size from (select gcId, age, cast(sum(size) as bigint) as size, min(start_ns) as m from {R} group by 1, 2 having sum(size) <> 0)")
def combine_sum(spark, sf):
    spec = Combination("TenuringDistribution", "gcId", ("age",), "sum", "size", drop_zero=True)
    return combine.expanded(combine.combined(rows(spark, sf), spec), spec).select("gcId", "start_ns", "age", "size")


@query("combine_count", f"select gcId, min(start_ns) over (partition by gcId) as start_ns, name from {R}")
def combine_count(spark, sf):
    spec = Combination("JavaExceptionThrow", "gcId", ("name",), "count")
    return combine.expanded(combine.combined(rows(spark, sf), spec), spec).select("gcId", "start_ns", "name")


@query("combine_list_sizes", f"select gcId, min(start_ns) over (partition by gcId) as start_ns, name, age, size from {R}")
def combine_list_sizes(spark, sf):
    spec = Combination("ObjectAllocationInNewTLAB", "gcId", ("name", "age"), "list", "size")
    return combine.expanded(combine.combined(rows(spark, sf), spec), spec).select("gcId", "start_ns", "name", "age", "size")


@query("combine_nested_explode", f"select gcId, name, start_ns, seq, duration_ns, age from {R}")
def combine_nested_explode(spark, sf):
    spec = Combination("GCPhasePause", "gcId", ("name",), "structs", None, ("start_ns", "seq", "duration_ns", "age"), exact=True)
    return combine.expanded(combine.combined(rows(spark, sf), spec), spec).select("gcId", "name", "start_ns", "seq", "duration_ns", "age")


@query("combine_stats_minmax", f"select gcId, name, count(duration_ns) as count, cast(sum(duration_ns) as bigint) as sum, min(duration_ns) as min, max(duration_ns) as max from {R} group by 1, 2")
def combine_stats_minmax(spark, sf):
    spec = Combination("GCPhaseParallel", "gcId", ("name",), "stats", "duration_ns")
    return combine.expanded(combine.combined(rows(spark, sf), spec), spec).select("gcId", "name", "count", "sum", "min", "max")


@query("combine_last_wins", f"select gcId, name, max(start_ns) as start_ns, arg_max_null(size, (start_ns, seq)) as size from {R} group by 1, 2")
def combine_last_wins(spark, sf):
    spec = Combination("GCReferenceStatistics", "gcId", ("name",), "last", None, ("start_ns", "size"))
    return combine.expanded(combine.combined(rows(spark, sf), spec), spec).select("gcId", "name", "start_ns", "size")


@query("combine_entries", f"select gcId, cast(count(distinct (name, age)) as int) as entries, min(start_ns) as start_ns from {R} group by 1")
def combine_entries(spark, sf):
    spec = Combination("ObjectAllocationInNewTLAB", "gcId", ("name", "age"), "list", "size")
    return combine.entry_counts(combine.combined(rows(spark, sf), spec), spec).select("gcId", "entries", "start_ns")


@query("combine_residual", f"select seq, duration_ns - lag(duration_ns, 1, 0) over (partition by gcId order by start_ns, seq) - size as residual, duration_ns as again from {R}")
def combine_residual(spark, sf):
    order = ("start_ns", "seq")
    coded = combine.residuals(rows(spark, sf), "gcId", "duration_ns", "size", order)
    return combine.from_residuals(coded, "gcId", "size", order, to="again").select("seq", "residual", "again")


@query("before_after_pivot", f"select gcId, arg_max_null(size, seq) filter (name = 'view') as before, arg_max_null(size, seq) filter (name = 'click') as after from {R} group by 1")
def before_after_pivot(spark, sf):
    return combine.before_and_after(rows(spark, sf).withColumnRenamed("name", "when"), "gcId", "when", "size", ("view", "click"))


@query("packed_age", f"select age, count(*) as n, (age % 2) * 64 + age as packed, case when age > 0 then cast(pow(2, floor(log2(age))) as bigint) else 0 end as power from {R} group by 1")
def packed_age(spark, sf):
    return rows(spark, sf).groupBy("age").agg(F.count(F.lit(1)).alias("n")).select("age", "n", combine.packed_age(F.col("age") % 2 == 1, F.col("age")).alias("packed"), combine.floor_power_of_two(F.col("age")).alias("power"))


@query("sink_json", """select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' as value from nation""")
def sink_json(spark, sf):
    return as_json(table(spark, sf, "nation"))


@query("sink_json_events", f"select {JSON} as value from {E}")
def sink_json_events(spark, sf):
    """sink_json over all events."""
    return as_json(events(spark, sf).select(*FIELDS))


# ---- the combinations by name

#: Of each column that a combination may want: what stands for it in the rows above, which is the same in Spark and SQL.
COLUMNS = {
    **{c: "name" for c in ("objectClass", "parkedClass", "monitorClass", "thrownClass", "type", "when", "eventThread", "sampledThread", "stackTrace", "previousOwner", "message", "from")},
    **{c: "age" for c in ("tlabSize", "plabSize", "time", "address", "index", "id", "age", "packedAge", "count", "heapUsed", "heapSpace", "timeout", "until")},
    **{c: "size" for c in ("allocationSize", "objectSize", "weight", "size", "totalSize", "value", "start", "used", "specializedChunks", "smallChunks", "mediumChunks", "humongousChunks")},
    **{c: c for c in ("start_ns", "seq", "duration_ns")},
    "metadataType": "age % 2",
    "to": "age % 3",
}


def named(name: str, key: str):
    """Registers the expansion of what a named combination keeps, with SQL for it."""
    spec = combine.COMBINATIONS[key]
    wanted = [c for c in dict.fromkeys([*spec.keys, *spec.fields, *([spec.value] if spec.value else [])])]
    group = "gcId as " + spec.group if spec.group != "gcId" else "gcId"
    q = lambda c: f'"{c}"'
    t = f"(select gcId as g, min(start_ns) over (partition by gcId) as first, start_ns, seq, " + ", ".join(f"{COLUMNS[c]} as {q('c_' + c)}" for c in wanted) + f" from {R})"
    keys = ", ".join(f"{q('c_' + c)} as {q(c)}" for c in spec.keys)
    by = "group by g, first, " + ", ".join(q("c_" + c) for c in spec.keys)
    if spec.leaf in ("list", "structs"):
        kept = [spec.value] if spec.leaf == "list" else list(spec.fields)
        sql = f"select g as {q(spec.group)}, {keys}, " + ", ".join(f"{q('c_' + c)} as {q(c)}" for c in kept) + ("" if "start_ns" in kept else ", first as start_ns") + f" from {t}"
    elif spec.leaf == "count":
        kept, sql = [], f"select g as {q(spec.group)}, {keys}, first as start_ns from {t}"
    elif spec.leaf == "sum":
        kept, sql = [spec.value], f"select g as {q(spec.group)}, {keys}, cast(sum({q('c_' + spec.value)}) as bigint) as {q(spec.value)}, first as start_ns from {t} {by}"
    else:
        kept = list(spec.fields)
        last = ", ".join(f"arg_max_null({q('c_' + c)}, (start_ns, seq)) as {q(c)}" for c in kept)
        sql = f"select g as {q(spec.group)}, {keys}, {last}" + ("" if "start_ns" in kept else ", first as start_ns") + f" from {t} {by}"

    def run(spark, sf):
        own = rows(spark, sf).selectExpr(group, *dict.fromkeys(["start_ns", "seq", *[f"{COLUMNS[c]} as `{c}`" for c in wanted if c not in ("start_ns", "seq")]]))
        out = combine.expanded(combine.combined(own, spec), spec)
        return out.select(*dict.fromkeys([spec.group, *spec.keys, *kept, "start_ns"]))

    query(name, sql)(run)


for _key in (
    "ObjectAllocationInNewTLAB.sum", "ObjectAllocationOutsideTLAB", "PromoteObjectOutsidePLAB", "PromoteObjectInNewPLAB.sum", "ObjectAllocationSample", "ObjectAllocationSample.sum", "ObjectAllocationSample.exact", "ZStatisticsSampler", "ObjectCount", "MetaspaceChunkFreeListSummary",
    "GCHeapSummary", "G1HeapRegionTypeChange", "G1HeapRegionInformation", "JavaExceptionThrow", "JavaExceptionThrow.exact", "ThreadPark.exact", "ThreadPark.count", "ThreadPark", "ThreadSleep.count", "ThreadSleep", "JavaMonitorEnter.count", "JavaMonitorEnter", "JavaMonitorWait.count", "JavaMonitorWait", "ExecutionSample",
):
    named("combination_" + "".join("_" + c.lower() if c.isupper() and k and not (_key[k - 1].isupper() or _key[k - 1] == ".") else "_" if c == "." else c.lower() for k, c in enumerate(_key)).strip("_"), _key)


# ---- whole recordings


def recorded_tables(spark, sf):
    """Types of a recording: collections, pauses, periodic loads, flags, allocations, counters, ages, regions; all events have a part in it."""
    base = rows(spark, sf)
    of = lambda t: base.where(F.col("name") == t)
    return {
        "jdk.GarbageCollection": of("error").selectExpr("seq as gcId", "start_ns", "seq", "duration_ns"),
        "jdk.GCPhasePause": of("click").selectExpr("gcId", "concat('P', age % 3) as name", "start_ns", "seq", "duration_ns", "'t' as eventThread"),
        "jdk.ThreadAllocationStatistics": of("view").selectExpr("gcId as thread", "age % 3 as allocated", "start_ns", "seq"),
        "jdk.IntFlag": of("signup").selectExpr("concat('f', gcId) as name", "age % 2 as value", "start_ns", "seq"),
        "jdk.ObjectAllocationSample": of("purchase").selectExpr("concat('C', age % 4) as objectClass", "size as weight", "named_struct('truncated', false, 'frames', array('a', 'b')) as stackTrace", "'t' as eventThread", "start_ns", "seq"),
        "jdk.ZStatisticsCounter": of("view").selectExpr("age % 5 as id", "size as increment", "duration_ns as value", "start_ns", "seq"),
        "jdk.TenuringDistribution": of("signup").selectExpr("gcId", "age % 8 as age", "size", "start_ns", "seq"),
        "jdk.PromoteObjectInNewPLAB": of("click").selectExpr("gcId", "concat('C', age % 4) as objectClass", "size as objectSize", "age % 2 = 0 as tenured", "age % 16 as tenuringAge", "size as plabSize", "'t' as eventThread", "start_ns", "seq"),
        "jdk.G1HeapRegionTypeChange": of("error").selectExpr("age % 2 as `from`", "age % 3 as `to`", "age as index", "size as start", "size as used", "start_ns", "seq"),
    }


def reread(spark, sf, preset: str, types: list[str] | None = None) -> Recording:
    path = f"{shared_folder(spark)}/recording"
    write(recorded_tables(spark, sf), path, preset, config=preset, types=types)
    return Recording.open(spark, path)


_CHANGES = "(select *, lag({v}) over w as last, row_number() over w as r from {t} window w as (partition by {k} order by start_ns, seq)) where r = 1 or {v} is distinct from last"
_FLAGS = f"select 'jdk.IntFlag' as event_type, seq, start_ns, age % 2 as x from {_CHANGES.format(v='(age % 2)', k='gcId', t=f'(select * from {R} where name = {chr(39)}signup{chr(39)})')}"


@query(
    "recording_lossless",
    f"""select 'jdk.GarbageCollection' as event_type, seq, start_ns, duration_ns as x from {R} where name = 'error' union all select 'jdk.GCPhasePause', seq, start_ns, duration_ns from {R} where name = 'click'
    union all select 'jdk.ThreadAllocationStatistics', seq, start_ns, age % 3 from {R} where name = 'view' union all {_FLAGS} union all select 'jdk.ObjectAllocationSample', seq, start_ns, size from {R} where name = 'purchase'
    union all select 'jdk.ZStatisticsCounter', seq, start_ns, duration_ns from {R} where name = 'view' union all select 'jdk.TenuringDistribution', seq, start_ns, size from {R} where name = 'signup'
    union all select 'jdk.PromoteObjectInNewPLAB', seq, start_ns, age % 16 from {R} where name = 'click' union all select 'jdk.G1HeapRegionTypeChange', seq, start_ns, size from {R} where name = 'error' and age % 2 <> age % 3""",
)
def recording_lossless(spark, sf):
    """All events of a lossless recording as they come back: none is lost but repeated flags and changes to the same type."""
    return _each(reread(spark, sf, "lossless"))


VALUES = {"GarbageCollection": "duration_ns", "GCPhasePause": "duration_ns", "ThreadAllocationStatistics": "allocated", "IntFlag": "value", "ObjectAllocationSample": "weight", "ZStatisticsCounter": "value", "TenuringDistribution": "size", "PromoteObjectInNewPLAB": "tenuringAge", "G1HeapRegionTypeChange": "used"}


def _each(found: Recording):
    parts = [found.events(f"jdk.{t}").select(F.lit(f"jdk.{t}").alias("event_type"), F.col("seq").cast("long"), F.col("start_ns").cast("long"), F.col(x).cast("long").alias("x")) for t, x in VALUES.items()]
    return reduce(DataFrame.unionByName, parts)


#: Of each type in a lossy recording: events that come back, and a sum.
_PERIODIC = _CHANGES.format(v="(age % 3)", k="gcId", t=f"(select * from {R} where name = 'view')")
_LOSSY = f"""select 'jdk.GarbageCollection' as event_type, count(*) as n, cast(sum(greatest(least(duration_ns, 31536000000000000), -31536000000000000) // 1000 * 1000) as bigint) as total from {R} where name = 'error'
union all select 'jdk.GCPhasePause', count(*), cast(sum(duration_ns // 1000 * 1000) as bigint) from {R} where name = 'click' union all select 'jdk.ThreadAllocationStatistics', count(*), cast(sum(age % 3) as bigint) from {_PERIODIC}
union all select 'jdk.IntFlag', count(*), cast(sum(x) as bigint) from ({_FLAGS}) union all select 'jdk.ZStatisticsCounter', count(*), cast(sum(duration_ns) as bigint) from {R} where name = 'view'
union all select 'jdk.TenuringDistribution', count(*), cast(sum(size) as bigint) from (select gcId, age % 8 as age, sum(size) as size from {R} where name = 'signup' group by 1, 2 having sum(size) <> 0)
union all select 'jdk.G1HeapRegionTypeChange', count(*), cast(sum(size) as bigint) from {R} where name = 'error' and age % 2 <> age % 3"""


def _sums(found: Recording):
    parts = [found.events(f"jdk.{t}").agg(F.lit(f"jdk.{t}").alias("event_type"), F.count(F.lit(1)).alias("n"), F.sum(x).cast("long").alias("total")) for t, x in VALUES.items()]
    return reduce(DataFrame.unionByName, parts)


@query("recording_default", _LOSSY + f" union all select 'jdk.ObjectAllocationSample', count(*), cast(sum(size) as bigint) from {R} where name = 'purchase' union all select 'jdk.PromoteObjectInNewPLAB', count(*), cast(sum(age % 16) as bigint) from {R} where name = 'click'")
def recording_default(spark, sf):
    return _sums(reread(spark, sf, "default"))


@query("recording_gc_log", _LOSSY + f" union all select 'jdk.ObjectAllocationSample', count(*), cast(sum(size) as bigint) from {R} where name = 'purchase' union all select 'jdk.PromoteObjectInNewPLAB', count(*), cast(sum(age % 16) as bigint) from {R} where name = 'click'")
def recording_gc_log(spark, sf):
    return _sums(reread(spark, sf, "gc-log"))


@query(
    "recording_reduced",
    _LOSSY
    + f""" union all select 'jdk.ObjectAllocationSample', count(*), cast(sum(w) as bigint) from (select coalesce(gc, (select arg_max(gc, (beg, gc)) + 1 from m), 1) as next, c, sum(size) as w from (select start_ns as t, age % 4 as c, size from {R} where name = 'purchase') e asof left join m on e.t <= m.beg group by 1, 2)
    union all select 'jdk.PromoteObjectInNewPLAB', count(*), cast(sum(a % 64) as bigint) from (select distinct gcId, age % 4 as c, (case when age % 2 = 0 then 64 else 0 end) + age % 16 as a, case when size > 0 then pow(2, floor(log2(size))) else 0 end as p from {R} where name = 'click')""",
)
def recording_reduced(spark, sf):
    """Allocations are summed by the next collection and class, promotions by age and size of the buffer."""
    return _sums(reread(spark, sf, "reduced"))


ORACLES["recording_reduced"] = f"with m0 as (select seq as gc, start_ns as beg from {R} where name = 'error' union all select gcId, start_ns from {R} where name in ('click', 'signup')), m as (select min(gc) as gc, beg from (select gc, min(beg) as beg from m0 group by 1) group by beg) " + ORACLES["recording_reduced"]


@query("recording_many", "select event_type, count(*) * 2 as n from (select case event_type when 'error' then 'jdk.GarbageCollection' when 'click' then 'jdk.GCPhasePause' end as event_type from events where event_type in ('error', 'click')) group by 1")
def recording_many(spark, sf):
    """Two recordings of different times read as one, and one more of the same time left out."""
    path, tables = shared_folder(spark), {t: df for t, df in recorded_tables(spark, sf).items() if t in ("jdk.GarbageCollection", "jdk.GCPhasePause")}
    write(tables, f"{path}/a", "lossless")
    write({t: df.withColumn("start_ns", F.col("start_ns") + 10**18) for t, df in tables.items()}, f"{path}/b", "lossless")
    write(tables, f"{path}/c", "lossless")
    found = Recording.open_folder(spark, path)
    parts = [found.events(t).agg(F.lit(t).alias("event_type"), F.count(F.lit(1)).alias("n")) for t in found.types()]
    return reduce(DataFrame.unionByName, parts)


@query("recording_facts", "select 'jdk.GarbageCollection' as event_type, count(*) as count, min(epoch_us(ts)) * 1000 as start_ns, true as intact, false as truncated from events where event_type = 'error'")
def recording_facts(spark, sf):
    """What a recording says of itself: counts, first start, whether it is intact and whole."""
    path = f"{shared_folder(spark)}/r"
    write({"jdk.GarbageCollection": recorded_tables(spark, sf)["jdk.GarbageCollection"]}, path, "lossless")
    found = Recording.open(spark, path)
    return found.counts().join(found.verify(), "event_type").join(found.damage(), ["path", "event_type"]).crossJoin(found.span()).select("event_type", "count", "start_ns", "intact", "truncated")


@query("recording_view", f"select count(*) as count, cast(sum(duration_ns) as bigint) as total, max(duration_ns) as longest from {R} where name = 'error' having count(*) > 0")
def recording_view(spark, sf):
    """A view over a recording that has been written and read again."""
    view = View((agg("count", "COUNT"), agg("total", "SUM", "duration"), agg("longest", "MAX", "duration")), (Source("GarbageCollection"),))
    return evaluate(view, Catalog.of_recording(reread(spark, sf, "lossless", ["jdk.GarbageCollection"])))


def _part(spark, sf, *types: str) -> dict:
    return {f"jdk.{t}": recorded_tables(spark, sf)[f"jdk.{t}"] for t in types}


@query("recording_inflated", f"select seq, gcId, 'P' || (age % 3) as name, duration_ns from {R} where name = 'click'".replace("gcId,", '"gcId",'))
def recording_inflated(spark, sf):
    """Combined events of a recording, written back as plain ones and read again."""
    path = shared_folder(spark)
    write(_part(spark, sf, "GCPhasePause"), f"{path}/r", "lossless")
    Recording.open(spark, f"{path}/r").inflate(f"{path}/plain")
    return spark.read.parquet(f"{path}/plain/jdk.GCPhasePause").select("seq", "gcId", "name", "duration_ns")


@query("recording_raw", f"select gcId, 'P' || (age % 3) as name, count(*) as events from {R} where name = 'click' group by 1, 2".replace("gcId,", '"gcId",'))
def recording_raw(spark, sf):
    """What a recording stores for combined events, unexpanded."""
    path = f"{shared_folder(spark)}/r"
    write(_part(spark, sf, "GCPhasePause"), path, "default")
    rows = Recording.open(spark, path, Options().with_expansion(False)).events("jdk.GCPhasePause")
    return rows.groupBy("gcId", "name").agg(F.sum(F.size("leaf")).alias("events"))


@query("recording_options", f"select 'jdk.GCPhasePause' as event_type, count(*) as n from {R} where name = 'click' and duration_ns > 50000")
def recording_options(spark, sf):
    """Only some types of a recording, and only some of their events."""
    path = f"{shared_folder(spark)}/r"
    write(_part(spark, sf, "GCPhasePause", "GarbageCollection"), path, "lossless")
    options = Options().with_types(lambda t: t.endswith("Pause")).with_condition(F.col("duration_ns") > 50_000)
    found = Recording.open(spark, path, options)
    parts = [found.events(t).agg(F.lit(t).alias("event_type"), F.count(F.lit(1)).alias("n")) for t in found.types()]
    return reduce(DataFrame.unionByName, parts)


@query("recording_codecs", f"select unnest(['gzip', 'lz4', 'none', 'zstd']) as compression, count(*) as n, cast(sum(duration_ns) as bigint) as total from {R} where name = 'error' group by 1")
def recording_codecs(spark, sf):
    path, parts = shared_folder(spark), []
    for codec in ("gzip", "lz4", "none", "zstd"):
        write(_part(spark, sf, "GarbageCollection"), f"{path}/{codec}", "lossless", compression=codec)
        parts.append(Recording.open(spark, f"{path}/{codec}").events("jdk.GarbageCollection").agg(F.lit(codec).alias("compression"), F.count(F.lit(1)).alias("n"), F.sum("duration_ns").alias("total")))
    return reduce(DataFrame.unionByName, parts)


@query("recording_summary", f"select 'gc-log' as preset, 'run' as config, 'zstd' as compression, 1 as version, count(*) as events, 1 as types, min(start_ns) as start_ns, max(start_ns + greatest(duration_ns, 0)) as end_ns from {R} where name = 'error'")
def recording_summary(spark, sf):
    """The header of a recording and what it holds, without a look at its events."""
    path = f"{shared_folder(spark)}/r"
    write(_part(spark, sf, "GarbageCollection"), path, "gc-log", config="run")
    found = Recording.open(spark, path).summary()
    return found.select("preset", "config", "compression", F.col("version").cast("int").alias("version"), "events", F.col("types").cast("int").alias("types"), "start_ns", "end_ns")


@query("sink_csv", "select event_id, event_type from events")
def sink_csv(spark, sf):
    """Rows written as CSV and read again."""
    path = f"{shared_folder(spark)}/csv"
    write_csv(events(spark, sf).select("event_id", "event_type"), path)
    return spark.read.option("header", True).schema("event_id long, event_type string").csv(path)
