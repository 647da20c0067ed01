"""The named views over a recording that is made of the event table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import naming
from eventloom.functions.formatting import FOREVER
from eventloom.plans.catalogue import E, events, query
from eventloom.plans.named_views import view
from eventloom.plans.view_queries import exc
from eventloom.sources.catalog import RECORDED, Catalog

DAY_NS = 86_400_000_000_000
SETTINGS = ("enabled", "threshold", "stackTrace", "period", "cutoff", "throttle")
#: Of each type: the events that stand for it, and its columns beside seq and start_ns (d: the start of its day).
CLASS, THREAD = "named_struct('name', concat('{}', k % {}), 'package', 'app')", "named_struct('javaName', concat('t', user_id % 5), 'javaThreadId', user_id % 5)"
FRAME = "named_struct('method', named_struct('type', named_struct('name', {}, 'package', 'p'), 'name', {}, 'descriptor', '(I)V'), 'lineNumber', k)"
TRACE = f"named_struct('truncated', false, 'frames', array({FRAME.format('if(k % 3 = 0, ' + chr(39) + 'java/util/HashMap' + chr(39) + ', concat(' + chr(39) + 'app/C' + chr(39) + ', k % 5))', 'if(k % 4 = 0, ' + chr(39) + '<init>' + chr(39) + ', ' + chr(39) + 'put' + chr(39) + ')')}, {FRAME.format('concat(' + chr(39) + 'app/D' + chr(39) + ', user_id % 4)', chr(39) + 'call' + chr(39))}))"
TYPES = {
    "GarbageCollection": ("error", "seq as gcId, if(k % 2 = 0, 'New', 'Old') as name, concat('cause ', k % 3) as cause, ns as sumOfPauses, ns as longestPause, ns as duration_ns"),
    "GCPhasePause": ("click", "user_id as gcId, concat('Pause ', k % 4) as name, ns as duration_ns"),
    "GCPhasePauseLevel1": ("view", "user_id as gcId, concat('Sub ', k % 3) as name, ns as duration_ns"),
    "GCCPUTime": ("purchase", "k * 10 as userTime, k * 3 as systemTime, k * 7 as realTime"),
    "CPULoad": ("view", "k % 100 / 100D as jvmUser, k % 7 / 8D as jvmSystem, k % 50 / 50D as machineTotal"),
    "ExceptionStatistics": ("signup", "seq * 2 as throwables"),
    "JavaExceptionThrow": ("error", f"{CLASS.format('app/E', 4)} as thrownClass, {TRACE} as stackTrace"),
    "ExecutionSample": ("click", f"{TRACE} as stackTrace, {THREAD} as sampledThread"),
    "ObjectAllocationSample": ("purchase", f"named_struct('name', concat('[Lapp/K', k % 6, ';'), 'package', 'app') as objectClass, {THREAD} as eventThread, {TRACE} as stackTrace, cast(k as bigint) as weight"),
    "JavaMonitorEnter": ("view", f"{CLASS.format('app/M', 4)} as monitorClass, {THREAD} as eventThread, {TRACE} as stackTrace, k % 9 as address, ns as duration_ns"),
    "SafepointBegin": ("signup", "user_id as safepointId, k as totalThreadCount"),
    "SafepointEnd": ("error", "user_id as safepointId"),
    "SafepointStateSynchronization": ("click", "user_id as safepointId, ns as duration_ns"),
    "ActiveSetting": ("view", f"concat('app.T', k % 5) as id, array({', '.join(repr(s) for s in SETTINGS)})[user_id % 6] as name, concat('v', k) as value, d as start_ns"),
    "ThreadCPULoad": ("view", f"{THREAD} as eventThread, k % 10 / 10D as user, k % 4 / 4D as system"),
    "NetworkUtilization": ("click", "concat('if', k % 3) as networkInterface, k * 1000 as readRate, k * 10 as writeRate"),
    "ObjectCountAfterGC": ("signup", f"{CLASS.format('app/O', 5)} as objectClass, k as count, cast(k * 16 as bigint) as totalSize, d as start_ns"),
    "ObjectCount": ("purchase", f"{CLASS.format('app/O', 5)} as objectClass, k as count, cast(k * 16 as bigint) as totalSize, d as start_ns"),
    "OldObjectSample": ("error", f"start_ns as allocationTime, k as objectAge, {TRACE} as stackTrace, d as start_ns"),
    "IntFlag": ("click", "concat('f', k % 6) as name, cast(k as string) as text"),
    "BooleanFlag": ("view", "concat('g', k % 3) as name, cast(k % 2 = 0 as string) as text"),
    "DeprecatedInvocation": ("signup", "concat('m', k % 4) as method, concat('c', k % 6) as caller, k % 2 = 0 as forRemoval"),
    "CPUInformation": ("view", "concat('cpu', k) as cpu, k as cores"),
    "PhysicalMemory": ("click", "cast(k as bigint) * 4096 as totalSize"),
    "OSInformation": ("error", "concat('os', k) as osVersion"),
    "JavaThreadStatistics": ("purchase", "k as activeCount, k % 5 as daemonCount"),
}
LABELS = {f"jdk.{t}": t + " Event" for t in TYPES} | {f"app.T{k}": f"Type {k} (Experimental)" for k in range(4)}


def recorded(spark, sf) -> Catalog:
    """The types of TYPES as a catalog of a recording."""
    base = events(spark, sf).selectExpr("event_id as seq", "us * 1000 as start_ns", "user_id", "event_type", "k", "cast(round(value * 1000) as bigint) * 1000 as ns").withColumn("d", F.expr(f"start_ns div {DAY_NS} * {DAY_NS}"))
    tables = {}
    for t, (of, columns) in TYPES.items():
        own = columns if "as start_ns" in columns else f"start_ns, {columns}"
        tables[f"jdk.{t}"] = base.where(F.col("event_type") == of).select("seq", F.expr(f"struct({own})").alias("own")).select("seq", "own.*")
    return Catalog(tables, LABELS, order=("start_ns", "seq"), names=RECORDED)


#: The same events in DuckDB, and the texts of what the structs show.
B = f"(select event_id as seq, us * 1000 as start_ns, user_id, event_type, k, cast(round(value * 1000) as bigint) * 1000 as ns, us * 1000 // {DAY_NS} * {DAY_NS} as d from {E})"
TOP_CLASS = "case when k % 3 = 0 then 'java.util.HashMap' else 'app.C' || (k % 5) end"
TOP = f"({TOP_CLASS} || case when k % 4 = 0 then '.<init>' else '.put' end || '(int)')"
NOT_INIT = f"(case when k % 4 = 0 then 'app.D' || (user_id % 4) || '.call' else {TOP_CLASS} || '.put' end || '(int)')"
APPLICATION = f"(case when k % 3 = 0 then 'app.D' || (user_id % 4) || '.call' || '(int)' else {TOP} end)"


def named(name: str, sql: str):
    """Registers a named view as view_<name>; structs come as what they show."""

    def run(spark, sf):
        out = view(name, recorded(spark, sf))
        shown = {"struct": lambda f: naming.display(F.col(f.name), f.dataType), "array": lambda f: F.array_join(f.name, ",")}
        return out.select(*[shown.get(f.dataType.typeName(), lambda f: F.col(f.name))(f).alias(f.name) for f in out.schema])

    query("view_" + name.replace("-", "_"), sql)(run)


def whole(x: str) -> str:
    return f"cast({x} as bigint)"


def counted(key: str, x: str, of: str, more: str = "") -> str:
    return f"select {x} as {key}, count(*) as count, count(*) / sum(count(*)) over () as share from {B} where event_type = '{of}' group by 1 {more}"


def waited(key: str, x: str) -> str:
    return f"select {x} as {key}, count(*) as count, {whole('floor(avg(ns) + 0.5)')} as average, {whole('trunc(' + exc('ns', 90) + ')')} as p90, max(ns) as longest from {B} where event_type = 'view' group by 1"


named("gc-pauses", f"select {whole('sum(ns)')} as total, count(*) as count, min(ns) as shortest, {exc('ns', 50)} as median, {exc('ns', 90)} as p90, {exc('ns', 95)} as p95, {exc('ns', 99)} as p99, {exc('ns', 99.9)} as p999, max(ns) as longest from {B} where event_type = 'error' having count(*) > 0")
named("gc", f"select start_ns as startTime, seq as gcId, case when k % 2 = 0 then 'New' else 'Old' end as name, 'cause ' || (k % 3) as cause, ns as sumOfPauses, ns as longestPause from {B} where event_type = 'error'".replace("startTime", '"startTime"').replace("gcId", '"gcId"').replace("sumOfPauses", '"sumOfPauses"').replace("longestPause", '"longestPause"'))
named(
    "gc-pause-phases",
    f"with p as (select *, case event_type when 'click' then 'Pause ' || (k % 4) else 'Sub ' || (k % 3) end as name from {B} where event_type in ('click', 'view')) select case when name like 'P%' then 'GCPhasePause Event' else 'GCPhasePauseLevel1 Event' end as type, name, {whole('floor(avg(ns) + 0.5)')} as average, {whole('trunc(' + exc('ns', 95) + ')')} as p95, max(ns) as longest, count(*) as count, {whole('sum(ns)')} as total from p group by name",
)
named("gc-cpu-time", f'select {whole("sum(k * 10)")} as "user", {whole("sum(k * 3)")} as system, {whole("sum(k * 7)")} as wall, max(start_ns) - min(start_ns) as span, count(*) as count from {B} where event_type = \'purchase\' having count(*) > 0')
_LOADS = (("jvmUser", "k % 100 / 100"), ("jvmSystem", "k % 7 / 8"), ("machineTotal", "k % 50 / 50"))
named("cpu-load", "select " + ", ".join(f'{f}({x}) as "{f}_{p}"' if f != "avg" else f'avg({x}) as "avg_{p}"' for p, x in _LOADS for f in ("min", "avg", "max")) + f" from {B} where event_type = 'view' having count(*) > 0")
named("exception-count", f"select (arg_max(seq, (start_ns, seq)) - arg_min(seq, (start_ns, seq))) * 2 as thrown from {B} where event_type = 'signup' having count(*) > 0")
named("exception-by-type", counted("class", "'app.E' || (k % 4)", "error"))
named("exception-by-site", counted("method", NOT_INIT, "error"))
named("hot-methods", counted("method", TOP, "click"))
named("allocation-by-class", f"select 'app.K' || (k % 6) || '[]' as class, {whole('sum(k)')} as weight, sum(k) / sum(sum(k)) over () as share from {B} where event_type = 'purchase' group by 1")
named("allocation-by-thread", f"select 't' || (user_id % 5) as thread, {whole('sum(k)')} as weight, sum(k) / sum(sum(k)) over () as share from {B} where event_type = 'purchase' group by 1")
named("allocation-by-site", f"select {TOP} as method, {whole('sum(k)')} as weight, sum(k) / sum(sum(k)) over () as share from {B} where event_type = 'purchase' group by 1")
named("memory-leaks-by-site", f"with o as (select *, d = (select max(d) from {B} where event_type = 'error') as l from {B} where event_type = 'error') select arg_max_null(start_ns, (d, seq)) filter (l) as last, {APPLICATION} as method, arg_max_null(k, (d, seq)) filter (l) as age from o group by 2 having count(*) filter (l) > 0")
named("contention-by-class", waited("class", "'app.M' || (k % 4)"))
named("contention-by-thread", waited("thread", "'t' || (user_id % 5)"))
named("contention-by-site", waited("method", TOP))
named("contention-by-address", waited("address", "k % 9"))
named("thread-cpu-load", f'select \'t\' || (user_id % 5) as thread, arg_max_null(k % 4 / 4, (start_ns, seq)) as system, arg_max_null(k % 10 / 10, (start_ns, seq)) as "user" from {B} where event_type = \'view\' group by 1')
named("thread-count", f"select seq, start_ns, k as activeCount, k % 5 as daemonCount from {B} where event_type = 'purchase'".replace("activeCount", '"activeCount"').replace("daemonCount", '"daemonCount"'))
named("network-utilization", f"select 'if' || (k % 3) as interface, avg(k * 1000) as avg_read, max(k * 1000) as max_read, avg(k * 10) as avg_write, max(k * 10) as max_write from {B} where event_type = 'click' group by 1")
named(
    "object-statistics",
    f"with o as (select *, d = (select max(d) from {B} where event_type in ('signup', 'purchase')) as l from {B} where event_type in ('signup', 'purchase')) select 'app.O' || (k % 5) as class, arg_max_null(k, (d, seq)) filter (l) as count, {whole('arg_max_null(k * 16, (d, seq)) filter (l)')} as space, {whole('arg_max(k, (d, seq)) * 16 - arg_min(k, (d, seq)) * 16')} as increase from o group by 1 having count(*) filter (l) > 0",
)
named("system-information", f"with x as (select *, event_type = 'click' as m, event_type = 'error' as o, event_type = 'view' as c from {B} where event_type in ('click', 'error', 'view')) select arg_max_null(case when m then cast(k as bigint) * 4096 end, (start_ns, seq)) as memory, arg_max_null(case when o then 'os' || k end, (start_ns, seq)) as os, arg_max_null(case when c then 'cpu' || k end, (start_ns, seq)) as cpu, arg_max_null(case when c then k end, (start_ns, seq)) as cores from x having count(*) > 0")
named("jvm-flags", f"select case event_type when 'click' then 'f' || (k % 6) else 'g' || (k % 3) end as name, arg_max_null(case event_type when 'click' then cast(k as varchar) else cast(k % 2 = 0 as varchar) end, (start_ns, seq)) as value from {B} where event_type in ('click', 'view') group by 1")
named(
    "safepoints",
    f"""with x as (select * from {B} where event_type in ('signup', 'error', 'click')) select arg_min_null(start_ns, (start_ns, seq)) filter (event_type = 'signup') as "startTime",
    case when count(*) filter (event_type = 'signup') > 0 and count(*) filter (event_type = 'error') > 0 then arg_max(start_ns, (start_ns, seq)) filter (event_type = 'error') - arg_min(start_ns, (start_ns, seq)) filter (event_type = 'signup') else {FOREVER} end as length,
    cast(sum(ns) filter (event_type = 'click') as bigint) as synchronization, arg_min_null(k, (start_ns, seq)) filter (event_type = 'signup') as threads from x group by user_id""",
)
_LASTS = ", ".join(f"arg_max_null('v' || k, (d, seq)) filter (s = {i} and last) as {n}" for i, n in enumerate(("enabled", "threshold", "stack_trace", "period", "cutoff", "throttle")))
named(
    "active-settings",
    f"with v as (select *, user_id % 6 as s from {B} where event_type = 'view'), l as (select *, d = max(d) over (partition by s) as last from v) select case when k % 5 < 4 then 'Type ' || (k % 5) else 'app.T' || (k % 5) end as type, {_LASTS} from l group by k % 5 having count(*) filter (s = 0 and last) > 0",
)
named("deprecated-methods-for-removal", f"select 'm' || (k % 4) as method, array_to_string(list_sort(list(distinct 'c' || (k % 6))), ',') as classes from {B} where event_type = 'signup' and k % 2 = 0 group by 1")
_ALL = " union all ".join(f"select '{t} Event' as type, count(*) as count from events where event_type = '{of}' having count(*) > 0" for t, (of, _) in TYPES.items())
named("events-by-count", _ALL)
named("events-by-name", _ALL)
