"""Views by name, over the types of a recording: the fixed reports on collections, load, methods, exceptions, locks, threads and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventloom.plans.views import Item, Source, View, agg, evaluate, field
from eventloom.sources.catalog import Catalog

PHASES = tuple(Source(t) for t in ("GCPhasePause", "GCPhasePauseLevel1", "GCPhasePauseLevel2", "GCPhasePauseLevel3", "GCPhasePauseLevel4"))
FLAGS = tuple(Source(t) for t in ("BooleanFlag", "IntFlag", "LongFlag", "DoubleFlag", "StringFlag", "UnsignedIntFlag", "UnsignedLongFlag"))


def _load(*paths: str) -> tuple[Item, ...]:
    return tuple(agg(f"{short}_{p}", f, p) for p in paths for short, f in (("min", "MIN"), ("avg", "AVG"), ("max", "MAX")))


def _counted(key: str, path: str, event_type: str, limit: int | None = None) -> View:
    """How often each value of a path comes, with its share of all."""
    return View((field(key, path), agg("count", "COUNT")), (Source(event_type),), group_by=(key,), order_by=(("count", "DESC"), (key, "ASC")), normalized=(("count", "share"),), limit=limit)


def _summed(key: str, path: str, event_type: str) -> View:
    """The sum of weights of each value of a path, with its share of all."""
    return View((field(key, path), agg("weight", "SUM", "weight")), (Source(event_type),), group_by=(key,), order_by=(("weight", "DESC"), (key, "ASC")), normalized=(("weight", "share"),))


def _waited(key: str, path: str, event_type: str) -> View:
    times = (agg("count", "COUNT"), agg("average", "AVG", "duration"), agg("p90", "P90", "duration"), agg("longest", "MAX", "duration"))
    return View((field(key, path), *times), (Source(event_type),), group_by=(key,), order_by=(("longest", "DESC"),))


VIEWS: dict[str, View] = {
    "gc-pauses": View((agg("total", "SUM", "sumOfPauses"), agg("count", "COUNT"), agg("shortest", "MIN", "sumOfPauses"), agg("median", "MEDIAN", "sumOfPauses"), *[agg(p.lower(), p, "sumOfPauses") for p in ("P90", "P95", "P99", "P999")], agg("longest", "MAX", "sumOfPauses")), (Source("GarbageCollection"),)),
    "gc": View((field("startTime"), field("gcId"), field("name"), field("cause"), field("sumOfPauses"), field("longestPause")), (Source("GarbageCollection"),), order_by=(("startTime", "ASC"), ("gcId", "ASC"))),
    "gc-pause-phases": View((field("type", "eventType.label"), field("name"), agg("average", "AVG", "duration"), agg("p95", "P95", "duration"), agg("longest", "MAX", "duration"), agg("count", "COUNT"), agg("total", "SUM", "duration")), PHASES, group_by=("name",), order_by=(("total", "DESC"),)),
    "gc-cpu-time": View((agg("user", "SUM", "userTime"), agg("system", "SUM", "systemTime"), agg("wall", "SUM", "realTime"), agg("span", "DIFF", "startTime"), agg("count", "COUNT")), (Source("GCCPUTime"),)),
    "cpu-load": View(_load("jvmUser", "jvmSystem", "machineTotal"), (Source("CPULoad"),)),
    "exception-count": View((agg("thrown", "DIFF", "throwables"),), (Source("ExceptionStatistics"),)),
    "exception-by-type": _counted("class", "thrownClass", "JavaExceptionThrow"),
    "exception-by-site": _counted("method", "stackTrace.topNotInitFrame.method", "JavaExceptionThrow"),
    "hot-methods": _counted("method", "stackTrace.topFrame.method", "ExecutionSample", 25),
    "allocation-by-class": _summed("class", "objectClass", "ObjectAllocationSample"),
    "allocation-by-thread": _summed("thread", "eventThread", "ObjectAllocationSample"),
    "allocation-by-site": _summed("method", "stackTrace.topFrame.method", "ObjectAllocationSample"),
    "memory-leaks-by-site": View((agg("last", "LAST_BATCH", "allocationTime"), field("method", "stackTrace.topApplicationFrame.method"), agg("age", "LAST_BATCH", "objectAge")), (Source("OldObjectSample"),), group_by=("method",), order_by=(("last", "ASC"),)),
    "contention-by-class": _waited("class", "monitorClass", "JavaMonitorEnter"),
    "contention-by-thread": _waited("thread", "eventThread", "JavaMonitorEnter"),
    "contention-by-site": _waited("method", "stackTrace.topFrame.method", "JavaMonitorEnter"),
    "contention-by-address": _waited("address", "address", "JavaMonitorEnter"),
    "thread-cpu-load": View((field("thread", "eventThread"), agg("system", "LAST", "system"), agg("user", "LAST", "user")), (Source("ThreadCPULoad"),), group_by=("thread",), order_by=(("user", "DESC"), ("system", "DESC"))),
    "thread-count": View((field("*", "*"),), (Source("JavaThreadStatistics"),)),
    "network-utilization": View((field("interface", "networkInterface"), agg("avg_read", "AVG", "readRate"), agg("max_read", "MAX", "readRate"), agg("avg_write", "AVG", "writeRate"), agg("max_write", "MAX", "writeRate")), (Source("NetworkUtilization"),), group_by=("interface",)),
    "object-statistics": View((field("class", "objectClass"), agg("count", "LAST_BATCH", "count"), agg("space", "LAST_BATCH", "totalSize"), agg("increase", "DIFF", "totalSize")), (Source("ObjectCountAfterGC"), Source("ObjectCount")), group_by=("class",), order_by=(("space", "DESC"),)),
    "system-information": View((agg("memory", "LAST", "totalSize"), agg("os", "LAST", "osVersion"), agg("cpu", "LAST", "cpu"), agg("cores", "LAST", "cores")), (Source("CPUInformation"), Source("PhysicalMemory"), Source("OSInformation"))),
    "jvm-flags": View((field("name"), agg("value", "LAST", "text")), FLAGS, group_by=("name",), order_by=(("name", "ASC"),)),
    "safepoints": View(
        (field("startTime", "startTime", "B"), agg("length", "DIFF", "startTime", "B", "E"), agg("synchronization", "SUM", "duration", "S"), field("threads", "totalThreadCount", "B")),
        (Source("SafepointBegin", "B"), Source("SafepointEnd", "E"), Source("SafepointStateSynchronization", "S")),
        group_by=("safepointId",),
        order_by=(("length", "DESC"),),
    ),
    "active-settings": View(
        (field("type", "id"), *[agg(n, "LAST_BATCH", "value", a) for n, a in (("enabled", "E"), ("threshold", "T"), ("stack_trace", "S"), ("period", "P"), ("cutoff", "C"), ("throttle", "U"))]),
        tuple(Source("ActiveSetting", a, (("name", n),)) for n, a in (("enabled", "E"), ("threshold", "T"), ("stackTrace", "S"), ("period", "P"), ("cutoff", "C"), ("throttle", "U"))),
        group_by=("id",),
        order_by=(("type", "ASC"),),
    ),
    "deprecated-methods-for-removal": View((field("method"), agg("classes", "SET", "caller")), (Source("DeprecatedInvocation", where=(("forRemoval", "true"),)),), group_by=("method",), order_by=(("method", "ASC"),)),
    "events-by-count": View((field("type", "eventType.label"), agg("count", "COUNT")), (Source("*"),), group_by=("type",), order_by=(("count", "DESC"), ("type", "ASC"))),
    "events-by-name": View((field("type", "eventType.label"), agg("count", "COUNT")), (Source("*"),), group_by=("type",), order_by=(("type", "ASC"),)),
}


def register_view(name: str, view: View) -> None:
    VIEWS[name.lower()] = view


def view(name: str, catalog: Catalog) -> DataFrame:
    """The rows of a named view. Types of its sources that a recording lacks are left out if others of the same union are there."""
    found = VIEWS.get(name.lower())
    if found is None:
        raise ValueError(f"no view {name}; there are {', '.join(sorted(VIEWS))}")
    if not any(s.alias for s in found.sources) and len(found.sources) > 1:
        there = tuple(s for s in found.sources if catalog.names(s.event_type))
        found = View(found.select, there or found.sources, found.where, found.group_by, found.order_by, found.limit, found.normalized, found.label)
    return evaluate(found, catalog)
