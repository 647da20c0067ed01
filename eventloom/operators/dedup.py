"""Deduplication of event streams: only changes of a key's values stay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.ranges import with_previous


def changes(events: DataFrame, keys: list[str], compared: list[str], order: list[str], per: list[str] | None = None) -> DataFrame:
    """Rows whose compared fields differ from the same key's row before, in the given order; first rows stay.

    keys: none for singletons. per: columns of which each value starts afresh, such as the input file. Nulls equal nulls.
    """
    marked = with_previous(events, [*(per or []), *keys], F.struct(*compared), order)
    now = F.struct(*compared)
    return marked.where(F.col("__first") | ~now.eqNullSafe(F.col("__last"))).select(*events.columns)


def first_of_each(events: DataFrame, keys: list[str], order: list[str], per: list[str] | None = None) -> DataFrame:
    """The first row of each key: the least by the order, summed up before the shuffle."""
    return events.groupBy(*(per or []), *keys).agg(F.min_by(F.struct(*events.columns), F.struct(*order)).alias("__row")).select("__row.*")


@dataclass(frozen=True)
class Rule:
    """How events of a type repeat: by key and compared fields (none: all but the times), or first only.

    periodic: such events are observations of their times, so that repeated ones are dropped only where losses are allowed.
    """

    keys: tuple[str, ...] = ()
    compared: tuple[str, ...] = ()
    first_only: bool = False
    periodic: bool = False


#: The event types that are deduplicated, with their keys and compared fields.
FLAGS = ("BooleanFlag", "DoubleFlag", "IntFlag", "LongFlag", "StringFlag", "UnsignedIntFlag", "UnsignedLongFlag")
RULES = {
    **{f"{t}": Rule(("name",), ("value",)) for t in FLAGS},
    "ModuleRequire": Rule(("source", "requiredModule"), first_only=True),
    "ModuleResolution": Rule(("exportedPackage", "targetModule"), first_only=True),
    "ModuleExport": Rule(("exportedPackage", "targetModule"), first_only=True),
    "DeprecatedInvocation": Rule(("method", "stackTrace"), first_only=True),
    "InitialEnvironmentVariable": Rule(("key",), ("value",)),
    "InitialSystemProperty": Rule(("key",), ("value",)),
    "InitialSecurityProperty": Rule(("key",), ("value",)),
    "ActiveSetting": Rule(("id", "name"), ("value",)),
    "JavaAgent": Rule(("name",), ("options", "dynamic")),
    "NativeAgent": Rule(("name",), ("options", "dynamic", "path")),
    "NetworkUtilization": Rule(("networkInterface",), ("readRate", "writeRate"), periodic=True),
    "SystemProcess": Rule(("pid",), ("commandLine",), periodic=True),
    "NativeLibrary": Rule(("name",), ("baseAddress", "topAddress"), periodic=True),
    "NativeLibraryLoad": Rule(("name",), ("success",), periodic=True),
    "ThreadCPULoad": Rule(("eventThread",), ("user", "system"), periodic=True),
    "ThreadAllocationStatistics": Rule(("thread",), ("allocated",), periodic=True),
    "CodeCacheStatistics": Rule(("codeBlobType",), (), periodic=True),
    "CompilerQueueUtilization": Rule(
        ("compiler",), ("addedRate", "removedRate", "queueSize", "peakQueueSize", "addedCount", "removedCount", "totalAddedCount", "totalRemovedCount", "compilerThreadCount"), periodic=True
    ),
    "GCHeapMemoryPoolUsage": Rule(("name",), ("used", "committed", "max"), periodic=True),
    "NativeMemoryUsage": Rule(("type",), ("reserved", "committed"), periodic=True),
    "DirectBufferStatistics": Rule(periodic=True),
    "JVMInformation": Rule(),
    "OSInformation": Rule(),
    "CPUInformation": Rule(),
    "GCSurvivorConfiguration": Rule(),
    "GCTLABConfiguration": Rule(),
    "GCHeapConfiguration": Rule(),
    "YoungGenerationConfiguration": Rule(),
    "VirtualizationInformation": Rule(),
    "CodeCacheConfiguration": Rule(),
    "CPUTimeStampCounter": Rule(),
    "CompilerConfiguration": Rule(),
    "GCConfiguration": Rule(periodic=True),
    "PhysicalMemory": Rule(periodic=True),
    "NativeMemoryUsageTotal": Rule(periodic=True),
    "SwapSpace": Rule(periodic=True),
    "ClassLoadingStatistics": Rule(periodic=True),
    "CompilerStatistics": Rule(periodic=True),
    "SymbolTableStatistics": Rule(periodic=True),
    "StringTableStatistics": Rule(periodic=True),
    "ResidentSetSize": Rule(periodic=True),
    "ExceptionStatistics": Rule(periodic=True),
    "GCHeapMemoryUsage": Rule(periodic=True),
    "CPULoad": Rule(periodic=True),
    "JavaMonitorStatistics": Rule(periodic=True),
}
TIMES = ("seq", "start_ns", "end_ns", "startTime", "endTime", "event_type")


def deduplicate(events: DataFrame, event_type: str, order: list[str], per: list[str] | None = None, periodic: bool = True) -> DataFrame:
    """events of one type by its rule; types without a rule, or that lack its fields, stay as they are. periodic: also by rules for periodic types."""
    rule = RULES.get(event_type.rpartition(".")[2])
    if rule is None or rule.periodic and not periodic or not {*rule.keys, *rule.compared} <= set(events.columns):
        return events
    if rule.first_only:
        return first_of_each(events, list(rule.keys), order, per)
    compared = list(rule.compared) or [c for c in events.columns if c not in TIMES and c not in rule.keys and c not in (per or [])]
    return changes(events, list(rule.keys), compared, order, per)
